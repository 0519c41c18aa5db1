"""placeloom: place-name resolution and text data processing on PySpark."""
