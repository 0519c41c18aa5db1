"""The words of a short text, as the near-duplicate and language operators count them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Links, mentions and everything between runs of letters or digits.
BETWEEN_WORDS = r"https?://\S+|@[a-zA-Z0-9\p{L}\p{N}_]+|[^a-zA-Z0-9\p{L}\p{N}]+"


def word_list(text: Column) -> Column:
    """Runs of letters or digits as they stand, without links, mentions and the word RT."""
    return F.array_remove(F.array_remove(F.split(text, BETWEEN_WORDS), ""), "RT")


def words(text: Column) -> Column:
    """The distinct lower-case runs of letters or digits, without links, mentions and the word RT. Null gives null."""
    return F.array_distinct(F.transform(word_list(text), F.lower))
