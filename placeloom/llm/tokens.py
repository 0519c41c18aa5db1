"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"  #: any rank file of the tiktoken format
#: Longest piece given to the tokenizer at once; longer texts are cut before white space, where no
#: token crosses, so that the count of the whole text stays the same.
PIECE = 20_000


@lru_cache(4)
def encoder(path: str):
    """The byte-level tokenizer of a rank file."""
    import tiktoken

    # Fixed value: the word pattern published with these vocabularies.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("placeloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """text in pieces of about `size` characters, cut only before a single space between non-spaces."""
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace() and cut + 1 < len(text) and not text[cut + 1].isspace()):
            cut += 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a text; 0 for null and for an empty text."""
    return sum(len(encoder(path).encode_ordinary(p)) for p in pieces(text)) if text else 0


def with_tokens(docs: DataFrame, keep: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """The columns `keep` and tokens: the size of each row's whole text. Null and empty texts have 0."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keep].assign(tokens=[count_tokens(t, path) for t in pdf["_text"]])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "tokens long"])
    return docs.select(*keep, F.col(text).alias("_text")).mapInPandas(run, schema)
