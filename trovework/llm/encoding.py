"""Token ids of every text by a public tokenizer, and the texts again from the ids.

The vocabulary is a local rank file whose path is a parameter. Long texts are split before encoding at places where
the tokenizer's own pre-splitting always splits too, so the ids are those of the whole text and no long run of
merges is done at once. Null and empty texts get an empty list; names of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of the vocabulary files; another place is given as a parameter.
RANKS = os.environ.get("TROVEWORK_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-splitting pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text longer than this is split first.
PIECE = 1 << 16
#: After a letter or digit and before one blank and a letter, every pre-splitting of PATTERN has a border.
_SAFE = re.compile(r"(?<=[^\W_])(?= [^\W_])")


@lru_cache(maxsize=4)
def encoder(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text cut at safe borders, the first after each size characters; whole where there is none."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def ids_of(text: str | None, path: str = RANKS) -> list[int]:
    if not text:
        return []
    enc = encoder(path)
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def encode(docs: DataFrame, text: str = "text", path: str = RANKS, out: str = "ids") -> DataFrame:
    """docs with the ids of each text as array<int>; no shuffle. Rows that repeat stay as they are."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([ids_of(t, path) for t in texts], dtype=object)

    return docs.withColumn(out, run(F.col(text)))


def token_counts(docs: DataFrame, text: str = "text", path: str = RANKS, out: str = "n_tokens") -> DataFrame:
    """As encode(), but only the number of ids."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([len(ids_of(t, path)) for t in texts], dtype="int64")

    return docs.withColumn(out, run(F.col(text)))


def decode(rows: DataFrame, ids: str = "ids", path: str = RANKS, out: str = "text") -> DataFrame:
    """The texts of the ids, joined as raw bytes first so that a character over several ids comes out whole; null ids give null."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([None if x is None else enc.decode_bytes([int(i) for i in x]).decode("utf-8", "replace") for x in lists], dtype=object)

    return rows.withColumn(out, run(F.col(ids)))
