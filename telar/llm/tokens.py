"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies unless the caller names another file of ranks; it is only read.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# The published pattern that goes with these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    """The encoder of a file of ranks; made once in each Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(vocabulary: str, text: str) -> list[int]:
    """Token ids of a text of any length.

    The library's matcher gives up on white space over about a million characters; such
    a text is split by another one with the same pattern.
    """
    e = encoding(vocabulary)
    try:
        return e.encode_ordinary(text)
    except BaseException as x:
        if type(x).__name__ != "PanicException":
            raise
    import regex

    return [token for piece in regex.finditer(PATTERN, text) for token in e._encode_single_piece(piece[0])]


@lru_cache(maxsize=4)
def token_bytes(vocabulary: str) -> np.ndarray:
    """Bytes of each token by its id."""
    e = encoding(vocabulary)
    out = np.zeros(e.max_token_value + 1, "int32")
    for i, token in enumerate(e.token_byte_values()):
        out[e.encode_single_token(token)] = len(token)
    return out


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text; 0 for an empty text or null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode(vocabulary, x)) if x else 0 for x in texts], dtype="int64")

    return count(text)


def sized(docs: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and n_tokens of each text."""
    return docs.select(*keep, token_count(F.col("text"), vocabulary).alias("n_tokens"))
