"""Token counts and offsets of a public byte-level BPE vocabulary, inside Arrow batches.

The vocabulary file is a parameter; it must lie at the same path on every worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default vocabulary: base64 token and rank in each line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary divides a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_KEPT = 1 << 20


@lru_cache(maxsize=4)
def encoding(vocabulary: str = VOCABULARY):  # noqa: ANN201
    """The encoding, loaded once in each worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("siltmill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Spaced(dict):
    """Token counts of words with a blank before them."""

    def __init__(self, encode) -> None:  # noqa: ANN001
        self._encode = encode

    def __missing__(self, word: str) -> int:
        if len(self) > _KEPT:
            self.clear()
        n = self[word] = len(self._encode(" " + word))
        return n


class Counter:
    """Exact token counts.

    A single blank between two others always starts a token, so a text can be cut there and the counts of the pieces
    added; most pieces are words that were counted before. Texts with runs of blanks are encoded whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        self._encode = encoding(vocabulary).encode_ordinary
        self._spaced = _Spaced(self._encode)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text:
            return len(self._encode(text))
        first, *rest = text.split(" ")
        return len(self._encode(first)) + sum(map(self._spaced.__getitem__, rest))


@lru_cache(maxsize=4)
def counter(vocabulary: str = VOCABULARY) -> Counter:
    return Counter(vocabulary)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; null and '' have 0. No built-in knows a vocabulary, so it runs on Arrow batches."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(vocabulary)
        for texts in batches:
            yield texts.map(c.count).astype("int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, T.LongType())(text)


def token_offsets(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Prefix sums of the tokens' lengths in bytes: token i covers bytes off[i] to off[i + 1]."""
    enc = encoding(vocabulary)
    parts = enc.decode_tokens_bytes(enc.encode_ordinary(text))
    return np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
