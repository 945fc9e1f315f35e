"""Languages of texts by character trigrams, fitted on labelled texts.

``fit`` takes a bounded sample of texts for each language: ``sample`` at most, of 20,000 characters at most each, chosen
by hash, whatever the number of labelled texts. A profile is the logarithm of the share of each trigram, in a table of fixed size; trigrams that share a
cell blur it a little. A text's language is that with the highest mean over its trigrams, if it is clearly ahead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CELLS = 1 << 16
#: Which code points of the basic plane are letters; above it all are taken for letters.
_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


@dataclass(frozen=True)
class Profiles:
    """``names`` of the languages, and ``table``: a row of log shares for each of them."""

    names: tuple[str, ...]
    table: np.ndarray


def _cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell) of all trigrams of letters and blanks, in lower case; runs of anything else are one blank."""
    joined = "\n".join(" " + t.lower().replace("\n", " ") + " " for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.cumsum(code == 10)
    letter = (code >= 1 << 16) | _LETTER[np.minimum(code, (1 << 16) - 1).astype(np.int64)] | (code == 10)
    code = np.where(letter, code, np.uint64(32))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code, owner = code[keep], owner[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = code[:-2], code[1:-1], code[2:]
    h = ((a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xBF58476D1CE4E5B9)) ^ (c * np.uint64(0x94D049BB133111EB))) * np.uint64(0xD6E8FEB86659FD93)
    inside = (a != 10) & (b != 10) & (c != 10)
    return owner[:-2][inside], (h >> np.uint64(48)).astype(np.int64)[inside]


def fit(labelled: DataFrame, text: str, lang: str, sample: int = 2_000, least_share: float = 0.02, seed: int = 7) -> Profiles:
    """Profiles of the languages that ``least_share`` of the labelled texts have; labels are read by their first two letters."""
    code = F.substring(F.lower(F.trim(lang)), 1, 2)
    rows = labelled.select(F.col(text).alias("text"), code.alias("lang")).filter("length(lang) = 2 and length(text) between 1 and 20000")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(200).collect()}
    names = tuple(sorted(x for x, n in counts.items() if n >= least_share * sum(counts.values())))
    share = F.lit(0)
    for name in names:
        share = F.when(F.col("lang") == name, min(1_000_000, 2_000_000 * sample // counts[name] + 1)).otherwise(share)
    texts: dict[str, list[str]] = {name: [] for name in names}
    for r in rows.filter(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_000)) < share).limit(4 * sample * max(1, len(names))).collect():
        texts[r["lang"]].append(r["text"])
    tables = []
    for name in names:
        n = np.bincount(_cells(sorted(texts[name])[:sample])[1], minlength=_CELLS).astype(float)
        tables.append(np.log((n + 0.05) / (n.sum() + 0.05 * _CELLS)))
    return Profiles(names, np.array(tables, np.float32).reshape(len(names), _CELLS))


def language(profiles: Profiles, ahead: float = 0.25, least: int = 24):  # noqa: ANN201
    """A function of a text column: its language, null for a text of fewer than ``least`` trigrams or without a clear lead.

    ``ahead`` is the lead over the second in the mean logarithm of a trigram's share.
    """
    names = np.array([*profiles.names, None], dtype=object)
    table = profiles.table

    def judge(texts: list[str]) -> np.ndarray:
        owner, cell = _cells(texts)
        n = np.bincount(owner, minlength=len(texts))[: len(texts)]
        scores = np.stack([np.bincount(owner, weights=row[cell], minlength=len(texts))[: len(texts)] for row in table]) / np.maximum(n, 1)
        order = np.sort(scores, axis=0)
        clear = (n >= least) & ((order[-1] - order[-2] >= ahead) if len(table) > 1 else True)
        return names[np.where(clear, scores.argmax(axis=0), len(names) - 1)]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = judge([t or "" for t in texts]) if len(texts) and len(table) else np.full(len(texts), None, object)
            yield pd.Series(found, index=texts.index, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, T.StringType())

    def of(text: Column) -> Column:
        return udf(text)

    return of
