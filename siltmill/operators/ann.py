"""Approximate nearest neighbours by cosine: an inverted file over k-means cells.

The cells are fitted on a bounded sample; every row is indexed. How many cells a query looks at is fitted too, so that
the neighbours which the sample's vectors have within the sample are found at the wanted recall: a few cells where
vectors come in clusters, most of them where they don't. The sample is thinner than the corpus and neighbours in it
farther apart, so the corpus itself is found at least as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmill.operators.ranking import top
from siltmill.runtime import cut

_BLOCK = 4096


@dataclass(frozen=True)
class Index:
    """``rows``: cell, id, unit vector, a written table. ``centres`` are at most ``most_cells`` vectors.

    ``probe``: the share of the cells that a query looks at.
    """

    rows: DataFrame
    centres: np.ndarray
    id_: str
    probe: float


def build(df: DataFrame, id_: str, vec: str, cells: int | None = None, sample: int = 20_000, most_cells: int = 4096, seed: int = 7, recall: float = 0.95) -> Index:
    """Fits cells on ``sample`` rows at most, chosen by hash, and assigns every row. Null and zero vectors are left out."""
    rows = df.select(F.col(id_).alias("id"), F.col(vec).alias("v")).filter("id is not null and array_size(v) > 0")
    n = rows.count()
    cells = max(1, min(most_cells, cells or int(math.sqrt(n))))
    share = min(1.0, sample / max(1, n))
    picked = rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(sample).select("v").collect()
    v = _unit(np.array([r["v"] for r in picked], float).reshape(len(picked), -1)) if picked else np.zeros((0, 1))
    v = v[np.isfinite(v).all(axis=1)]
    centres = _fit(v, cells, seed) if len(v) else np.zeros((1, 1))
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = _unit(np.stack(pdf["v"].to_numpy()).astype(float)) if len(pdf) else np.zeros((0, shared.value.shape[1]))
            ok = np.isfinite(v).all(axis=1)
            yield pd.DataFrame({"cell": (v[ok] @ shared.value.T).argmax(axis=1).astype("int32"), "id": pdf["id"].to_numpy()[ok], "v": list(v[ok])})

    indexed = cut(rows.mapInPandas(assign, f"cell int, id {dict(df.dtypes)[id_]}, v array<double>"))
    return Index(indexed, centres, id_, _probe(v, centres, recall, seed))


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _fit(v: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = v[rng.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(rounds):
        own = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _probe(v: np.ndarray, centres: np.ndarray, recall: float, seed: int, asked: int = 300, k: int = 10) -> float:
    """The share of cells, nearest first, that hold ``recall`` of the neighbours that some vectors of the sample have in it."""
    if len(v) <= k:
        return 1.0
    some = v[np.random.default_rng(seed + 1).choice(len(v), min(asked, len(v)), replace=False)]
    near = np.argpartition(-(some @ v.T), k, axis=1)[:, :k]
    cell = (v @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(some @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel()) + 1
    return float(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) / len(centres)


def search(index: Index, queries: DataFrame, query: str, vec: str, k: int, probe: float | None = None) -> DataFrame:
    """(query, id, sim, rank) from the nearest cells of each query, a ``probe`` share of all cells, as fitted if not given.

    The vectors of a cell are packed into blocks, and so are the queries that look at it; each pair of blocks is one
    matrix product, of which the k best of each query leave the task.
    """
    n = max(1, math.ceil((index.probe if probe is None else probe) * len(index.centres)))
    shared = queries.sparkSession.sparkContext.broadcast(index.centres)

    def cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            u = _unit(np.stack(pdf["v"].to_numpy()).astype(float)) if len(pdf) else np.zeros((0, shared.value.shape[1]))
            ok = np.nonzero(np.isfinite(u).all(axis=1))[0]
            near = np.argsort(-(u[ok] @ shared.value.T), axis=1)[:, :n]
            at = np.repeat(ok, near.shape[1])
            yield pd.DataFrame({"q": pdf["q"].to_numpy()[at], "cell": near.ravel().astype("int32"), "u": list(u[at])})

    kinds = dict(queries.dtypes)[query], dict(index.rows.dtypes)["id"]
    asked = queries.select(F.col(query).alias("q"), F.col(vec).alias("v")).filter("q is not null and array_size(v) > 0")
    probes = asked.mapInPandas(cells_of, f"q {kinds[0]}, cell int, u array<double>")
    def packed(df: DataFrame, what: str, vector: str, into: str) -> DataFrame:
        sizes = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("_b"))  # a row for each cell: broadcast
        return df.join(F.broadcast(sizes), "cell").groupBy("cell", F.pmod(F.xxhash64(what), F.col("_b")).alias("block")).agg(F.collect_list(F.struct(F.col(what).alias("i"), F.col(vector).alias("x"))).alias(into)).drop("block")

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, asks in zip(pdf["rows"], pdf["asks"], strict=True):
                ids = np.array([r["i"] for r in rows])
                sims = np.round(np.stack([a["x"] for a in asks]) @ np.stack([r["x"] for r in rows]).T, 12)
                for a, s in zip(asks, sims, strict=True):
                    best = np.lexsort((ids, -s))[:k]
                    yield pd.DataFrame({"q": [a["i"]] * len(best), "id": ids[best], "sim": s[best]})

    pairs = packed(index.rows, "id", "v", "rows").join(packed(cut(probes), "q", "u", "asks"), "cell")
    found = top(pairs.select("rows", "asks").mapInPandas(product, f"q {kinds[0]}, id {kinds[1]}, sim double"), ["q"], [F.desc("sim"), F.asc("id")], k)
    return found.select(F.col("q").alias(query), F.col("id").alias(index.id_), "sim", "rank")
