"""Ranking: dense and lexical search, candidate pools, reranking, rank fusion."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmill.functions.text import bound, index_tokens
from siltmill.runtime import cut


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked; limited map-side before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def dot(a: Column, b: Column) -> Column:
    """The inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def exact_search(queries: DataFrame, query_id: str, query_vec: str, corpus: DataFrame, id_: str, vec: str, k: int, block: int = 8192) -> DataFrame:
    """(query_id, id, sim, rank): the k rows of the corpus with the highest cosine, ties by id.

    A stated set of queries against all rows, in blocks: the queries are packed into blocks of ``block`` vectors, each
    block meets each batch of the corpus in matrix products, and only its k best of that batch leave the task. So
    what is shuffled is k rows for each query and batch, never a row for each pair. A batch is sorted by id once, so
    places stand for ids, which stay in Arrow. Zero vectors have no cosine and are left out, as are null ones and rows
    without id.
    """
    kinds = dict(queries.dtypes)[query_id], dict(corpus.dtypes)[id_]

    def dealt(df: DataFrame, key: str, vector: str, n: int, into: str) -> DataFrame:
        """Rows without vector are dropped when they are packed: a filter before would have each vector made twice."""
        packed = _packed(df.select(F.col(key).alias("i"), F.col(vector).alias("v")).filter("i is not null"), n, "r")
        return packed.select(F.filter("r", lambda x: F.array_size(x["v"]) > 0).alias(into))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for several in batches:
            for at in range(several.num_rows):
                one = several.slice(at, 1)
                (qs, a), (ids, b) = (_ids_and_units(one.column(x)) for x in ("qs", "rows"))
                rough = np.ascontiguousarray(b.T, dtype=np.float32)
                for i in range(0, len(a), 128):
                    which, place, sim = _nearest(a[i : i + 128], b, rough, k)
                    yield pa.RecordBatch.from_arrays([qs.take(pa.array(which + i)), ids.take(pa.array(place)), pa.array(sim)], ["q", "id", "sim"])

    batches = dealt(corpus, id_, vec, blocks_of(corpus.sparkSession, corpus.count()), "rows")
    asked = dealt(queries, query_id, query_vec, max(1, math.ceil(queries.count() / block)), "qs")
    paired = batches.crossJoin(asked)  # each block of queries with each batch: the blocks are few and bounded
    found = paired.mapInArrow(search, f"q {kinds[0]}, id {kinds[1]}, sim double")
    best = top(found, ["q"], [F.desc("sim"), F.asc("id")], k)
    return best.select(F.col("q").alias(query_id), F.col("id").alias(id_), "sim", "rank")


def blocks_of(spark: SparkSession, n: int, least: int = 4096, most: int = 16384) -> int:
    """Into how many blocks n rows are dealt: two for each core, of ``least`` to ``most`` rows, as each block gives its k best."""
    return max(1, math.ceil(n / most), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / least)))


def _packed(rows: DataFrame, n: int, into: str) -> DataFrame:
    """The rows, dealt by hash of ``i`` into n blocks, each block as one row, sorted by ``i``."""
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")).repartitionById(n, F.col("_b"))
    return dealt.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(into)).select(into)


def _ids_and_units(packed: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The ids and unit vectors of one packed row, without those that have no cosine."""
    rows = packed.flatten()
    ids, v = rows.field("i"), rows.field("v")
    units = _unit(v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1 if len(v) else 0))
    ok = np.isfinite(units).all(axis=1)
    return ids.filter(pa.array(ok)), units[ok]


def _nearest(a: np.ndarray, b: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, cosine) of the k nearest of each row, rounded so that equal vectors tie, ties by row of b.

    ``rough``, b transposed in single precision, only leaves out what, by the most that it can be off, is not among the
    k; the others are computed in double.
    """
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    sims = a.astype(np.float32) @ rough
    off = (a.shape[1] + 8) * 2.0**-24
    row, col = np.divmod(np.flatnonzero(sims >= (_kth_bound(sims, k) - np.float32(2 * off + 1e-7))[:, None]), len(b))
    value = np.concatenate([np.round(np.einsum("ij,ij->i", a[row[i : i + 65536]], b[col[i : i + 65536]]), 12) for i in range(0, len(row), 65536)])
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept], value[kept]


def _kth_bound(values: np.ndarray, k: int) -> np.ndarray:
    """For each row a bound that its k-th highest value reaches: the k-th highest of the maxima of groups of columns."""
    n, m = values.shape
    if m <= k:
        return np.full(n, -np.inf)
    size = max(1, min(64, m // (4 * k)))
    highest = values[:, : m - m % size].reshape(n, size, -1).max(axis=1)
    return np.partition(highest, highest.shape[1] - k, axis=1)[:, highest.shape[1] - k]


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


@dataclass(frozen=True)
class LexicalIndex:
    """``docs``, a written table: i (the id), len, terms (hashes, sorted), tf. ``terms``: term (its hash), idf.

    Texts are dealt by hash into ``blocks`` blocks, so no term, however frequent, is a hot key. A word is its hash of 64 bits.
    """

    docs: DataFrame
    terms: DataFrame
    blocks: int
    mean: float
    k1: float
    b: float


def _hashed_tokens(text: Column) -> Column:
    return F.transform(index_tokens(text), lambda w: F.xxhash64(w))


def lexical_index(corpus: DataFrame, id_: str, text: str, k1: float = 1.5, b: float = 0.75, most: int = 2_000_000) -> LexicalIndex:
    """The index of a corpus. The terms of a text are counted where it is read; a block has about ``most`` postings at most."""
    tokens = corpus.select(F.col(id_).alias("i"), _hashed_tokens(F.col(text)).alias("t")).filter("i is not null")
    docs = cut(tokens.mapInArrow(_counted, f"i {dict(corpus.dtypes)[id_]}, len int, terms array<bigint>, tf array<int>"))
    n_docs, mean, n_terms = docs.agg(F.count(F.lit(1)), F.avg("len"), F.sum(F.size("terms"))).first()
    counts = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    blocks = max(blocks_of(corpus.sparkSession, n_docs), math.ceil((n_terms or 0) / most))
    return LexicalIndex(docs, counts.select("term", idf.alias("idf")), blocks, float(mean or 1), k1, b)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = batch.column("t")
        lengths = t.value_lengths().to_numpy(zero_copy_only=False)
        row, term = np.repeat(np.arange(len(t)), lengths), t.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((term, row))
        row, term = row[order], term[order]
        first = np.nonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])])[0] if len(row) else np.zeros(0, int)
        starts = pa.array(np.searchsorted(row[first], np.arange(len(t) + 1)).astype(np.int32))
        tf = np.diff(np.r_[first, len(row)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(starts, pa.array(term[first])), pa.ListArray.from_arrays(starts, pa.array(tf))
        yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(lengths.astype(np.int32)), *lists], ["i", "len", "terms", "tf"])


def lexical_search(index: LexicalIndex, queries: DataFrame, query_id: str, query: str, id_: str, k: int, block: int = 65536) -> DataFrame:
    """(query_id, id, score, rank): scores above zero, the k best of each query, ties by id. Query terms are a set.

    Blocks of texts meet blocks of ``block`` queries, a stated set; only the k best of a query in a block of texts leave
    it. A block of texts is sorted by id, so places stand for ids.
    """
    asked = cut(queries.select(F.col(query_id).alias("q"), F.array_distinct(_hashed_tokens(F.col(query))).alias("t")).withColumn("i", F.monotonically_increasing_id()))
    weighed = asked.select("i", F.explode("t").alias("term")).join(index.terms, "term").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t"))
    paired = _packed(index.docs, index.blocks, "docs").crossJoin(_packed(weighed, max(1, math.ceil(asked.count() / block)), "qs"))
    found = paired.mapInArrow(_block_scores(k, index.mean, index.k1, index.b), f"i long, id {dict(index.docs.dtypes)['i']}, score double")
    best = top(found, ["i"], [F.desc(F.round("score", 9)), F.asc("id")], k)
    return best.join(asked.select("i", "q"), "i").select(F.col("q").alias(query_id), F.col("id").alias(id_), "score", "rank")


#: Of the most frequent terms of a block so many at most are kept as a weight for each text.
_WHOLE = 256


def _block_scores(k: int, mean: float, k1: float, b: float):  # noqa: ANN202
    def score(docs: pa.StructArray, asked: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, terms = len(docs), docs.field("terms")
        at = np.repeat(np.arange(n), terms.value_lengths().to_numpy(zero_copy_only=False))
        known, code = np.unique(terms.flatten().to_numpy(), return_inverse=True)
        per = asked.field("t").value_lengths().to_numpy(zero_copy_only=False)
        wanted = asked.field("t").flatten()
        term, idf = wanted.field("term").to_numpy(), wanted.field("idf").to_numpy()
        place = np.minimum(np.searchsorted(known, term), len(known) - 1)
        here = known[place] == term if len(known) else np.zeros(len(term), bool)
        weight = np.zeros(len(known))
        weight[place[here]] = idf[here]
        tf, length = docs.field("tf").flatten().to_numpy(), docs.field("len").to_numpy()
        w = weight[code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[at] / mean))
        used = np.nonzero(weight[code])[0]
        order = used[np.argsort(code[used], kind="stable")]
        at, w, cuts = at[order], w[order], np.searchsorted(code[order], np.arange(len(known) + 1))
        lists = [(at[x:y], w[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        often = [i for i in np.argsort(-np.diff(cuts), kind="stable")[:_WHOLE].tolist() if len(lists[i][0]) > n / 16]
        whole = {i: np.bincount(*lists[i], minlength=n) for i in often}
        own = np.split(place[here], np.cumsum(np.bincount(np.repeat(np.arange(len(per)), per)[here], minlength=len(per)))[:-1])
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        s = np.zeros(n)
        for q, mine in enumerate(own):
            if not len(mine):
                continue
            s[:] = 0
            for i in mine.tolist():
                if i in whole:
                    s += whole[i]
                else:
                    p, v = lists[i]
                    s[p] += v
            hit = np.nonzero(s >= max(_kth_bound(s[None], k)[0] - 1e-8, 1e-300))[0]
            best = hit[np.lexsort((hit, -np.round(s[hit], 9)))[:k]]
            out.append((np.full(len(best), q), best, s[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for several in batches:
            for j in range(several.num_rows):
                docs, asked = (several.slice(j, 1).column(x).flatten() for x in ("docs", "qs"))
                q, at, s = score(docs, asked)
                for x in range(0, len(q), 100_000):
                    q_, at_ = pa.array(q[x : x + 100_000]), pa.array(at[x : x + 100_000])
                    yield pa.RecordBatch.from_arrays([asked.field("i").take(q_), docs.field("i").take(at_), pa.array(s[x : x + 100_000])], ["i", "id", "score"])

    return run


def bm25(queries: DataFrame, query_id: str, query: str, corpus: DataFrame, id_: str, text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank): an index of the corpus, and a search in it."""
    return lexical_search(lexical_index(corpus, id_, text, k1, b), queries, query_id, query, id_, k)


def pool(dense: DataFrame, sparse: DataFrame, by: list[str], id_: str) -> DataFrame:
    """Dense hits, then the lexical hits that are not among them; ranked through. Dense hits carry their lexical rank."""
    lex = sparse.select(*by, id_, F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    both = dense.select(*by, id_, F.col("rank").alias("_r"), F.col("score")).join(lex, [*by, id_], "full")  # each side once
    order = F.col("_r").isNull(), F.coalesce("_r", "bm25_rank")
    return both.select(*by, id_, "score", "bm25_rank", "bm25_score", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("rank"))


def overlap_score(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct terms that the text has."""
    return _shared(_term_set(query), _term_set(text))


def _term_set(text: Column) -> Column:
    return F.array_distinct(_hashed_tokens(text))


def _shared(query: Column, text: Column) -> Column:
    return F.size(F.array_intersect(query, text)) / F.greatest(F.size(query), F.lit(1))


#: Of scorers that see a text only through something made of it alone: what is made, and the score of two such things.
PREPARED: dict[Callable[[Column, Column], Column], tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {overlap_score: (_term_set, _shared)}


def prepared(scorer: Callable[[Column, Column], Column]) -> tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]:
    """What is made of each text and query once, before they meet in hits, and the score of these; else the texts themselves."""
    return PREPARED.get(scorer, (lambda text: text, scorer))


def rerank(hits: DataFrame, by: list[str], score: Column, rank: str = "rank") -> DataFrame:
    """Hits ordered anew by a score, ties by the old rank, which stays as retrieval_rank.

    The hits are those of a pool already cut to k, so the score is not evaluated for others.
    """
    scored = hits.withColumn("rerank_score", score).withColumnRenamed(rank, "retrieval_rank")
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rerank_score"), "retrieval_rank")))


def model_score(scorer: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A column from any scorer of (query, text) batches, on Arrow batches."""

    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.tolist(), t.tolist()), dtype=float)

    return F.pandas_udf(score, T.DoubleType())


def rrf(lists: DataFrame, question: str, list_no: str, rank: str, id_: str, k: int, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (c + rank) over lists; ties by first list, then rank."""
    fused = lists.groupBy(question, id_).agg(
        F.aggregate(
            F.array_sort(F.collect_list(F.struct(F.col(list_no).alias("l"), F.col(rank).alias("r")))),
            F.lit(0.0),
            lambda s, x: s + F.lit(1.0) / (F.lit(float(c)) + x["r"]),
        ).alias("rrf_score"),
        F.min(F.struct(list_no, rank)).alias("_first"),
    )
    return top(fused, [question], [F.desc("rrf_score"), F.col("_first"), F.asc(id_)], k).drop("_first")


def round_robin(lists: DataFrame, question: str, list_no: str, rank: str, id_: str, k: int) -> DataFrame:
    """All first places, then all second places, and so on; the first occurrence counts."""
    fused = lists.groupBy(question, id_).agg(F.min(F.struct(rank, list_no)).alias("_first"))
    return top(fused, [question], [F.col("_first"), F.asc(id_)], k, "fused_rank").drop("_first")


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed hashed counts of words, not normalised."""

    def spread(cells: pd.Series) -> pd.Series:
        out = []
        for c in cells:
            n = np.bincount(np.asarray(c, dtype=np.int64), minlength=2 * dims) if c is not None and len(c) else np.zeros(2 * dims)
            out.append((n[:dims] - n[dims:]).astype(np.float32))
        return pd.Series(out, index=cells.index)

    cells = F.transform(index_tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dims)))
    return F.pandas_udf(spread, T.ArrayType(T.FloatType()))(cells)


def letter_counts(text: Column) -> Column:
    """Another stand-in, all built-in: how often each of a to z stands in a text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = lambda t: F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])
    return bound(low, n)


def embedder(embed: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 64) -> Callable[[Column], Column]:
    """A column from any function of a list of texts to their vectors, called ``batch`` texts at a time. Null has no vector."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            there = texts.dropna()
            out: list = []
            for i in range(0, len(there), batch):
                out.extend(list(map(float, v)) for v in embed(there.iloc[i : i + batch].tolist()))
            yield pd.Series(out, index=there.index, dtype=object).reindex(texts.index).map(lambda v: v if isinstance(v, list) else None)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))


def missing_vectors(texts: DataFrame, text: str, cache: DataFrame, model: str) -> DataFrame:
    """(text_hash, text): the distinct texts that the cache (model, text_hash, vec) does not hold for a model."""
    hashed = texts.select(F.sha2(F.col(text), 256).alias("text_hash"), F.col(text).alias("text")).filter("text is not null").groupBy("text_hash").agg(F.first("text").alias("text"))
    return hashed.join(cache.filter(F.col("model") == model).select("text_hash"), "text_hash", "left_anti")


def embed_cached(texts: DataFrame, text: str, cache: DataFrame, model: str, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(``texts`` with vec, the new rows of the cache): only texts that the cache lacks are embedded, each once.

    The new rows (model, text_hash, vec) are a written table; append them to the cache (``collections.append_missing``).
    """
    new = cut(missing_vectors(texts, text, cache, model).select(F.lit(model).alias("model"), "text_hash", embed(F.col("text")).alias("vec")))
    known = cache.filter(F.col("model") == model).groupBy("text_hash").agg(F.first("vec").alias("vec")).unionByName(new.select("text_hash", "vec"))
    joined = texts.withColumn("_h", F.sha2(F.col(text), 256))
    return joined.join(known.withColumnRenamed("text_hash", "_h"), "_h", "left").drop("_h"), new
