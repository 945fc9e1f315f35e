"""Ranking queries over chunks, vectors and questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmill.functions import text as tx
from siltmill.operators import ann, questions, ranking
from siltmill.plans.corpus_queries import _STOP
from siltmill.runtime import table

#: Every twentieth row is a query, against all rows.
EVERY = 20
K = 10


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each id: the first by text and url, should there be several."""
    rows = table(spark, sf_dir, "chunks").filter("id is not null and text is not null")
    return rows.groupBy("id").agg(F.min(F.struct("text", "url")).alias("c")).select("id", "c.text", "c.url")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").filter("id is not null and question is not null").groupBy(F.col("id").alias("item")).agg(F.min("question").alias("question"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors by cosine."""
    v = table(spark, sf_dir, "embeddings")
    found = ranking.exact_search(v.filter(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query"), "query", "embedding", v, "vec_id", "embedding", K)
    return found.select("query", "vec_id", F.round("sim", 5).alias("sim"), "rank")


_DENSE = """
WITH s AS (SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS sim
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT query, vec_id, round(sim, 5) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors among those with a label in a range: the filter comes before the ranking."""
    v = table(spark, sf_dir, "embeddings")
    q = v.filter(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query")
    found = ranking.exact_search(q, "query", "embedding", v.filter((F.col("label") >= 2) & (F.col("label") != 5)), "vec_id", "embedding", K)
    return found.select("query", "vec_id", F.round("sim", 5).alias("sim"), "rank")


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the exact neighbours that the approximate index finds."""
    v = table(spark, sf_dir, "embeddings")
    q = v.filter(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query")
    near = ann.search(ann.build(v, "vec_id", "embedding"), q, "query", "embedding", K)
    true = ranking.exact_search(q, "query", "embedding", v, "vec_id", "embedding", K)
    both = true.join(near.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    return both.agg(F.count_distinct("query").alias("n_queries"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of each question by Okapi scores."""
    found = ranking.bm25(_items(spark, sf_dir), "item", "question", _chunks(spark, sf_dir), "id", "text", K)
    return found.select("item", "id", F.round("score", 6).alias("score"), "rank")


def _bm25_sql(queries: str, k: int = K) -> str:
    """CTEs ending in ``hits`` (item, list_no, id, score, rank); ``queries`` is a CTE body of (item, list_no, query)."""
    tokens = rf"list_filter(regexp_extract_all(lower(nfc_normalize(replace({{x}}, chr(64257), 'fi'))), '[\p{{{{L}}}}\p{{{{N}}}}_]+'), lambda w: w NOT IN ({_STOP}))"
    return f"""
docs AS (SELECT id, min(text) AS text FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id),
tok AS (SELECT id, {tokens.format(x='text')} AS t FROM docs),
st AS (SELECT CAST(count(*) AS DOUBLE) AS nd, avg(len(t)) AS al FROM tok),
tf AS (SELECT id, term, len, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qs AS ({queries}),
qt AS (SELECT DISTINCT item, list_no, unnest({tokens.format(x='query')}) AS term FROM qs),
w AS (SELECT term, id, ln((nd - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al)) AS w FROM tf JOIN dfs USING (term), st),
sc AS (SELECT item, list_no, id, sum(w) AS score FROM qt JOIN w USING (term) GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY item, list_no ORDER BY round(score, 9) DESC, id) AS rank FROM sc QUALIFY rank <= {k})"""


_Q_ALL = "SELECT id AS item, 0 AS list_no, min(question) AS query FROM eval_items WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY id"
BM25_TOPK = f"WITH {_bm25_sql(_Q_ALL)} SELECT item, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits"


def split_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches of each question: its parts where it is compound."""
    return questions.searches(_items(spark, sf_dir), "item", "question", split=True, drop_vague=True)


_QMARK = r"regexp_replace(regexp_replace(regexp_replace(q, '([?.!])\s+', chr(1) || '\1' || chr(2), 'g'), '\s+[—–-]\s+', chr(2), 'g'), ',\s+(?:and\s+|but\s+|so\s+)?((?:can|could|does|do|did|is|am|are|will|would|should|what|how)\b)', chr(2) || '\1', 'gi')"
_SPLIT = rf"""
q0 AS (SELECT id AS item, min(question) AS q FROM eval_items WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY id),
q1 AS (SELECT item, q, list_transform(string_split(replace({_QMARK}, chr(1), ''), chr(2)), lambda p: regexp_replace(p, '^[ ,;?]+|[ ,;?]+$', '', 'g')) AS p FROM q0),
q2 AS (SELECT item, q, list_filter(p, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) >= 4) AS p FROM q1),
q3 AS (SELECT item, q, CASE WHEN len(p) >= 2 THEN list_filter(p, lambda x: len(list_filter(regexp_extract_all(lower(x), '[a-z'']+'), lambda w: w NOT IN ({_STOP}))) >= 3) ELSE [] END AS p FROM q2),
q4 AS (SELECT item, CASE WHEN len(p) >= 2 THEN p ELSE [q] END AS p FROM q3)"""
SPLIT_QUESTIONS = f"WITH {_SPLIT} SELECT item, CAST(unnest(range(len(p))) AS INTEGER) AS list_no, unnest(p) AS query FROM q4"


def _lists(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """A lexical ranking for each search of each question."""
    q = split_questions(spark, sf_dir).withColumn("q", F.struct("item", "list_no"))
    found = ranking.bm25(q, "q", "query", _chunks(spark, sf_dir), "id", "text", k)
    return found.select("q.item", "q.list_no", "id", "score", "rank")


_LISTS = f"{_SPLIT}, {_bm25_sql('SELECT item, unnest(range(len(p))) AS list_no, unnest(p) AS query FROM q4')}"


def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of a question's searches, fused by reciprocal ranks."""
    return ranking.rrf(_lists(spark, sf_dir), "item", "list_no", "rank", "id", K).select("item", "id", F.round("rrf_score", 9).alias("rrf_score"), "rank")


RRF = f"""WITH {_LISTS},
f AS (SELECT item, id, list_sum(list_transform(list_sort(list(struct_pack(l := list_no, r := rank))), lambda x: 1.0::DOUBLE / (60.0 + x.r))) AS s, min(struct_pack(l := list_no, r := rank)) AS o FROM hits GROUP BY ALL)
SELECT item, id, round(s, 9) AS rrf_score, CAST(row_number() OVER (PARTITION BY item ORDER BY s DESC, o, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10"""


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of a question's searches, fused by turns."""
    return ranking.round_robin(_lists(spark, sf_dir), "item", "list_no", "rank", "id", K).select("item", "id", F.col("fused_rank").alias("rank"))


ROUND_ROBIN = f"""WITH {_LISTS},
f AS (SELECT item, id, min(struct_pack(r := rank, l := list_no)) AS o FROM hits GROUP BY ALL)
SELECT item, id, CAST(row_number() OVER (PARTITION BY item ORDER BY o, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10"""


def hybrid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of the dense hits, by letter counts of whole texts, and the lexical hits that are not among them."""
    items, chunks = _items(spark, sf_dir), _chunks(spark, sf_dir)
    dense = ranking.exact_search(
        items.select("item", ranking.letter_counts(F.col("question")).alias("v")), "item", "v", chunks.select("id", ranking.letter_counts(F.col("text")).alias("v")), "id", "v", K
    ).withColumnRenamed("sim", "score")
    sparse = ranking.bm25(items, "item", "question", chunks, "id", "text", K)
    return ranking.pool(dense, sparse, ["item"], "id").select("item", "id", "rank", "bm25_rank")


_LETTERS = "list_transform(string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z', ','), lambda c: CAST(length({x}) - length(replace({x}, c, '')) AS DOUBLE))"
HYBRID_CANDIDATES = f"""WITH {_bm25_sql(_Q_ALL)},
qv AS (SELECT item, {_LETTERS.format(x="lower(query)")} AS v FROM qs), dv AS (SELECT id, {_LETTERS.format(x="lower(text)")} AS v FROM docs),
sim AS (SELECT item, id, round(list_cosine_similarity(qv.v, dv.v), 12) AS sim FROM qv, dv WHERE list_sum(qv.v) > 0 AND list_sum(dv.v) > 0),
a AS (SELECT item, id, row_number() OVER (PARTITION BY item ORDER BY sim DESC, id) AS rank FROM sim QUALIFY rank <= {K}),
p AS (SELECT a.item, a.id, 0 AS src, a.rank AS r, b.rank AS bm25_rank FROM a LEFT JOIN hits b ON a.item = b.item AND a.id = b.id
      UNION ALL SELECT item, id, 1, rank, rank FROM hits ANTI JOIN a USING (item, id))
SELECT item, id, CAST(row_number() OVER (PARTITION BY item ORDER BY src, r) AS INTEGER) AS rank, CAST(bm25_rank AS INTEGER) AS bm25_rank FROM p"""


def dense_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of the dense hits, by hashed vectors of whole texts, and the lexical hits that are not among them."""
    items, chunks = _items(spark, sf_dir), _chunks(spark, sf_dir)
    dense = ranking.exact_search(
        items.select("item", ranking.hashed_vector(F.col("question")).alias("v")), "item", "v", chunks.select("id", ranking.hashed_vector(F.col("text")).alias("v")), "id", "v", K
    ).withColumnRenamed("sim", "score")
    sparse = ranking.bm25(items, "item", "question", chunks, "id", "text", K)
    return ranking.pool(dense, sparse, ["item"], "id").select("item", "id", F.round("score", 5).alias("sim"), "rank", "bm25_rank")


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits reranked by the share of the question's terms that they have."""
    items, chunks = _items(spark, sf_dir), _chunks(spark, sf_dir)
    hits = ranking.bm25(items, "item", "question", chunks, "id", "text", K).join(items, "item").join(chunks, "id")
    out = ranking.rerank(hits, ["item"], ranking.overlap_score(F.col("question"), F.col("text")))
    return out.select("item", "id", F.round("rerank_score", 6).alias("rerank_score"), "retrieval_rank", "rank")


_TERMS = rf"list_filter(regexp_extract_all(lower(nfc_normalize(replace({{x}}, chr(64257), 'fi'))), '[\p{{{{L}}}}\p{{{{N}}}}_]+'), lambda w: w NOT IN ({_STOP}))"
RERANK_OVERLAP = f"""WITH {_bm25_sql(_Q_ALL)},
x AS (SELECT h.item, h.id, h.rank, list_distinct({_TERMS.format(x='qs.query')}) AS q, {_TERMS.format(x='docs.text')} AS t FROM hits h JOIN qs ON qs.item = h.item JOIN docs ON docs.id = h.id),
s AS (SELECT item, id, rank AS retrieval_rank, len(list_intersect(q, t)) / greatest(len(q), 1) AS rerank_score FROM x)
SELECT item, id, round(rerank_score, 6) AS rerank_score, CAST(retrieval_rank AS INTEGER) AS retrieval_rank,
       CAST(row_number() OVER (PARTITION BY item ORDER BY rerank_score DESC, retrieval_rank) AS INTEGER) AS rank FROM s"""


def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrieval plan for all questions at once: searches, pools, reranking, fusion, collapse to pages.

    No copies are folded, nothing is expanded and there is no second hop here: those are settings of the operator.
    """
    return questions.retrieve(_items(spark, sf_dir), "item", "question", _chunks(spark, sf_dir), k=K)


_ALL = {
    "dense_topk": (dense_topk, _DENSE.format(where="")), "dense_topk_filtered": (dense_topk_filtered, _DENSE.format(where="AND v.label >= 2 AND v.label <> 5")),
    "ann_recall": (ann_recall, None), "bm25_topk": (bm25_topk, BM25_TOPK), "split_question": (split_questions, SPLIT_QUESTIONS), "rrf": (rrf, RRF),
    "round_robin": (round_robin, ROUND_ROBIN), "hybrid_candidates": (hybrid_candidates, HYBRID_CANDIDATES), "dense_candidates": (dense_candidates, None), "rerank_overlap": (rerank_overlap, RERANK_OVERLAP),
    "retrieve": (retrieve, None),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}
