"""Scoring queries over recorded results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmill.functions.text import norm_text, quote_fragments
from siltmill.functions.urls import match_url
from siltmill.operators import scoring
from siltmill.runtime import table

#: norm_text in SQL, of {x}. DuckDB has no compatibility composition: canonical composition, and the one compatibility letter that these tables hold.
_NORM = r"' ' || array_to_string(regexp_extract_all(lower(nfc_normalize(replace(coalesce({x}, ''), chr(64257), 'fi'))), '[\p{{L}}\p{{N}}_]+'), ' ') || ' '"


def _norm(x: str) -> str:
    return _NORM.format(x=x)


def _fragments(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '\\.\\.\\.|…'), lambda p: {_norm('p')}), lambda f: trim(f) <> '')"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result with its item's gold passages, scored anew."""
    rows = table(spark, sf_dir, "e2e_rows").select("run_id", "id", "category", "chunks").distinct()
    items = table(spark, sf_dir, "eval_items").select("id", "gold_passages", "split").distinct()
    both = rows.join(items, "id")
    texts = F.transform("chunks", lambda c: norm_text(c["text"]))
    both = both.filter("size(gold_passages) > 0").withColumn("_t", F.coalesce(texts, F.array().cast("array<string>")))
    ranks = scoring.quote_ranks(F.transform("gold_passages", lambda p: p["quote"]), F.col("_t"))
    urls = scoring.url_rank(F.transform("chunks", lambda c: c["url"]), F.transform("gold_passages", lambda p: p["url"]))
    out = both.select("run_id", "id", "category", "split", ranks.alias("passage_ranks"), urls.alias("first_url"))
    return out.withColumn("rank", scoring.worst(F.col("passage_ranks")))


_SCORED = f"""
r AS (SELECT DISTINCT run_id, id, category, chunks FROM e2e_rows),
i AS (SELECT DISTINCT id, gold_passages, split FROM eval_items WHERE len(gold_passages) > 0),
t AS (SELECT run_id, r.id, r.category, i.split, gold_passages, coalesce(chunks, []) AS c,
      list_transform(coalesce(chunks, []), lambda c: {_norm('c.text')}) AS texts FROM r JOIN i USING (id)),
f AS (SELECT *, list_transform(gold_passages, lambda p: list_transform({_fragments('p.quote')},
      lambda f: nullif(list_position(list_transform(texts, lambda t: contains(t, f)), TRUE), 0))) AS fr FROM t),
p AS (SELECT *, list_transform(fr, lambda a: CASE WHEN len(a) > 0 AND len(list_filter(a, lambda x: x IS NULL)) = 0 THEN list_max(a) END) AS passage_ranks FROM f),
scored AS (SELECT run_id, id, category, split, passage_ranks,
      nullif(list_position(list_transform(c, lambda x: list_contains(list_transform(gold_passages, lambda g: split_part(trim(coalesce(g.url, '')), '?', 1)),
             split_part(trim(coalesce(x.url, '')), '?', 1))), TRUE), 0) AS first_url,
      CASE WHEN len(list_filter(passage_ranks, lambda x: x IS NULL)) = 0 THEN list_max(passage_ranks) END AS rank FROM p)
"""


def score_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of each gold passage and of the worst, and the first gold url."""
    return _scored(spark, sf_dir).select("run_id", "id", F.array_join(F.transform("passage_ranks", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias("passage_ranks"), "rank", "first_url")


SCORE_QUOTES = f"""WITH {_SCORED}
SELECT run_id, id, array_to_string(list_transform(passage_ranks, lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',') AS passage_ranks,
       CAST(rank AS INTEGER) AS rank, CAST(first_url AS INTEGER) AS first_url FROM scored"""


def metrics_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates and reciprocal rank over all results, by category and by split, in one pass."""
    rows = _scored(spark, sf_dir)
    found = scoring.metrics_by(rows, "rank", ["category", "split"])
    return found.select("level", "value", "n", *[F.round(c, 6).alias(c) for c in ("hit5", "hit50", "mrr")])


METRICS_BY_LEVEL = f"""WITH {_SCORED}
SELECT CASE WHEN GROUPING(category) = 0 THEN 'category' WHEN GROUPING(split) = 0 THEN 'split' ELSE 'all' END AS level,
       CASE WHEN GROUPING(category) = 0 THEN coalesce(category, '-') WHEN GROUPING(split) = 0 THEN coalesce(split, '-') ELSE 'all' END AS value,
       count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit5, round(avg(CASE WHEN rank <= 50 THEN 1.0 ELSE 0 END), 6) AS hit50,
       round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr
FROM scored GROUP BY GROUPING SETS ((category), (split), ())"""


def multihop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of items with more than one gold passage."""
    rows = _scored(spark, sf_dir).filter("size(passage_ranks) > 1").withColumn("item", F.concat_ws("/", "run_id", "id"))
    m = scoring.multihop_metrics(rows, "item", "passage_ranks")
    return m.select("num_items", *[F.round(c, 6).alias(c) for c in m.columns if c != "num_items"])


MULTIHOP = f"""WITH {_SCORED},
m AS (SELECT *, list_filter(passage_ranks, lambda x: x IS NOT NULL) AS h FROM scored WHERE len(passage_ranks) > 1),
k AS (SELECT rank AS last, list_min(h) AS first, len(list_filter(h, lambda x: x <= 5)) / len(passage_ranks) AS r5,
      len(list_filter(h, lambda x: x <= 10)) / len(passage_ranks) AS r10, coalesce(list_sum(list_transform(h, lambda x: 1.0 / x)), 0) AS inv, len(passage_ranks) AS n FROM m)
SELECT count(*) AS num_items,
  {', '.join(f"round(avg(CASE WHEN last <= {k} THEN 1.0 ELSE 0 END), 6) AS joint_hit{k}" for k in (5, 10, 50))},
  {', '.join(f"round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0 END), 6) AS hit{k}" for k in (5, 10, 50))},
  round(avg(r5), 6) AS passage_recall5, round(avg(r10), 6) AS passage_recall10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr_first,
  round(avg(coalesce(1.0 / last, 0)), 6) AS mrr_joint, round(sum(inv) / sum(n), 6) AS passage_mrr FROM k"""


def miss_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and kinds of misses by run: page not indexed, quote in no chunk, not retrieved, retrieved late."""
    scored = _scored(spark, sf_dir)
    items = table(spark, sf_dir, "eval_items").select("id", F.explode("gold_passages").alias("g")).distinct()
    chunks = table(spark, sf_dir, "chunks")
    urls = chunks.select(F.explode(F.concat(F.array("url"), F.coalesce("also_urls", F.array().cast("array<string>")))).alias("u"))
    missing = scoring.uncovered(items.select(F.col("g.url").alias("u")), "u", urls, "u")
    unindexed = items.select("id", match_url(F.col("g.url")).alias("url")).join(missing, "url", "left_semi").select("id").distinct().withColumn("unindexed", F.lit(True))
    parts = items.select("id", F.explode(quote_fragments(F.col("g.quote"))).alias("f")).distinct()
    normal = chunks.filter("text is not null").select(norm_text(F.col("text")).alias("t")).distinct()
    inside = scoring.contained_anywhere(parts, "f", normal, "t")
    nowhere = parts.join(inside, "f", "left_anti").select("id").distinct().withColumn("nowhere", F.lit(True))
    rows = scored.join(unindexed, "id", "left").join(nowhere, "id", "left")
    group = scoring.miss_group(F.col("rank"), F.col("unindexed").isNull(), F.col("nowhere").isNull())
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), *scoring.miss_counts(group))


MISS_GROUPS = f"""WITH {_SCORED},
g AS (SELECT DISTINCT id, unnest(gold_passages) AS g FROM i),
u AS (SELECT DISTINCT split_part(trim(coalesce(x, '')), '?', 1) AS url FROM (SELECT url AS x FROM chunks UNION ALL SELECT unnest(also_urls) FROM chunks)),
un AS (SELECT DISTINCT id FROM g WHERE split_part(trim(coalesce(g.url, '')), '?', 1) NOT IN (SELECT url FROM u) AND trim(coalesce(g.url, '')) <> ''),
parts AS (SELECT DISTINCT id, unnest({_fragments('g.quote')}) AS f FROM g),
corpus AS (SELECT DISTINCT {_norm('text')} AS t FROM chunks WHERE text IS NOT NULL),
nw AS (SELECT DISTINCT id FROM parts WHERE NOT EXISTS (SELECT 1 FROM corpus WHERE contains(t, f))),
k AS (SELECT run_id, CASE WHEN rank <= 5 THEN 'hit' WHEN id IN (SELECT id FROM un) THEN '0' WHEN id IN (SELECT id FROM nw) THEN 'A'
      WHEN rank IS NULL OR rank > 50 THEN 'C' ELSE 'B' END AS m FROM scored)
SELECT run_id, count(*) AS n, count(*) FILTER (m = '0') AS miss_0, count(*) FILTER (m = 'A') AS miss_a, count(*) FILTER (m = 'B') AS miss_b,
       count(*) FILTER (m = 'C') AS miss_c FROM k GROUP BY run_id"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the index doesn't hold, among those of gold passages and those that were fetched."""
    gold = table(spark, sf_dir, "eval_items").select(F.explode("gold_passages.url").alias("u"))
    fetched = table(spark, sf_dir, "pages_manifest").filter("key is not null").select(F.explode(F.array("url", "final_url")).alias("u"))
    chunks = table(spark, sf_dir, "chunks")
    urls = chunks.select(F.explode(F.concat(F.array("url"), F.coalesce("also_urls", F.array().cast("array<string>")))).alias("u"))
    return scoring.uncovered(gold.unionByName(fetched), "u", urls, "u")


COVERAGE = """
WITH u AS (SELECT DISTINCT split_part(trim(coalesce(x, '')), '?', 1) AS url FROM (SELECT url AS x FROM chunks UNION ALL SELECT unnest(also_urls) FROM chunks)),
w AS (SELECT p.url AS x FROM (SELECT unnest(gold_passages) AS p FROM eval_items) UNION ALL SELECT unnest([url, final_url]) FROM pages_manifest WHERE key IS NOT NULL),
g AS (SELECT DISTINCT split_part(trim(coalesce(x, '')), '?', 1) AS url FROM w)
SELECT url FROM g WHERE url <> '' AND url NOT IN (SELECT url FROM u)"""


def passage_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of miss of each gold passage of the results, counted by run, for items with several passages."""
    scored = _scored(spark, sf_dir).filter("size(passage_ranks) > 1").select("run_id", "id", F.posexplode("passage_ranks").alias("p", "rank"))
    golds = table(spark, sf_dir, "eval_items").select("id", "gold_passages").distinct().select("id", F.posexplode("gold_passages").alias("p", "g"))
    rows = scored.join(golds.select("id", "p", F.col("g.url").alias("url"), F.col("g.quote").alias("quote")), ["id", "p"])
    chunks = table(spark, sf_dir, "chunks")
    urls = chunks.select(F.explode(F.concat(F.array("url"), F.coalesce("also_urls", F.array().cast("array<string>")))).alias("url"))
    normal = chunks.filter("text is not null").select(norm_text(F.col("text")).alias("t")).distinct()
    found = scoring.passage_misses(rows, "rank", "url", "quote", urls, normal, "t")
    return found.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), *scoring.miss_counts(F.col("miss")))


PASSAGE_MISSES = f"""WITH {_SCORED},
g0 AS (SELECT id, gold_passages FROM i WHERE len(gold_passages) > 1),
s AS (SELECT run_id, id, unnest(range(1, len(passage_ranks) + 1)) AS p, unnest(passage_ranks) AS rank FROM scored WHERE len(passage_ranks) > 1),
g AS (SELECT id, unnest(range(1, len(gold_passages) + 1)) AS p, unnest(gold_passages) AS g FROM g0),
u AS (SELECT DISTINCT split_part(trim(coalesce(x, '')), '?', 1) AS url FROM (SELECT url AS x FROM chunks UNION ALL SELECT unnest(also_urls) FROM chunks)),
corpus AS (SELECT DISTINCT {_norm('text')} AS t FROM chunks WHERE text IS NOT NULL),
q AS (SELECT DISTINCT unnest({_fragments('g.quote')}) AS f FROM g),
inside AS (SELECT f FROM q WHERE EXISTS (SELECT 1 FROM corpus WHERE contains(t, f))),
h AS (SELECT id, p, g.url AS url, {_fragments('g.quote')} AS fr FROM g),
fl AS (SELECT id, p, unnest(fr) AS f FROM h), bad AS (SELECT DISTINCT id, p FROM fl ANTI JOIN inside USING (f)),
held AS (SELECT h.id, h.p, h.url, len(fr) > 0 AND bad.id IS NULL AS ok FROM h LEFT JOIN bad ON bad.id = h.id AND bad.p = h.p),
k AS (SELECT run_id, CASE WHEN rank <= 5 THEN NULL WHEN split_part(trim(coalesce(held.url, '')), '?', 1) NOT IN (SELECT url FROM u) THEN '0' WHEN NOT ok THEN 'A' WHEN rank IS NULL OR rank > 50 THEN 'C' ELSE 'B' END AS m FROM s JOIN held USING (id, p))
SELECT run_id, count(*) AS n, count(*) FILTER (m = '0') AS miss_0, count(*) FILTER (m = 'A') AS miss_a, count(*) FILTER (m = 'B') AS miss_b, count(*) FILTER (m = 'C') AS miss_c FROM k GROUP BY run_id"""


def retrieval_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each result retrieved of its item's gold: by url, by whole quotes and by their fragments."""
    rows = table(spark, sf_dir, "e2e_rows").select("run_id", "id", "chunks").distinct()
    items = table(spark, sf_dir, "eval_items").select("id", "gold_passages").distinct()
    found = scoring.check_retrieval(rows.join(items, "id"), table(spark, sf_dir, "pages_manifest"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias(c)
    return found.select("run_id", "id", "url_retrieved", "url_rank", "quote_retrieved", shown("quote_ranks"), "quote_retrieved_fixed", shown("quote_ranks_fixed"))


RETRIEVAL_CHECK = f"""
WITH r AS (SELECT DISTINCT run_id, id, chunks FROM e2e_rows), i AS (SELECT DISTINCT id, gold_passages FROM eval_items),
m AS (SELECT content_hash, arg_max([url, final_url], seq) AS us FROM pages_manifest WHERE content_hash IS NOT NULL GROUP BY content_hash),
t AS (SELECT run_id, r.id, row_number() OVER () AS rw, coalesce(gold_passages, []) AS g, coalesce(chunks, []) AS c FROM r JOIN i USING (id)),
x AS (SELECT *, list_transform(c, lambda x: {_norm('x.text')}) AS texts FROM t),
gu AS (SELECT rw, unnest(g) AS p FROM t),
ok AS (SELECT rw, list(u) AS ok FROM (SELECT rw, unnest(list_concat([p.url], coalesce(us, []))) AS u FROM gu LEFT JOIN m ON m.content_hash = p.content_hash) WHERE u IS NOT NULL GROUP BY rw),
w AS (SELECT x.*, coalesce(ok.ok, []) AS ok,
      list_transform(g, lambda p: nullif(list_position(list_transform(texts, lambda t: contains(t, {_norm('p.quote')})), TRUE), 0)) AS whole,
      list_transform(g, lambda p: list_transform({_fragments('p.quote')}, lambda f: nullif(list_position(list_transform(texts, lambda t: contains(t, f)), TRUE), 0))) AS parts FROM x LEFT JOIN ok USING (rw)),
v AS (SELECT *, list_transform(parts, lambda a: CASE WHEN len(a) > 0 AND len(list_filter(a, lambda y: y IS NULL)) = 0 THEN list_max(a) END) AS fixed FROM w),
n AS (SELECT run_id, id, len(g) > 0 AS gold, list_filter(c, lambda y: list_contains(ok, y.url))[1].rank AS url_rank,
      list_transform(whole, lambda k: c[k].rank) AS q, list_transform(fixed, lambda k: c[k].rank) AS f FROM v)
SELECT run_id, id, CASE WHEN gold THEN url_rank IS NOT NULL END AS url_retrieved, CASE WHEN gold THEN url_rank END AS url_rank,
       CASE WHEN gold THEN len(list_filter(q, lambda y: y IS NULL)) = 0 END AS quote_retrieved, array_to_string(list_transform(q, lambda y: coalesce(CAST(y AS VARCHAR), '-')), ',') AS quote_ranks,
       CASE WHEN gold THEN len(list_filter(f, lambda y: y IS NULL)) = 0 END AS quote_retrieved_fixed, array_to_string(list_transform(f, lambda y: coalesce(CAST(y AS VARCHAR), '-')), ',') AS quote_ranks_fixed FROM n"""


def e2e_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts, grounding, retrieval and failures by run and category, with totals."""
    rows = table(spark, sf_dir, "e2e_rows").withColumn("error", F.col("error.stage")).select(
        "run_id", "id", "category", "verdict", "grounded", "quote_retrieved", "quote_retrieved_fixed", "error"
    ).distinct()
    kind = scoring.failure_type(F.col("error"), F.col("verdict"), F.col("grounded"), F.col("quote_retrieved"))
    out = rows.withColumn("kind", kind).rollup("run_id", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("quote_retrieved").alias("n_gold"),
        F.count_if(F.col("quote_retrieved")).alias("retrieved"),
        F.count_if(F.col("quote_retrieved_fixed")).alias("retrieved_fixed"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("correct", "partial", "incorrect")],
        F.count_if(F.col("grounded")).alias("n_grounded"),
        F.count("error").alias("errors"),
        *[F.count_if(F.col("kind") == v).alias(f"f_{v}") for v in ("retrieval", "reading", "hallucination")],
    )
    return out.withColumns({"run_id": F.coalesce("run_id", F.lit("TOTAL")), "category": F.coalesce("category", F.lit("TOTAL"))})


E2E_SUMMARY = """
WITH r AS (SELECT DISTINCT run_id, id, category, verdict, grounded, quote_retrieved, quote_retrieved_fixed, error.stage AS error FROM e2e_rows),
k AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN coalesce(verdict = 'correct' AND grounded, FALSE) THEN NULL
      WHEN coalesce(NOT quote_retrieved, FALSE) THEN 'retrieval' WHEN coalesce(verdict <> 'correct', TRUE) THEN 'reading' ELSE 'hallucination' END AS kind FROM r)
SELECT coalesce(run_id, 'TOTAL') AS run_id, coalesce(category, 'TOTAL') AS category, count(*) AS n, count(quote_retrieved) AS n_gold,
  count(*) FILTER (quote_retrieved) AS retrieved, count(*) FILTER (quote_retrieved_fixed) AS retrieved_fixed,
  count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'incorrect') AS incorrect,
  count(*) FILTER (grounded) AS n_grounded, count(error) AS errors, count(*) FILTER (kind = 'retrieval') AS f_retrieval,
  count(*) FILTER (kind = 'reading') AS f_reading, count(*) FILTER (kind = 'hallucination') AS f_hallucination
FROM k GROUP BY ROLLUP (run_id, category)"""


def queries() -> dict:
    return {f.__name__: f for f in (score_quotes, metrics_by_level, multihop, miss_groups, passage_misses, retrieval_check, coverage, e2e_summary)}


def oracle_sql() -> dict[str, str]:
    return {"score_quotes": SCORE_QUOTES, "metrics_by_level": METRICS_BY_LEVEL, "multihop": MULTIHOP, "miss_groups": MISS_GROUPS, "passage_misses": PASSAGE_MISSES, "retrieval_check": RETRIEVAL_CHECK, "coverage": COVERAGE, "e2e_summary": E2E_SUMMARY}
