"""Run ledger queries, with their SQL. Runs are those of the recorded results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmill.operators import ledger, scoring
from siltmill.plans.scoring_queries import _SCORED, _scored
from siltmill.runtime import table


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, set_hash): the fingerprint of the items that a run was made with."""
    rows = table(spark, sf_dir, "e2e_rows").select("run_id", "id").distinct()
    items = table(spark, sf_dir, "eval_items").select("id", "question", "gold_passages").distinct()
    return ledger.eval_set_fingerprint(rows.join(items, "id"), ["run_id"]).select("run_id", F.col("fingerprint").alias("set_hash"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _scored(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), *scoring.rank_metrics(F.col("rank")))
    return m.join(_fingerprints(spark, sf_dir), "run_id").withColumn("seq", F.col("run_id"))


_RUNS = f"""{_SCORED},
m AS (SELECT run_id, count(*) AS n, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS hit5, avg(coalesce(1.0 / rank, 0)) AS mrr FROM scored GROUP BY run_id),
it AS (SELECT DISTINCT e.run_id, concat_ws(chr(30), coalesce('=' || i.id, '-'), coalesce('=' || i.question, '-'), coalesce('=' || array_to_string(list_transform(i.gold_passages,
       lambda p: concat_ws(chr(31), coalesce('=' || p.url, '-'), coalesce('=' || p.content_hash, '-'), coalesce('=' || p.quote, '-'))), chr(29)), '-')) AS x
       FROM (SELECT DISTINCT run_id, id FROM e2e_rows) e JOIN (SELECT DISTINCT id, question, gold_passages FROM eval_items) i USING (id)),
ih AS (SELECT DISTINCT run_id, sha256(x) AS h FROM it),
fp AS (SELECT run_id, substr(sha256(concat_ws(':', CAST(count(*) AS VARCHAR), CAST(sum(CAST(CAST('0x' || substr(h, 1, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR),
       CAST(sum(CAST(CAST('0x' || substr(h, 13, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR))), 1, 12) AS set_hash FROM ih GROUP BY run_id),
runs AS (SELECT m.*, set_hash FROM m JOIN fp USING (run_id)),
firsts AS (SELECT set_hash, 'v' || row_number() OVER (ORDER BY min(run_id)) AS version FROM runs GROUP BY set_hash)"""


def run_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the version of their set of items, and whether it is another than that of the run before."""
    labelled = ledger.version_labels(_runs(spark, sf_dir), "set_hash", "seq")
    return ledger.version_starts(labelled, ["seq"]).select("run_id", "n", "set_hash", "version", "starts")


def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run of each version."""
    labelled = ledger.version_labels(_runs(spark, sf_dir).withColumns({"hit5": F.round("hit5", 6), "mrr": F.round("mrr", 6)}), "set_hash", "seq")
    return ledger.best_runs(labelled, ["version"], ["hit5", "mrr"], ["seq"]).select("version", "run_id", "hit5", "mrr")


BEST_RUN = f"""WITH {_RUNS} SELECT version, run_id, round(hit5, 6) AS hit5, round(mrr, 6) AS mrr FROM runs JOIN firsts USING (set_hash)
QUALIFY row_number() OVER (PARTITION BY version ORDER BY round(hit5, 6) DESC, round(mrr, 6) DESC, run_id) = 1"""


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of recorded runs as maps, from valid ledger lines; the first line of each run."""
    rows = table(spark, sf_dir, "runs_raw").filter("raw_record is not null").select(
        "ledger", "file_no", "line_no", F.from_json("raw_record", "run_id string, config map<string,string>, rag map<string,string>").alias("j")
    )
    rows = rows.select("ledger", F.col("j.run_id").alias("run_id"), "file_no", "line_no", F.coalesce("j.config", "j.rag").alias("config")).filter("run_id is not null and config is not null")
    return rows.groupBy("ledger", "run_id").agg(F.min_by("config", F.struct("file_no", "line_no")).alias("config"))


def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings in which each run differs from the run before."""
    rows = ledger.with_previous(_configs(spark, sf_dir), ["ledger"], ["run_id"], "config")
    return rows.select("ledger", "run_id", F.explode("config_diff").alias("setting", "d")).select("ledger", "run_id", "setting", F.col("d")[0].alias("old"), F.col("d")[1].alias("new"))


RUN_DIFF = r"""
WITH v AS (SELECT ledger, file_no, line_no, CAST(raw_record AS JSON) AS j FROM (SELECT * FROM runs_raw WHERE json_valid(raw_record)) WHERE json_type(CAST(raw_record AS JSON)) = 'OBJECT'),
r AS (SELECT ledger, json_extract_string(j, '$.run_id') AS run_id, file_no, line_no,
      CASE WHEN json_type(j, '$.config') = 'OBJECT' THEN json_extract(j, '$.config') WHEN json_type(j, '$.rag') = 'OBJECT' THEN json_extract(j, '$.rag') END AS c FROM v),
f AS (SELECT ledger, run_id, c FROM r WHERE run_id IS NOT NULL AND c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ledger, run_id ORDER BY file_no, line_no) = 1),
o AS (SELECT ledger, run_id, c, coalesce(lag(c) OVER (PARTITION BY ledger ORDER BY run_id), '{}') AS p FROM f),
k AS (SELECT ledger, run_id, c, p, unnest(list_distinct(list_concat(json_keys(c), json_keys(p)))) AS setting FROM o)
SELECT ledger, run_id, setting, json_extract_string(p, '$."' || setting || '"') AS old, json_extract_string(c, '$."' || setting || '"') AS new
FROM k WHERE old IS DISTINCT FROM new"""


def _two(spark: SparkSession, sf_dir: str) -> list[str]:
    """The last two runs, the default of a comparison."""
    last = table(spark, sf_dir, "e2e_rows").select("run_id").distinct().orderBy(F.desc("run_id")).limit(2)
    return sorted(r[0] for r in last.collect())


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that improved or got worse between the last two runs."""
    a, b = _two(spark, sf_dir)
    return ledger.compare(_scored(spark, sf_dir), "run_id", "id", "rank", F.lit(a), F.lit(b))


_LAST = "(SELECT run_id FROM (SELECT DISTINCT run_id FROM e2e_rows) ORDER BY run_id DESC LIMIT 1 OFFSET {n})"
COMPARE_RUNS = f"""WITH {_SCORED},
a AS (SELECT id, rank FROM scored WHERE run_id = {_LAST.format(n=1)}), b AS (SELECT id, rank FROM scored WHERE run_id = {_LAST.format(n=0)})
SELECT coalesce(a.id, b.id) AS id, CAST(a.rank AS INTEGER) AS rank1, CAST(b.rank AS INTEGER) AS rank2,
  CASE WHEN b.id IS NULL THEN 'only_first' WHEN a.id IS NULL THEN 'only_second' WHEN coalesce(b.rank, 2147483647) < coalesce(a.rank, 2147483647) THEN 'improved'
  WHEN coalesce(b.rank, 2147483647) > coalesce(a.rank, 2147483647) THEN 'worse' ELSE 'unchanged' END AS change
FROM a FULL OUTER JOIN b ON a.id = b.id"""


def pivot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks of all items in the last two runs, side by side."""
    a, b = _two(spark, sf_dir)
    return ledger.pivot_runs(_scored(spark, sf_dir), "run_id", "id", F.col("rank"), [a, b]).withColumnsRenamed({a: "before", b: "after"})


PIVOT_RUNS = f"""WITH {_SCORED},
a AS (SELECT id, coalesce(CAST(rank AS VARCHAR), '-') AS r FROM scored WHERE run_id = {_LAST.format(n=1)}), b AS (SELECT id, coalesce(CAST(rank AS VARCHAR), '-') AS r FROM scored WHERE run_id = {_LAST.format(n=0)})
SELECT coalesce(a.id, b.id) AS id, coalesce(a.r, 'n/a') AS before, coalesce(b.r, 'n/a') AS after FROM a FULL OUTER JOIN b ON a.id = b.id"""


def run_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks of all items in all runs."""
    return ledger.run_ranks(_scored(spark, sf_dir), "run_id", "id", F.col("rank"))


RUN_RANKS = f"""WITH {_SCORED}, c AS (SELECT DISTINCT id, run_id, run_id || '=' || coalesce(CAST(rank AS VARCHAR), '-') AS v FROM scored)
SELECT id, string_agg(v, ' ' ORDER BY run_id, v) AS runs, count(DISTINCT run_id) AS n_runs FROM c GROUP BY id"""


def best_multihop_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of each version with the best joint hits of items with several passages, then the best joint rank, then the earliest."""
    rows = _scored(spark, sf_dir).filter("size(passage_ranks) > 1")
    joint = rows.groupBy("run_id").agg(F.round(F.avg(F.coalesce((F.col("rank") <= 5).cast("int"), F.lit(0))), 6).alias("joint_hit5"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr_joint"))
    labelled = ledger.version_labels(joint.join(_fingerprints(spark, sf_dir), "run_id"), "set_hash", "run_id")
    return ledger.best_runs(labelled, ["version"], ["joint_hit5", "mrr_joint"], ["run_id"]).select("version", "run_id", "joint_hit5", "mrr_joint")


BEST_MULTIHOP_RUN = f"""WITH {_RUNS},
j AS (SELECT run_id, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS joint_hit5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr_joint FROM scored WHERE len(passage_ranks) > 1 GROUP BY run_id),
jf AS (SELECT set_hash, 'v' || row_number() OVER (ORDER BY min(run_id)) AS version FROM j JOIN fp USING (run_id) GROUP BY set_hash)
SELECT version, run_id, joint_hit5, mrr_joint FROM j JOIN fp USING (run_id) JOIN jf USING (set_hash) QUALIFY row_number() OVER (PARTITION BY version ORDER BY joint_hit5 DESC, mrr_joint DESC, run_id) = 1"""


def visible_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items outside the held-out split."""
    return ledger.visible(table(spark, sf_dir, "eval_items").select("id", "split").distinct(), "split")


def item_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in only one of the last two runs."""
    a, b = _two(spark, sf_dir)
    rows = table(spark, sf_dir, "e2e_rows").select("run_id", "id").distinct()
    one, two = rows.filter(F.col("run_id") == a).select("id"), rows.filter(F.col("run_id") == b).select("id")
    return one.exceptAll(two).withColumn("side", F.lit("first")).unionByName(two.exceptAll(one).withColumn("side", F.lit("second"))).unionByName(one.intersect(two).withColumn("side", F.lit("both")))


ITEM_SETS = f"""WITH a AS (SELECT DISTINCT id FROM e2e_rows WHERE run_id = {_LAST.format(n=1)}), b AS (SELECT DISTINCT id FROM e2e_rows WHERE run_id = {_LAST.format(n=0)})
SELECT id, 'first' AS side FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT id, 'second' FROM (SELECT id FROM b EXCEPT SELECT id FROM a)
UNION ALL SELECT id, 'both' FROM (SELECT id FROM a INTERSECT SELECT id FROM b)"""

_ALL = {
    "run_versions": (run_versions, f"WITH {_RUNS} SELECT run_id, n, set_hash, version, coalesce(version IS DISTINCT FROM lag(version) OVER (ORDER BY run_id), TRUE) AS starts FROM runs JOIN firsts USING (set_hash)"), "best_run": (best_run, BEST_RUN),
    "run_diff": (run_diff, RUN_DIFF), "compare_runs": (compare_runs, COMPARE_RUNS), "pivot_runs": (pivot_runs, PIVOT_RUNS), "run_ranks": (run_ranks, RUN_RANKS), "best_multihop_run": (best_multihop_run, BEST_MULTIHOP_RUN),
    "visible_items": (visible_items, "SELECT DISTINCT id, split FROM eval_items WHERE split IS DISTINCT FROM 'test'"), "item_sets": (item_sets, ITEM_SETS),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}
