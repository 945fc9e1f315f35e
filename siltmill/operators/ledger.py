"""The run ledger: versions of evaluation sets, differences of settings, best runs, comparisons, pivots, appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands for a rank that is missing, in comparisons.
NEVER = 2147483647


def item_text(id_: Column, question: Column, gold: Column) -> Column:
    """One text for what identifies an item: id, question and gold passages in order. Null differs from ''."""
    shown = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    passages = F.transform(gold, lambda p: F.concat_ws("\x1f", shown(p["url"]), shown(p["content_hash"]), shown(p["quote"])))
    return F.concat_ws("\x1e", shown(id_), shown(question), shown(F.array_join(passages, "\x1d")))


def eval_set_fingerprint(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, fingerprint, n_items): 12 hex digits over the distinct ids, questions and gold passages of a set.

    Items are hashed one by one, and the hashes added up, so nothing is gathered and the order of rows is of no account.
    """
    by = by or []
    hashed = items.select(*by, F.sha2(item_text(F.col("id"), F.col("question"), F.col("gold_passages")), 256).alias("h")).distinct()
    part = lambda at: F.sum(F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(30,0)")).cast("string")
    folded = F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1), part(13))
    return hashed.groupBy(*by).agg(F.substring(F.sha2(folded, 256), 1, 12).alias("fingerprint"), F.count(F.lit(1)).alias("n_items"))


def version_labels(runs: DataFrame, hash_: str, seq: str) -> DataFrame:
    """Runs with ``version``: v1, v2, … by the first appearance of the set's hash; none for a null hash."""
    first = runs.filter(F.col(hash_).isNotNull()).groupBy(hash_).agg(F.min(seq).alias("_first"))
    numbered = first.select(hash_, F.concat(F.lit("v"), F.row_number().over(Window.orderBy("_first")).cast("string")).alias("version"))  # a row for each version
    return runs.join(numbered, hash_, "left")


def version_starts(runs: DataFrame, order: list[str], version: str = "version") -> DataFrame:
    """Runs with ``starts``: whether a run's version is another than that of the run before it. The first starts one."""
    w = Window.orderBy(*order)  # a row for each run
    return runs.withColumn("starts", F.coalesce(~F.col(version).eqNullSafe(F.lag(version).over(w)) | (F.row_number().over(w) == 1), F.lit(True)))


def config_diff(old: Column, new: Column) -> Column:
    """Map of the settings that differ to [old, new]; a missing side is null."""
    both = F.map_zip_with(old, new, lambda k, a, b: F.array(a, b))
    return F.map_filter(both, lambda k, v: ~v[0].eqNullSafe(v[1]))


def with_previous(runs: DataFrame, group: list[str], order: list[str], config: str) -> DataFrame:
    """Runs with ``config_diff`` against the run before; the first differs in everything from nothing."""
    w = Window.partitionBy(*group).orderBy(*order)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return runs.withColumn("config_diff", config_diff(F.coalesce(F.lag(config).over(w), none), F.col(config)))


def best_runs(runs: DataFrame, group: list[str], scores: list[str], seq: list[str]) -> DataFrame:
    """The best run of each group: by the scores in turn, then the earliest. Runs without the first score are out."""
    order = [F.desc_nulls_last(s) for s in scores] + [F.asc(s) for s in seq]
    w = Window.partitionBy(*group).orderBy(*order)
    return runs.filter(F.col(scores[0]).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def compare(rows: DataFrame, run: str, item: str, rank: str, first: Column, second: Column) -> DataFrame:
    """One row for each item of either run: both ranks and improved, worse, unchanged or only_first, only_second.

    One full outer join; a missing rank is worse than any.
    """
    side = lambda which, name: rows.filter(F.col(run) == which).select(item, F.col(rank).alias(name), F.lit(True).alias(f"in_{name}"))
    both = side(first, "rank1").join(side(second, "rank2"), item, "full_outer")
    a, b = F.coalesce("rank1", F.lit(NEVER)), F.coalesce("rank2", F.lit(NEVER))
    change = F.when(F.col("in_rank2").isNull(), "only_first").when(F.col("in_rank1").isNull(), "only_second").when(b < a, "improved").when(b > a, "worse").otherwise("unchanged")
    return both.select(item, "rank1", "rank2", change.alias("change"))


def pivot_runs(rows: DataFrame, run: str, item: str, value: Column, runs: list[str]) -> DataFrame:
    """One row for each item, a column for each of the named runs; n/a where the run lacks the item."""
    shown = F.coalesce(value.cast("string"), F.lit("-"))
    wide = rows.filter(F.col(run).isin(runs)).groupBy(item).pivot(run, runs).agg(F.first(shown))
    return wide.fillna("n/a", subset=runs)


def run_ranks(rows: DataFrame, run: str, item: str, value: Column) -> DataFrame:
    """(item, runs, n_runs): the values of an item in all runs that have it, in order of runs, as ``run=value`` texts.

    The wide table of any number of runs, without the empty cells.
    """
    cell = F.struct(F.col(run).alias("run"), F.concat(F.col(run), F.lit("="), F.coalesce(value.cast("string"), F.lit("-"))).alias("v"))
    cells = F.array_sort(F.collect_set(cell))  # one for each run
    return rows.groupBy(item).agg(F.array_join(F.transform(cells, lambda c: c["v"]), " ").alias("runs"), F.count_distinct(run).alias("n_runs"))


def visible(rows: DataFrame, split: str, show_test: bool = False) -> DataFrame:
    """Rows without the held-out split, unless asked for."""
    return rows if show_test else rows.filter(~F.col(split).eqNullSafe(F.lit("test")))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(gold, predicted, n, accuracy): counts, with the share of all rows that agree."""
    n = rows.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    hit = F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0)).over(everything)
    return n.withColumn("accuracy", hit / F.sum("n").over(everything))


def rescore(old: DataFrame, new: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Adds metrics that a run lacks; those it has stay."""
    fresh = new.select(key, *[F.col(m).alias(f"_{m}") for m in metrics])
    joined = old.join(fresh, key, "left")
    have = set(old.columns)
    for m in metrics:
        joined = joined.withColumn(m, F.coalesce(F.col(m), F.col(f"_{m}")) if m in have else F.col(f"_{m}"))
    return joined.drop(*[f"_{m}" for m in metrics])
