"""Mix sources to target weights by capped water-filling.

Each source may contribute its size times its cap. Sources whose target share of the total exceeds that are clamped
at it, their excess weight goes to the others in proportion to their targets, and so on until none exceeds its cap.
That is one pass over the sources in order of cap to weight: those before the level at which the rest fits are clamped.
A source's goal is then a number of whole passes over it and a part of one more. The part is drawn in the order of a
seeded hash of the key, up to the threshold at which the sizes add up to it; records too large for what is then left
are passed over, so a very large one doesn't leave a source short. No record is repeated while another of its source
is left out: a source's most repeats are its passes, rounded up.

The total, unless given, is what one pass over all sources with a target holds. Sources smaller than their share of
that are repeated, up to their caps; where a cap binds, the shares reached differ from the targets and are reported.

Defined results: a source that is null, or without target, takes no part; records without size take no part; sources
are compared trimmed and in lower case; targets need not add up to one; a source without records is reported with 0.
Rows repeated with the same key and source count once, the larger size counts. The table of targets may be of any
length. Gathered are sums by source, and by source and 14 bits of the hash, and the records of one such cell for each
source, so a source with a third of all rows is no heavier for a task than another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmill.runtime import cut

_BITS = 14


@dataclass(frozen=True)
class Mix:
    """``selection``: key, source, size, repeats. ``shares``: what was asked and reached, by source."""

    selection: DataFrame
    shares: DataFrame


def source_name(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def water_fill(sources: DataFrame, total: float | None = None) -> DataFrame:
    """``sources`` (source, weight, size, repeats) with goal and clamped: the size that each source contributes.

    The goals add up to ``total``, by default all sizes, or to what all caps allow if that is less. In order of cap to
    weight, the sources before the first whose cap is above the level of the rest are clamped. A row for each source.
    """
    cap = (F.col("size") * F.col("repeats")).cast("double")
    open_ = sources.withColumn("cap", F.when((F.col("weight") > 0) & (cap > 0), cap).otherwise(0.0))
    open_ = open_.withColumn("w", F.when(F.col("cap") > 0, F.col("weight").cast("double")).otherwise(0.0))
    all_ = Window.partitionBy()
    asked = F.sum(F.when(F.col("cap") > 0, F.col("size"))).over(all_).cast("double") if total is None else F.lit(float(total))
    before = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.orderBy("ratio", "source").rowsBetween(0, Window.unboundedFollowing)
    rows = open_.withColumn("ratio", F.col("cap") / F.nullif(F.col("w"), F.lit(0.0))).withColumn("total", F.least(asked, F.sum("cap").over(all_)))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onwards)
    rows = rows.withColumn("level", F.when(F.col("w") > 0, level)).withColumn("clamped", F.coalesce(F.col("ratio") <= F.col("level") * (1 + 1e-12), F.lit(False)))
    unit = F.min(F.when(~F.col("clamped") & (F.col("w") > 0), F.struct("ratio", "source", "level"))).over(all_)["level"]
    goal = F.when(F.col("w") == 0, 0.0).when(F.col("clamped"), F.col("cap")).otherwise(F.col("w") * unit)
    return rows.withColumn("goal", goal).select(*sources.columns, "goal", "clamped")


def goals(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, weight, repeats, size, goal, clamped) of each source in ``targets``; ``sized`` has source and size."""
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("weight"), F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(0))).alias("repeats"))
    wanted = wanted.filter("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max("repeats").alias("repeats"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("size"))
    return water_fill(wanted.join(sums, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("long")), total)


def mix(df: DataFrame, targets: DataFrame, key: str, source: str, size: Column, total: float | None = None, seed: int = 7) -> Mix:
    """``targets`` has source, target_share and max_repeats."""
    own = df.select(F.col(key).alias("key"), source_name(F.col(source)).alias("source"), *[c for c in df.columns if c not in (key, source, "key", "source")])
    taking = own.join(targets.select(source_name(F.col("source")).alias("source")).distinct(), "source", "left_semi")
    h = F.xxhash64(F.lit(seed), F.col("key"), F.col("source")).bitwiseAND(F.lit((1 << 63) - 1))
    sized = taking.select("key", "source", size.alias("size")).filter("key is not null and size > 0").groupBy("key", "source").agg(F.max("size").alias("size"))
    sized = cut(sized.withColumn("h", h))
    passes = F.col("goal") / F.col("size")
    whole = F.coalesce(F.least(F.col("repeats"), F.floor(passes + 1e-9)), F.lit(0)).cast("int")
    plan = goals(sized, targets, total).withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(0))
    plan = cut(plan.withColumn("need", F.greatest(F.lit(0.0), F.col("goal") - F.col("whole") * F.col("size"))))

    steps = _steps(sized, plan)
    extra = F.exists(F.coalesce("steps", F.array()), lambda s: (F.col("h") > s["after"]) & (F.col("h") <= s["upto"]) & (F.col("size") <= s["most"])).cast("int")
    by_source = plan.select("source", "whole").join(steps.groupBy("source").agg(F.collect_list(F.struct("after", "upto", "most")).alias("steps")), "source", "left")
    selection = sized.join(by_source, "source").select("key", "source", "size", (F.col("whole") + extra).alias("repeats")).filter("repeats > 0")
    reached = selection.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    shares = plan.join(reached, "source", "left").select(
        "source", F.col("weight").alias("target_share"), F.col("repeats").alias("max_repeats"), F.col("size").alias("available"), F.col("goal").alias("goal_tokens"), "clamped",
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        (F.coalesce("tokens", F.lit(0)) / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0))).alias("reached_share"),
    )
    return Mix(selection.withColumnRenamed("key", key), shares)


def _steps(sized: DataFrame, plan: DataFrame, short: float = 0.001) -> DataFrame:
    """(source, after, upto, most): records with hashes in these ranges, no larger than ``most``, make up what is needed.

    A step takes, in order of hash, the records up to the one that would be too much, and leaves the state of each
    source: where it stopped and what is still needed. The next goes on behind it among records that are small enough.
    Sources are done when no such record is left, or all but ``short`` of the goal is there. The records themselves
    are only read: a step is a histogram of their hashes, and a look at the one cell in which the sum is reached.
    """
    state = plan.filter("need >= 1").select("source", "need", (F.col("goal") * short).alias("enough"), F.lit(-1).cast("long").alias("after"))
    done = state.select("source", "after", F.lit(0).cast("long").alias("upto"), F.lit(0.0).alias("most")).filter("false")
    cell = F.shiftright("h", 63 - _BITS)
    while True:
        open_ = sized.select("source", "h", "size").join(state, "source").filter((F.col("h") > F.col("after")) & (F.col("size") <= F.col("need")))
        cells = open_.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("n"), F.max("h").alias("last"), F.first("need").alias("need"))
        w = Window.partitionBy("source").orderBy("cell")
        run = cells.withColumn("run", F.sum("n").over(w))
        over = F.col("run") > F.col("need") + 1e-6
        # What fits in whole cells, and the cell in which the sum passes what is needed.
        edge = cut(run.groupBy("source").agg(F.max(F.when(~over, F.col("last"))).alias("fits"), F.coalesce(F.max(F.when(~over, F.col("run"))), F.lit(0)).alias("sum"), F.min(F.when(over, F.col("cell"))).alias("cell"), F.first("need").alias("need")))
        inner = open_.withColumn("cell", cell).join(edge.select("source", "cell", "sum"), ["source", "cell"])
        same = inner.groupBy("source", "h").agg(F.sum("size").alias("n"), F.first("sum").alias("sum"), F.first("need").alias("need"))
        at = same.withColumn("run", F.col("sum") + F.sum("n").over(Window.partitionBy("source").orderBy("h"))).filter(F.col("run") <= F.col("need") + 1e-6)
        last = at.groupBy("source").agg(F.max("h").alias("h"), F.max("run").alias("run"))
        taken = edge.join(last, "source", "left").select("source", F.coalesce("h", "fits").alias("upto"), F.coalesce("run", "sum").alias("got"))
        moved = cut(state.join(taken, "source").filter("upto is not null"))
        if moved.isEmpty():
            return done
        done = done.unionByName(moved.select("source", "after", "upto", (F.col("need") + 1e-6).alias("most")))
        state = moved.select("source", (F.col("need") - F.col("got")).alias("need"), "enough", F.col("upto").alias("after")).filter("need > enough and need >= 1")
