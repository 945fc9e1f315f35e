"""What changed between consecutive full snapshots.

Every (key, snapshot) gets a fingerprint of its set of canonical rows; consecutive snapshots meet in one full
outer join on key and snapshot. Missing sides give additions and removals, unequal fingerprints changes.

Defined results: rows without a snapshot or without a key belong to none and are left out; repeated rows count
once; the order of rows is of no account; a key that comes back after a gap is added again; a table with fewer
than two snapshots gives no rows. Columns of the input other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_row(columns: Sequence[Column]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row in which null and the place of each value count."""
    marked = [c for x in columns for c in (x.isNull(), x)]
    return F.xxhash64(F.lit("a"), *marked), F.xxhash64(F.lit("b"), *marked)


def fingerprints(df: DataFrame, key: Column, snapshot: Column, columns: Sequence[Column]) -> DataFrame:
    """(key, snapshot, n, h1, h2): one row for each key of each snapshot.

    The distinct rows are found first, on their hashes, so a key that holds a third of all rows is spread over
    many tasks; their sums are then built map-side, so no task collects the rows of a key.
    """
    h1, h2 = canonical_row(columns)
    rows = (
        df.select(key.alias("key"), snapshot.alias("snapshot"), h1.alias("h1"), h2.alias("h2"))
        .filter("key is not null and snapshot is not null")
        .distinct()
    )
    return rows.groupBy("key", "snapshot").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")
    )


def snapshot_changes(df: DataFrame, key: Column, snapshot: Column, columns: Sequence[Column]) -> DataFrame:
    """(key, snapshot, change_kind) for each snapshot after the first, against the one before it.

    The list of snapshots is the only thing ordered in one task; it has a row for each delivery, not for each
    record.
    """
    prints = fingerprints(df, key, snapshot, columns)
    days = df.select(snapshot.alias("snapshot")).filter("snapshot is not null").distinct()
    order = days.select("snapshot", F.lead("snapshot").over(Window.orderBy("snapshot")).alias("next"), F.row_number().over(Window.orderBy("snapshot")).alias("no"))
    step = F.broadcast(order)  # one row for each delivery
    now = prints.join(step, "snapshot").filter("no > 1").select("key", "snapshot", "n", "h1", "h2")
    before = prints.join(step, "snapshot").filter("next is not null").select(
        "key", F.col("next").alias("snapshot"), F.col("n").alias("n0"), F.col("h1").alias("g1"), F.col("h2").alias("g2")
    )
    both = before.join(now, ["key", "snapshot"], "full_outer")
    kind = (
        F.when(F.col("n0").isNull(), "added")
        .when(F.col("n").isNull(), "removed")
        .when((F.col("n") != F.col("n0")) | (F.col("h1") != F.col("g1")) | (F.col("h2") != F.col("g2")), "changed")
    )
    return both.select("key", "snapshot", kind.alias("change_kind")).filter("change_kind is not null")
