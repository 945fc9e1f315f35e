"""Fill containers of fixed capacity: conflict-constrained best fit.

Items go in by falling size, those of a duplicate cluster large enough to touch most bins first. Open bins are kept by
the room they have left, each with a bitmap of the sources and one of the duplicate clusters in it. The successor search
starts at the tightest bin that holds the item and goes on to looser ones until a compatible one is found; if there is
none, a bin is opened. Two members of a duplicate cluster never share a bin.

``sources`` says how two items of one source are treated. "strict": they never share a bin either. "avoid": they do only
if no other open bin has room, which keeps bins full where one source holds much of the data. "shared": no constraint.
``containers`` counts the sources of each bin, so what "avoid" gave up is reported.

An item larger than the capacity is cut into full pieces, which are bins of their own, and a rest, which is packed.

Items are hashed into shards of about ``shard_items``, which are packed side by side; a shard ends with a bin or two
that are not full, one in a thousand at the default. No task sees more than a shard, whatever the source or cluster.

Defined results: items without size (null or empty texts) are kept with container null; every other token is in
exactly one container; ties in size go by cluster, then by key, so the result doesn't depend on the order of rows.
Rows repeated with the same key count once, the larger size counts. Null keys are left out.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmill.runtime import cut


def best_fit(items: Iterable[tuple[int, int, int]], capacity: int, avoid: bool = True) -> list[int]:
    """The bin of each item (size, source, cluster), in the order given; falling size fills best.

    Source and cluster are small numbers from 0, bits of a bitmap; -1 is none and conflicts with nothing. ``avoid`` lets
    an item join its source where only such bins have room; otherwise a bin is opened.
    Bins that an item's cluster excludes are set aside as long as items of the same size and cluster follow, so a run
    of copies looks at each bin once.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    sources: list[int] = []
    clusters: list[int] = []
    aside: list[tuple[int, int]] = []
    run: tuple[int, int] | None = None
    out = []

    def put(bin_: int, room: int) -> None:
        nonlocal open_rooms
        if room > 0:
            by_room[room].append(bin_)
            open_rooms |= 1 << room

    def take(room: int, place: int) -> int:
        nonlocal open_rooms
        bin_ = by_room[room].pop(place)
        if not by_room[room]:
            open_rooms &= ~(1 << room)
        return bin_

    def search(size: int, bad_source: int, bad_cluster: int) -> tuple[int, int] | None:
        at = size
        while rest := open_rooms >> at:
            at += (rest & -rest).bit_length() - 1
            place = len(by_room[at]) - 1
            while place >= 0:
                b = by_room[at][place]
                if clusters[b] & bad_cluster:
                    aside.append((take(at, place), at))
                elif not sources[b] & bad_source:
                    return at, place
                place -= 1
            at += 1
        return None

    for size, source, cluster in items:
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        if run != (size, cluster):
            for bin_, room in aside:
                put(bin_, room)
            aside.clear()
            run = (size, cluster)
        found = search(size, s, c)
        if found is None and s and avoid:
            found = search(size, 0, c)
        if found is None:
            bin_, room = len(sources), capacity
            sources.append(0)
            clusters.append(0)
        else:
            bin_, room = take(*found), found[0]
        sources[bin_] |= s
        clusters[bin_] |= c
        put(bin_, room - size)
        out.append(bin_)
    return out


def pack(df: DataFrame, key: str, size: str, source: str, cluster: str, capacity: int = 2048, shard_items: int = 4096, sources: str = "avoid") -> DataFrame:
    """(key, piece_no, start_token, n_tokens, source, container): each piece of each item with its container.

    ``size`` in tokens. ``cluster`` and ``source`` may be null.
    """
    if sources not in ("strict", "avoid", "shared"):
        raise ValueError(f"unknown treatment of sources: {sources}")
    rows = df.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size"), F.col(source).alias("source"), F.col(cluster).alias("cluster"))
    items = cut(rows.filter("key is not null").groupBy("key").agg(F.max_by(F.struct("size", "source", "cluster"), F.coalesce("size", F.lit(-1))).alias("i")).select("key", "i.*"))
    n = items.count()
    shards = max(1, -(-n // shard_items))
    cap = F.lit(capacity)
    full = F.floor(F.col("size") / cap)
    pieces = items.filter("size > 0").select(
        "key",
        "source",
        "cluster",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / cap))).alias("i"),
        full.alias("full"),
        F.col("size").alias("whole"),
    )
    pieces = pieces.withColumn("size", F.least(cap.cast("long"), F.col("whole") - F.col("i") * cap))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        # A cluster with members for more than half of the bins goes first, else its last members find no bin without it.
        members = pdf["cluster"].map(pdf["cluster"].value_counts()).fillna(0)
        pdf = pdf.assign(later=members * capacity <= pdf["size"].sum() / 2)
        pdf = pdf.sort_values(["later", "size", "cluster", "key", "i"], ascending=[True, False, True, True, True], kind="stable")
        own = pdf["cluster"].where(pdf.duplicated("cluster", keep=False) & pdf["cluster"].notna())
        codes = zip(pdf["size"].tolist(), (pd.factorize(pdf["source"])[0] if sources != "shared" else [-1] * len(pdf)), pd.factorize(own)[0].tolist(), strict=True)
        base = int(pdf["shard"].iloc[0]) << 32
        pdf = pdf.assign(container=[base + b for b in best_fit(codes, capacity, avoid=sources == "avoid")])
        return pdf[["key", "i", "size", "source", "container"]]

    kind = dict(df.dtypes)[key]
    packed = pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(fill, f"key {kind}, i long, size long, source {dict(df.dtypes)[source]}, container long")
    none = items.filter("size is null or size <= 0").select("key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("size"), "source", F.lit(None).cast("long").alias("container"))
    out = packed.unionByName(none)
    return out.select(F.col("key").alias(key), (F.col("i") + 1).cast("int").alias("piece_no"), (F.col("i") * cap).alias("start_token"), F.col("size").alias("n_tokens"), "source", "container")


def containers(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(container, n_pieces, n_tokens, unused, shared_source) of each container.

    ``shared_source``: the pieces beyond the first of their source in it, pieces without source aside.
    """
    return (
        packed.filter("container is not null")
        .groupBy("container")
        .agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"), (F.count("source") - F.count_distinct("source")).alias("shared_source"))
        .withColumn("unused", F.lit(capacity) - F.col("n_tokens"))
    )
