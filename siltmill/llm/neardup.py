"""Near-duplicate texts: an exact similarity join by rare-first prefix filtering.

Texts are sets of k-word shingles. Exact copies (equal sets) are folded into classes before anything is joined; copies
of a class are told by its hash and confirmed by a second one over other word hashes.
Shingles are ordered rare first; two sets of Jaccard similarity t or more must share a shingle within their
prefixes of n - ceil(t n) + 1 shingles, so the join is on the prefix n-grams. Within a join group pairs pass

* the length filter, |a| >= t |b|;
* the positional filter: the shingles that are left after the match must suffice for the overlap needed;
* the suffix filter: a lower bound of the Hamming distance of the two sets, here taken from 192-bit parity
  sketches (each differing shingle flips one bit, so the sketches differ in no more bits than the sets in
  shingles), must leave room for that overlap.

Each filter is free of false negatives. Candidates are made distinct and verified once, on the words themselves.

Scale: the order needs counts of all shingles. They are kept in a table of 2**count_bits cells, whatever the size
of the corpus (cells that are shared only blur the order, never the result), so it can be broadcast. Each task hands
its counts on as packed ranges of cells, which are summed range by range in arrays of fixed size. Postings travel
as one packed row for each (batch of texts, join part): a text's sketch goes along once for each part, not once for
each posting. The number of parts follows from the counted postings, so that a part fits in a task. A shingle in more
than ``block`` texts is divided: its texts are hashed into blocks, and each pair of blocks is a join group of its own,
so no task holds more than two blocks of a group, and none is dropped. Copies are expanded into pairs in blocks too.

Defined results: null texts and texts of fewer than k words have no set and are like nothing. Rows repeated with the
same key and text count once. A key with several texts has the links of each. Null keys are left out. An empty table
gives empty results. Columns other than key and text are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmill.llm.graph import components
from siltmill.llm.shingles import BLOCK, HASH_BITS, HASH_MASK, Shingler, exact_set
from siltmill.runtime import cut

_SIEVE = 1 << 18
#: Ranges of the count table, each summed by one task.
_RANGES = 64
#: Postings that a join part holds, about; texts that a task remembers as seen; copies in a block of pairs.
_PART_POSTINGS, _SEEN, _COPIES = 4_000_000, 1 << 20, 2_000
#: The packed order of a text's shingles: text, rank class, the upper bits of the hash.
_RANK_BITS = 8
_LOW = HASH_BITS - _RANK_BITS
_TOKEN_MASK = np.uint64((1 << _LOW) - 1)


@dataclass(frozen=True)
class NearDup:
    """Classes of exact copies and the links between them.

    ``members``: rid (hash of key and text), key, cls (the class), chk (its second hash), one row for each key and text.
    ``links``: a < b (classes), similarity.
    """

    members: DataFrame
    links: DataFrame


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def near_duplicates(
    df: DataFrame, key: str, text: str, k: int = 5, threshold: float = 0.8, count_bits: int = 22, block: int = 20_000, parts: int | None = None
) -> NearDup:
    """All links of similarity ``threshold`` or more between different texts, and the classes of equal ones."""
    spark = df.sparkSession
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    texts = texts.select(F.xxhash64("key", "text").alias("rid"), "key", "text")

    scanned = cut(_scan(texts, k, count_bits))
    docs = scanned.filter("rid is not null").select("rid", "key", "cls", "chk", "n").distinct()
    order = spark.sparkContext.broadcast(_order_table(scanned.filter("part is not null").select("part", "cells"), count_bits))
    if parts is None:
        prefix = scanned.filter("rid is not null").agg(F.sum(F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(prefix or 0) // _PART_POSTINGS))

    postings = _postings(texts.select("text"), k, threshold, count_bits, block, parts, order)
    candidates = postings.repartitionById(parts, F.col("part")).mapInPandas(_joiner(threshold), "a long, b long").distinct()

    first = docs.groupBy("cls").agg(F.min("rid").alias("rid"))
    pairs = (
        candidates.join(first.select(F.col("cls").alias("a"), F.col("rid").alias("ra")), "a")
        .join(first.select(F.col("cls").alias("b"), F.col("rid").alias("rb")), "b")
        .select("a", "b", "ra", "rb")
    )
    links = cut(_verified(cut(pairs), texts, k, threshold))
    return NearDup(docs.select("rid", "key", "cls", "chk"), links)


def _scan(texts: DataFrame, k: int, count_bits: int) -> DataFrame:
    """One pass for two things: each text's class and size, and each task's counts of shingles, packed by range of cells."""
    width = max(1, (1 << count_bits) // _RANGES)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, cells = Shingler(k), np.zeros(1 << count_bits, np.int64)
        for pdf in _blocks(batches):
            packed, size = shingler.sets(pdf["text"])
            cells += np.bincount((packed & np.uint64((1 << count_bits) - 1)).astype(np.int64), minlength=1 << count_bits)
            cls, chk = _classes(packed, size)
            out = pd.DataFrame({"rid": pdf["rid"], "key": pdf["key"], "cls": cls.view(np.int64), "chk": chk.view(np.int64), "n": size, "part": pd.array([None] * len(size), "Int32"), "cells": None})
            yield out[size > 0]
        none = pd.array([None], "Int64")
        for p in range(0, 1 << count_bits, width):
            at = np.nonzero(cells[p : p + width])[0]
            if len(at):
                counts = at.astype(np.uint32).tobytes() + cells[p + at].tobytes()
                yield pd.DataFrame({"rid": none, "key": None, "cls": none, "chk": none, "n": none, "part": pd.array([p // width], "Int32"), "cells": [counts]})

    kind = dict(texts.dtypes)["key"]
    return texts.mapInPandas(scan, f"rid long, key {kind}, cls long, chk long, n long, part int, cells binary")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), BLOCK):
            yield pdf.iloc[i : i + BLOCK].reset_index(drop=True)


def _classes(packed: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's set, of the same shingles mixed in different ways; 0 where it is empty."""
    h = packed & HASH_MASK
    other = (h ^ (h >> np.uint64(23))) * np.uint64(0x94D049BB133111EB)
    other = other ^ (other >> np.uint64(31))
    ends = np.cumsum(size)
    digest = xxhash.xxh3_64_intdigest
    cls = np.array([digest(h[e - n : e].tobytes()) if n else 0 for n, e in zip(size.tolist(), ends.tolist(), strict=True)], np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(other, dtype=np.uint64)])
    return cls, total[ends] - total[ends - size]


def _order_table(counts: DataFrame, count_bits: int) -> np.ndarray:
    """Rank classes of the cells, as bytes: 0 not seen, 1 seen once, then by eighths of the binary logarithm.

    Of fixed size, 2**count_bits bytes, whatever the corpus: each range of cells is summed by one task, in an array as
    long as the range, and comes to the driver as one row of bytes.
    """
    width = max(1, (1 << count_bits) // _RANGES)

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for part, blob in zip(pdf["part"].tolist(), pdf["cells"], strict=True):
                n = len(blob) // 12
                at, c = np.frombuffer(blob, np.uint32, n), np.frombuffer(blob, np.int64, n, 4 * n)
                sums.setdefault(part, np.zeros(width, np.int64))[at] += c
        for part, n in sums.items():
            rank = np.where(n > 1, np.minimum(255, np.ceil(np.log2(np.maximum(n, 1)) * 8) + 1), n).astype(np.uint8)
            yield pd.DataFrame({"part": [part], "ranks": [rank.tobytes()]})

    table = np.zeros(1 << count_bits, np.uint8)
    for r in counts.repartitionById(_RANGES, F.col("part")).mapInPandas(ranks, "part int, ranks binary").collect():
        table[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["ranks"], np.uint8)
    return table


def _postings(texts: DataFrame, k: int, t: float, count_bits: int, block: int, parts: int, order) -> DataFrame:  # noqa: ANN001
    """(part, packed): the prefixes of each class, once for each task, packed by join part."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, seen, table = Shingler(k), set(), order.value
        mask = np.uint64((1 << count_bits) - 1)
        hot = min(255, math.ceil(math.log2(block) * 8) + 1)
        for pdf in _blocks(batches):
            packed, size = shingler.sets(pdf["text"])
            cls = _classes(packed, size)[0]
            keep = np.zeros(len(size), bool)
            if len(seen) > _SEEN:  # a text that comes again is only sent again
                seen.clear()
            for i, c in enumerate(cls.tolist()):
                if size[i] and c not in seen:
                    keep[i] = True
                    seen.add(c)
            if not keep.any():
                continue
            packed = packed[keep[(packed >> np.uint64(HASH_BITS)).astype(np.int64)]]
            n = np.where(keep, size, 0)
            level, sketch, sketch_at = _sketches(packed, n)
            h = packed & HASH_MASK
            rank = table[(h & mask).astype(np.int64)].astype(np.uint64)
            key = np.sort((packed & ~HASH_MASK) | (rank << np.uint64(_LOW)) | (h >> np.uint64(_RANK_BITS)))
            owner = (key >> np.uint64(HASH_BITS)).astype(np.int64)
            rank = ((key >> np.uint64(_LOW)) & np.uint64(255)).astype(np.int64)
            pos = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
            prefix = (pos < (n - _ceil(t * n) + 1)[owner]) & (rank > 1)
            owner, h, rank, pos = owner[prefix], key[prefix] & _TOKEN_MASK, rank[prefix], pos[prefix]
            side = np.full(len(h), 2, np.uint8)
            if (rank > hot).any():
                owner, h, pos, side = _divide(owner, h, rank, pos, side, cls, hot, block)
            part = ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            sent, cuts = np.unique(part[by], return_index=True)
            rows = []
            for p, i in zip(sent.tolist(), np.split(by, cuts[1:]), strict=True):
                own, local = np.unique(owner[i], return_inverse=True)
                bits = _gather(sketch, sketch_at[own], 2 << level[own])
                rows.append((p, _pack(cls[own], n[own], level[own], bits, h[i], local, pos[i], side[i])))
            yield pd.DataFrame(rows, columns=["part", "packed"])

    return texts.mapInPandas(emit, "part int, packed binary")


def _divide(owner, h, rank, pos, side, cls, hot, block):  # noqa: ANN001, ANN202
    """The postings of frequent shingles go to one join group for each pair of blocks that holds their text's."""
    many = np.nonzero(rank > hot)[0]
    blocks = np.ceil(np.exp2((rank[many].astype(float) - 1) / 8) / block).astype(np.int64)
    own = (cls[owner[many]] % blocks.astype(np.uint64)).astype(np.int64)
    src = np.repeat(np.arange(len(many)), blocks)
    other = np.arange(len(src)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low, high = np.minimum(own[src], other), np.maximum(own[src], other)
    cell = (low * 1_000_003 + high + 1).astype(np.uint64)
    mixed = (h[many][src] ^ (cell * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    new_side = np.where(low == high, 2, (own[src] == high).astype(np.uint8)).astype(np.uint8)
    rest = rank <= hot
    join = lambda a, b: np.concatenate([a[rest], b])
    return join(owner, owner[many][src]), join(h, mixed), join(pos, pos[many][src]), join(side, new_side)


def _gather(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of ``count`` values from each ``start`` on, one after the other."""
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return values[np.repeat(start, count) + place]


def _sketches(packed: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, words, start): a parity sketch for each text, of 2 << level words from start on.

    Bit i tells whether an odd number of the set's shingles hash to i. The level rises with the size of the set. A
    sketch folds to a lower level by xor of its halves.
    """
    level = np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / 84))).astype(np.int64)
    words = 2 << level
    start = np.cumsum(words) - words
    owner = (packed >> np.uint64(HASH_BITS)).astype(np.int64)
    bit = ((packed & HASH_MASK) >> np.uint64(8)).astype(np.int64) & (64 * words - 1)[owner]
    odd = (np.bincount(64 * start[owner] + bit, minlength=64 * int(words.sum())) & 1).astype(np.uint8)
    return level, np.packbits(odd).view(np.uint64), start


def _pack(cls, n, level, sketch, h, local, pos, side) -> bytes:  # noqa: ANN001
    """Texts: class, size, level, sketch; postings: 32 bits of the shingle, text, position, side."""
    wide = int(max(n.max(initial=0), len(cls)) >= 1 << 16)
    small = np.uint32 if wide else np.uint16
    return b"".join(
        (struct.pack("<IIIB", len(cls), len(h), len(sketch), wide), cls.tobytes(), sketch.tobytes(), level.astype(np.uint8).tobytes(), n.astype(small).tobytes(), h.astype(np.uint32).tobytes(), local.astype(small).tobytes(), pos.astype(small).tobytes(), side.tobytes())
    )


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    texts, posts, words, wide = struct.unpack_from("<IIIB", blob)
    at, out, small = 13, [], np.uint32 if wide else np.uint16
    for kind, count in ((np.uint64, texts), (np.uint64, words), (np.uint8, texts), (small, texts), (np.uint32, posts), (small, posts), (small, posts), (np.uint8, posts)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += count * np.dtype(kind).itemsize
    cls, sketch, level, n, h, local, pos, side = out
    return cls, sketch, level.astype(np.int64), n.astype(np.int32), h, local.astype(np.int32), pos.astype(np.int32), side


class _Distance:
    """Lower bounds of the distances of sets, from their sketches folded to the lower level of the two."""

    def __init__(self, sketch: np.ndarray, level: np.ndarray) -> None:
        start = np.cumsum(2 << level) - (2 << level)
        self.level = level
        self.row: dict[int, np.ndarray] = {}
        self.bits: dict[int, np.ndarray] = {}
        above = np.zeros(0, np.int64), np.zeros((0, 0), np.uint64)
        for x in range(int(level.max()), -1, -1):
            words = 2 << x
            own = np.nonzero(level == x)[0]
            mine = sketch[(start[own][:, None] + np.arange(words)[None, :])] if len(own) else np.zeros((0, words), np.uint64)
            folded = above[1].reshape(-1, 2, words) if len(above[0]) else np.zeros((0, 2, words), np.uint64)
            who = np.concatenate([above[0], own])
            bits = np.concatenate([folded[:, 0] ^ folded[:, 1], mine])
            row = np.full(len(level), -1, np.int64)
            row[who] = np.arange(len(who))
            self.row[x], self.bits[x] = row, bits
            above = who, bits

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        low = np.minimum(self.level[x], self.level[y])
        for v in np.unique(low):
            at = np.nonzero(low == v)[0]
            row, bits = self.row[int(v)], self.bits[int(v)]
            out[at] = np.bitwise_count(bits[row[x[at]]] ^ bits[row[y[at]]]).sum(axis=1, dtype=np.int32)
        return out


def _joiner(t: float):  # noqa: ANN202
    """Joins the postings of one part and yields the candidates that pass all filters."""
    share = t / (1 + t)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [_unpack(b) for pdf in batches for b in pdf["packed"]]
        if not found:
            return
        base = np.cumsum([0] + [len(f[0]) for f in found])
        cls, first, same = np.unique(np.concatenate([f[0] for f in found]), return_index=True, return_inverse=True)
        n = np.concatenate([f[3] for f in found])[first]
        # Texts are numbered by size, so the postings of a shingle come by size too.
        by_size = np.argsort(n, kind="stable")
        number = np.empty(len(n), np.int64)
        number[by_size] = np.arange(len(n))
        cls, n, first = cls[by_size], n[by_size], first[by_size]
        words = 2 << np.concatenate([f[2] for f in found])
        sketch = _gather(np.concatenate([f[1] for f in found]), (np.cumsum(words) - words)[first], words[first])
        distance = _Distance(sketch, np.concatenate([f[2] for f in found])[first])
        doc = number[same[np.concatenate([f[5] + b for f, b in zip(found, base, strict=False)])]]
        key = (np.concatenate([f[4] for f in found]).astype(np.uint64) << np.uint64(32)) | doc.astype(np.uint64)
        pos = np.concatenate([f[6] for f in found])
        side = np.concatenate([f[7] for f in found])
        del found
        at = np.argsort(key)
        key, pos, side = key[at], pos[at], side[at]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (side[1:] != side[:-1])
        key, pos, side = key[new], pos[new], side[new]
        token, doc = (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.int32)
        size = n[doc]
        left = (size - pos).astype(np.float32)
        divided = bool((side != 2).any())
        # The smaller set of a pair needs half of the sum at least, so its match lies early.
        active = np.nonzero(left >= 2 * share * size - 1e-3)[0]
        keep: list[np.ndarray] = []
        held, d = 0, 0
        while len(active):
            d += 1
            active = active[active + d < len(token)]
            b = active + d
            going = (token[active] == token[b]) & (size[active] >= t * size[b] - 1e-6)
            active, b = active[going], b[going]
            need = share * (size[active] + size[b]) - 1e-3
            ok = (left[active] >= need) & (left[b] >= need)
            if divided:
                ok &= (side[active] == 2) | (side[active] != side[b])
            x, y = doc[active[ok]], doc[b[ok]]
            far = distance.between(x, y)
            near = (n[x] + n[y] - far) // 2 >= _ceil(share * (n[x] + n[y]))
            if near.any():
                keep.append(np.stack([x[near], y[near]], axis=1))
                held += int(near.sum())
            if held > 1 << 20:
                keep, held = [np.unique(np.concatenate(keep), axis=0)], 0
        if keep:
            pairs = cls[np.unique(np.concatenate(keep), axis=0)].view(np.int64)
            a, b = pairs.min(axis=1), pairs.max(axis=1)
            for i in range(0, len(a), 1 << 16):
                yield pd.DataFrame({"a": a[i : i + (1 << 16)], "b": b[i : i + (1 << 16)]})

    return join


def _verified(pairs: DataFrame, texts: DataFrame, k: int, t: float) -> DataFrame:
    """Pairs with their exact similarity, where it suffices.

    A table of at most 2**18 cells tells which texts can be needed, so the others are left where they are.
    """
    need = pairs.select(F.explode(F.array("ra", "rb")).alias("rid")).distinct()
    cell = F.pmod("rid", F.lit(_SIEVE))
    sieve = F.broadcast(need.select(cell.alias("cell")).distinct())
    wanted = texts.select("rid", "text", cell.alias("cell")).join(sieve, "cell", "left_semi").join(need, "rid", "left_semi").dropDuplicates(["rid"]).select("rid", "text")
    both = pairs.join(wanted.select(F.col("rid").alias("ra"), F.col("text").alias("ta")), "ra").join(
        wanted.select(F.col("rid").alias("rb"), F.col("text").alias("tb")), "rb"
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, y in zip(pdf["ta"], pdf["tb"], strict=True):
                p, q = exact_set(x, k), exact_set(y, k)
                common = len(p & q)
                out.append(common / max(1, len(p) + len(q) - common))
            res = pdf[["a", "b"]].assign(similarity=np.array(out, dtype=float))
            yield res[res["similarity"] >= t]

    return both.select("a", "b", "ta", "tb").mapInPandas(verify, "a long, b long, similarity double")


def linked_pairs(found: NearDup) -> DataFrame:
    """(id_a, id_b): all pairs of different keys that are alike, the smaller first: links and copies expanded.

    Only for results that are wanted by pair; ``groups`` holds the same in one row for each key.
    """
    m = found.members
    a = m.select(F.col("key").alias("x"), F.col("cls").alias("a"))
    b = m.select(F.col("key").alias("y"), F.col("cls").alias("b"))
    across = found.links.join(a, "a").join(b, "b").select("x", "y")
    both = across.unionByName(_copies(m)).filter("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _copies(members: DataFrame) -> DataFrame:
    """(x, y): the pairs of copies. Those of one text are hashed into blocks; each pair of blocks is a join group of its own."""
    sizes = members.groupBy("cls", "chk").agg(F.ceil(F.count(F.lit(1)) / _COPIES).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    own = members.join(sizes, ["cls", "chk"]).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    spread = own.select("cls", "chk", "rid", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = spread.select("cls", "chk", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rid", "key")
    left = cell.filter("own = low").select("cls", "chk", "low", "high", F.col("rid").alias("r"), F.col("key").alias("x"))
    right = cell.filter("own = high").select("cls", "chk", "low", "high", F.col("rid").alias("s"), F.col("key").alias("y"))
    return left.join(right, ["cls", "chk", "low", "high"]).filter("low < high or r < s").select("x", "y")


def groups(found: NearDup) -> DataFrame:
    """(key, group_id, n_copies, n_links): one row for each key and text.

    ``group_id`` is the smallest key of the connected group, ``n_copies`` the rows of the class, ``n_links`` the
    classes linked to it.
    """
    of = components(found.links.select("a", "b"))
    ends = found.links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = found.members.groupBy("cls").agg(F.count(F.lit(1)).alias("n_copies"), F.min("key").alias("least"))
    classes = sizes.join(ends, "cls", "left").join(of.select(F.col("node").alias("cls"), "group"), "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    first = classes.groupBy("group").agg(F.min("least").alias("group_id"))
    named = classes.join(first, "group").select("cls", "group_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return found.members.join(named, "cls").select("key", "group_id", "n_copies", "n_links")
