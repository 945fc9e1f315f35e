"""The similarity join against brute force, with hot groups, copies and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmill.llm import neardup
from siltmill.llm.graph import components
from siltmill.llm.shingles import Shingler, exact_set


def texts(rng, n, words=40):
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randint(0, 9)) for _ in range(words)) for _ in range(n // 6)]
    out = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1])] = [f"new{rng.randint(0, 99)}"]
        if rng.random() < 0.2:
            w = w[len(w) // 2 :] + w[: len(w) // 2]
        out.append((f"d{i:04d}", " ".join(w)))
    return out


def brute(rows, k, t):
    sets = {}
    for key, text in rows:
        if key is not None and text is not None:
            sets.setdefault(key, []).append(exact_set(text, k))
    keys, out = sorted(sets), set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if any(x and y and len(x & y) / len(x | y) >= t for x in sets[a] for y in sets[b]):
                out.add((a, b))
    return out


@pytest.mark.parametrize(("k", "t", "block"), [(3, 0.6, 20_000), (5, 0.8, 20_000), (3, 0.6, 3), (2, 0.4, 5), (3, 0.95, 20_000)])
def test_pairs_against_brute_force(spark, k, t, block):
    rng = random.Random(k * 100 + block)
    rows = texts(rng, 150) + [("n", None), (None, "alpha1 beta2 gamma3"), ("e", ""), ("s", "one two"), ("s2", "one two"), ("u", "É ß 12 é — ß 12 é É"), ("v", "é SS 12 É ß 12 é é")]
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1].upper() + " !"), rows[3], ("d0004", "another text of the same key " * 3)]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("cls", F.lit(1)).withColumn("a", F.lit("x"))
    found = neardup.near_duplicates(df.repartition(5), "id", "text", k, t, count_bits=12, block=block, parts=3)
    got = [tuple(r) for r in neardup.linked_pairs(found).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, k, t)


def test_hot_group_of_copies_is_one_class(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(i, same) for i in range(600)] + [(1000, same + " more"), (1001, "quite another text with many other words in it")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "id long, text string").repartition(6), "id", "text", 3, 0.6)
    assert found.links.count() == 1
    g = {r["key"]: r for r in neardup.groups(found).collect()}
    assert g[0]["group_id"] == g[1000]["group_id"] != g[1001]["group_id"] and g[5]["n_copies"] == 600 and g[5]["n_links"] == 1 and g[1001]["n_links"] == 0


def test_long_text_and_empty_table(spark):
    long = " ".join(f"word{i}" for i in range(70_000))
    rows = [("a", long), ("b", long + " end"), ("c", None)]
    df = spark.createDataFrame(rows, "id string, text string")
    assert [tuple(r) for r in neardup.linked_pairs(neardup.near_duplicates(df, "id", "text")).collect()] == [("a", "b")]
    none = neardup.near_duplicates(df.limit(0), "id", "text")
    assert neardup.linked_pairs(none).count() == 0 and neardup.groups(none).count() == 0


def test_shingler_sets_are_exact():
    rng = random.Random(1)
    rows = [t for _, t in texts(rng, 60)] + ["", None, "one", "a b c", "a b c a b c a b c"]
    packed, size = Shingler(3).sets(rows)
    assert size.tolist() == [len(exact_set(t, 3)) for t in rows]
    assert (np.diff(packed.astype(object)) > 0).all()


def test_sketch_bound_never_exceeds_the_distance():
    rng = np.random.default_rng(2)
    for n in (5, 80, 90, 200, 700):
        a = np.unique(rng.integers(0, 1 << 50, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 50, n, dtype=np.uint64)]))
        packed = np.concatenate([a, b | np.uint64(1 << 50)])
        level, words, _ = neardup._sketches(packed, np.array([len(a), len(b)]))
        got = neardup._Distance(words, level).between(np.array([0]), np.array([1]))[0]
        assert got <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["group"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_come_in_blocks_and_none_is_lost(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_COPIES", 3)
    rows = [(f"k{i:02d}", "one two three four five six seven") for i in range(11)] + [("x", "one two three four five six eight"), ("y", "quite another text of seven words here")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text", 3, 0.6)
    pairs = {tuple(r) for r in neardup.linked_pairs(found).collect()}
    alike = sorted(k for k, _ in rows if k != "y")
    assert pairs == {(a, b) for a in alike for b in alike if a < b}
    got = {r["key"]: (r["group_id"], r["n_copies"], r["n_links"]) for r in neardup.groups(found).collect()}
    assert got["k07"] == ("k00", 11, 1) and got["x"] == ("k00", 1, 1) and got["y"] == ("y", 1, 0)


def test_parts_follow_the_postings(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_PART_POSTINGS", 50)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[i % 7 : i % 7 + 30])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    many = {tuple(r) for r in neardup.linked_pairs(neardup.near_duplicates(df, "id", "text", 3, 0.6)).collect()}
    one = {tuple(r) for r in neardup.linked_pairs(neardup.near_duplicates(df, "id", "text", 3, 0.6, parts=1)).collect()}
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(28)} for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert many == one == want
