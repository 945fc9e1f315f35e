"""Tokens, splitting, packing, mixing and repeated lines on small fixtures, against brute force and round trips."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmill.llm import boilerplate, mixing, packing, splitting
from siltmill.llm.tokens import Counter as TokenCounter
from siltmill.llm.tokens import encoding, token_count, token_offsets

SNIPPETS = ["Word", "naïve café", "  two", "\n", "\n\n", "\n\n## Head\n", "ﬁ²½", "it's 12,345!", "\t", " ", "über-lang", "日本語", "🙂", "a" * 30, ". ", "? ", "…", " x"]


def mess(rng, n):
    return "".join(rng.choice(SNIPPETS) for _ in range(n))


def test_counts_are_those_of_the_encoding():
    rng, c = random.Random(1), TokenCounter()
    for _ in range(400):
        t = mess(rng, rng.randint(0, 60))
        assert c.count(t) == len(encoding().encode_ordinary(t)), repr(t)
        assert token_offsets(t)[-1] == len(t.encode())
    assert c.count(None) == 0


def test_token_count_column(spark):
    df = spark.createDataFrame([(None,), ("",), ("one two three",)], "t string")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == [0, 0, 3]


@pytest.mark.parametrize(("limit", "overlap"), [(20, 4), (64, 0), (50, 25), (8, 7)])
def test_split_rebuilds_the_text(limit, overlap):
    rng = random.Random(limit)
    for _ in range(60):
        text = mess(rng, rng.randint(1, 300))
        off = token_offsets(text)
        pieces = splitting.split_text(text, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for (a, b, n, _), (a2, b2, _, _) in zip(pieces, pieces[1:], strict=False):
            assert a < a2 <= b < b2, "pieces overlap or touch, and go on"
            start, end = (next(i for i, x in enumerate(off) if x == len(text[:at].encode())) for at in (a2, b))
            assert end - start == 0 or end - start >= overlap
        assert all(0 < n <= limit and n == len(encoding().encode_ordinary(text[a:b])) for a, b, n, _ in pieces)
        assert "".join(text[max(a, e) : b] for (a, b, _, _), e in zip(pieces, [0] + [p[1] for p in pieces], strict=False)) == text


def test_split_prefers_strong_boundaries():
    body = "Some words stand here in a row. " * 6
    text = body + "\n\n# Heading\n" + body + "\n" + body
    first = splitting.split_text(text, 70, 5)[0]
    assert first[3] == "heading" and text[first[1] :].startswith("# Heading")
    assert {k for *_, k in splitting.split_text("word " * 500, 40, 8)} == {"hard", "end"}


def test_split_oversized_table(spark):
    rows = [(1, "short"), (2, None), (3, ""), (4, "word. " * 400), (4, "word. " * 400), (5, "x" * 5000)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("piece_no", F.lit("clash")).withColumn("key", F.lit(0))
    out = splitting.split_oversized(df, "id", "text", limit=100, overlap=10)
    by = Counter(r["id"] for r in out.collect())
    assert by[1] == 1 and 2 not in by and 3 not in by and by[4] % 2 == 0 and by[5] > 1
    only = splitting.split_oversized(df, "id", "text", limit=100, overlap=10, keep_small=False)
    assert {r["id"] for r in only.collect()} == {4, 5}
    assert splitting.split_oversized(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError, match="overlap"):
        splitting.split_oversized(df, "id", "text", limit=5, overlap=5)


def brute_fit(items, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for size, source, cluster in items:
        ok = [b for b in bins if b["room"] >= size and (cluster < 0 or cluster not in b["c"])]
        other = [b for b in ok if source < 0 or source not in b["s"]]
        pool = other or ok
        if pool:
            room = min(b["room"] for b in pool)
        else:
            bins.append({"room": capacity, "c": set(), "s": set()})
            pool, room = [bins[-1]], capacity
        out.append(room)
        return_to = [b for b in pool if b["room"] == room][-1]
        return_to["room"] -= size
        return_to["c"].add(cluster)
        return_to["s"].add(source)
    return bins


def test_best_fit_properties():
    rng = random.Random(4)
    for _ in range(30):
        items = sorted(((rng.randint(1, 50), rng.randint(-1, 4), rng.choice([-1, -1, 0, 1, 2])) for _ in range(120)), key=lambda x: (-x[0], x[2]))
        bins = packing.best_fit(items, 50)
        load, clusters = Counter(), defaultdict(list)
        for (size, _, cluster), b in zip(items, bins, strict=True):
            load[b] += size
            if cluster >= 0:
                clusters[b].append(cluster)
        assert max(load.values()) <= 50 and all(len(c) == len(set(c)) for c in clusters.values())
        assert len(load) <= len(brute_fit(items, 50)) + 2


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(1, 900), "hot" if rng.random() < 0.4 else f"s{i % 7}", 1 if i % 5 == 0 else None) for i in range(500)]
    rows += [(1000, 5000, None, None), (1001, 2048, "s1", None), (1002, 0, "s1", None), (1003, None, "s1", None), (None, 10, "s1", None), rows[0]]
    df = spark.createDataFrame(rows, "doc long, n long, source string, cluster long").withColumn("i", F.lit(1))
    out = packing.pack(df, "doc", "n", "source", "cluster", shard_items=200)
    got = [r.asDict() for r in out.collect()]
    sizes = {d: n or 0 for d, n, *_ in rows if d is not None}
    total = Counter()
    for r in got:
        total[r["doc"]] += r["n_tokens"]
    assert total == Counter(sizes) and set(total) == set(sizes)
    load, copies = Counter(), Counter()
    cluster = {d: c for d, _, _, c in rows}
    for r in got:
        assert (r["container"] is None) == (sizes[r["doc"]] == 0)
        if r["container"] is not None:
            load[r["container"]] += r["n_tokens"]
            if cluster[r["doc"]]:
                copies[r["container"]] += 1
    assert max(load.values()) <= 2048 and max(copies.values()) == 1
    assert sum(2048 - n for n in load.values()) / (2048 * len(load)) < 0.12
    assert sorted(r["start_token"] for r in got if r["doc"] == 1000) == [0, 2048, 4096] and sum(r["doc"] == 7 for r in got) == 1
    again = packing.pack(df.repartition(7), "doc", "n", "source", "cluster", shard_items=200)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))
    assert packing.pack(df.limit(0), "doc", "n", "source", "cluster").count() == 0
    assert {r["unused"] >= 0 for r in packing.containers(out).collect()} == {True}


def brute_fill(weights, caps, total):
    """Raise the level in small steps: what each source takes at it, until the total is reached."""
    live = {s for s in weights if weights[s] > 0 and caps[s] > 0}
    total = min(total, sum(caps[s] for s in live))
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(caps[s], weights[s] * level) for s in live) < total:
            low = level
        else:
            high = level
    return {s: min(caps[s], weights[s] * high) if s in live else 0.0 for s in weights}


def test_water_fill(spark):
    rng = random.Random(9)
    for _ in range(4):
        rows = [(f"s{i}", rng.choice([0.0, 0.1, 0.3, 0.5]), rng.choice([0, 10, 100, 1000]), rng.randint(0, 4)) for i in range(7)]
        df = spark.createDataFrame(rows, "source string, weight double, size long, repeats int")
        for total in (None, 50.0, 700.0, 1e7):
            asked = sum(n for _, w, n, r in rows if w > 0 and n * r > 0) if total is None else total
            want = brute_fill({s: w for s, w, _, _ in rows}, {s: float(n * r) for s, _, n, r in rows}, asked)
            got = {r["source"]: (r["goal"], r["clamped"]) for r in mixing.water_fill(df, total).collect()}
            assert set(got) == set(want) and all(abs(got[s][0] - want[s]) < 1e-3 for s in want), (rows, total)
            caps = {s: n * r for s, _, n, r in rows}
            assert all(not c or abs(g - caps[s]) < 1e-6 for s, (g, c) in got.items())


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["Big ", "big", "BIG"]), rng.randint(1, 40)) for i in range(3000)] + [(5000 + i, "small", 10) for i in range(60)] + [(9000, None, 5), (9001, "other", 5), (9002, "small", 0), (9003, "small", None)]
    df = spark.createDataFrame(rows + rows[:50], "doc long, source string, n long").withColumn("size", F.lit("x"))
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, targets, "doc", "source", F.col("n"), total=6000)
    shares = {r["source"]: r for r in m.shares.collect()}
    assert shares["small"]["tokens"] == 1800 and shares["small"]["clamped"] and shares["absent"]["tokens"] == 0, "a source at its cap"
    assert abs(shares["big"]["tokens"] - 4200) <= 5 and not shares["big"]["clamped"] and abs(sum(r["reached_share"] or 0 for r in shares.values()) - 1) < 1e-9
    sel = m.selection.collect()
    assert len({r["doc"] for r in sel}) == len(sel) and all(r["repeats"] <= (1 if r["source"] == "big" else 3) for r in sel)
    # One pass over everything by default: small is clamped, big takes the rest, all of it and no more.
    whole = {r["source"]: r for r in mixing.mix(df, targets, "doc", "source", F.col("n")).shares.collect()}
    assert whole["small"]["tokens"] == 1800 and whole["small"]["most_repeats"] == 3
    assert abs(whole["big"]["tokens"] - (whole["big"]["available"] + 600 - 1800)) <= 40 and whole["big"]["most_repeats"] == 1
    lumpy = spark.createDataFrame([(1, "a", 900), *[(i, "a", 7) for i in range(2, 90)], (500, "b", 500)], "doc long, source string, n long")
    ab = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r["tokens"] for r in mixing.mix(lumpy, ab, "doc", "source", F.col("n"), total=1000, seed=1).shares.collect()}
    assert 493 <= got["a"] <= 500 and got["b"] == 500
    assert mixing.mix(df.limit(0), targets, "doc", "source", F.col("n")).selection.count() == 0


def test_no_record_is_repeated_while_another_is_left_out(spark):
    df = spark.createDataFrame([(i, "a", 1 + i % 9) for i in range(400)] + [(1000 + i, "b", 5) for i in range(20)], "doc long, source string, n long")
    targets = spark.createDataFrame([("a", 0.5, 5), ("b", 0.5, 50)], "source string, target_share double, max_repeats int")
    for total in (500.0, 1000.0, 3333.0):
        m = mixing.mix(df, targets, "doc", "source", F.col("n"), total=total)
        sel = {r["doc"]: r["repeats"] for r in m.selection.collect()}
        for r in m.shares.collect():
            own = [sel.get(d, 0) for d in (range(400) if r["source"] == "a" else range(1000, 1020))]
            assert max(own) - min(own) <= 1 and max(own) <= -(-r["goal_tokens"] // r["available"]) and abs(r["tokens"] - r["goal_tokens"]) <= 5


def test_strict_sources_never_share_a_bin(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(1, 900), "hot" if rng.random() < 0.3 else f"s{i % 7}", None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc long, n long, source string, cluster long")
    strict, avoid = (packing.containers(packing.pack(df, "doc", "n", "source", "cluster", sources=x)) for x in ("strict", "avoid"))
    assert strict.agg(F.max("shared_source")).first()[0] == 0
    assert strict.agg(F.sum("n_tokens")).first()[0] == avoid.agg(F.sum("n_tokens")).first()[0] == sum(n for _, n, _, _ in rows)
    assert strict.count() >= avoid.count()


def brute_lines(rows, least, share):
    docs = {(k, s, t) for k, s, t in rows if k is not None and s is not None and t is not None and t.strip()}
    site, seen, lines = Counter(), defaultdict(set), []
    for k, s, t in docs:
        site[s] += 1
        for i, line in enumerate(t.split("\n"), 1):
            norm = re.sub(r"(?:[^\w]|_)+", " ", re.sub(r"\d+", "0", line.lower())).strip()
            if norm:
                seen[s, norm].add((k, t))
                lines.append((k, s, norm, i))
    return {(k, i) for k, s, n, i in lines if len(seen[s, n]) >= max(least, share * site[s])}


def test_repeated_lines(spark):
    rng = random.Random(9)
    common = ["Share this page: mail, print", "Date modified: 2026-01-02", "© 2019 All rights reserved — the office of the site", "É_ß", "x"]
    rows = []
    for i in range(400):
        own = [f"Line {rng.choice('abcdefgh')} of the text about {rng.choice(['fees', 'forms', 'ports'])} number {rng.random()}" for _ in range(3)]
        own += [c.upper() if rng.random() < 0.3 else c.replace("2026", str(rng.randint(1000, 9999))) for c in common if rng.random() < 0.2]
        rng.shuffle(own)
        rows.append((f"k{i}", "hot" if i % 3 else f"site{i % 5}", "\n".join(own) + rng.choice(["", "\n", "\r\n\n  ", "\n---"])))
    rows += [("n", "hot", None), ("b", "hot", "  \n "), (None, "hot", common[0]), ("s", None, common[0]), ("one", "hot", "y" * 50_000 + " " + common[2]), *rows[:20]]
    df = spark.createDataFrame(rows, "id string, site string, text string").withColumn("line", F.lit("clash")).repartition(5)
    for bits in (23, 4):
        found = boilerplate.repeated_lines(df, "id", "site", "text", sieve_bits=bits)
        got = [tuple(r) for r in found.collect()]
        want = brute_lines(rows, 8, 0.05)
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    clean = boilerplate.without_lines(df.select("id", "text").distinct(), "id", "text", found)
    texts = {r["id"]: r["text"] for r in clean.filter("id is not null").collect()}
    by = {k: t for k, _, t in rows}
    for k, t in texts.items():
        gone = {n for i, n in want if i == k}
        assert t == (by[k] if not gone else "\n".join(x for n, x in enumerate(by[k].split("\n"), 1) if n not in gone))
    assert boilerplate.repeated_lines(df.limit(0), "id", "site", "text").count() == 0


def test_chunks_of_a_line_depend_on_the_line_alone():
    line = "Unless the quota is reached first a sponsor waits 0 months for the seasonal work card and more"
    a = boilerplate.chunk_lines([line])
    b = boilerplate.chunk_lines(["before", "", line, line, "after"])
    assert len(a[1]) > 1
    assert b[1][b[0] == 2].tolist() == a[1].tolist() == b[1][b[0] == 3].tolist()
    assert boilerplate.chunk_lines([""])[1].tolist() == []


def test_repeated_spans_over_line_ends_and_within_lines(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    notice = "this page is only general guidance and no legal advice so please ask the office in your own region before you apply for any of the permits named in this text and do not send originals by mail unless the office has asked you for them in writing since it can take many weeks until they are returned"
    rows = []
    for i in range(60):
        own = [word() for _ in range(80)]
        broken = notice.split(" ")
        at = 5 + i % 20
        broken[at] = "\n" + broken[at]
        rows.append((f"d{i}", "one" if i < 40 else "two", " ".join(own[:40]) + (" " + " ".join(broken) + " " if i < 40 and i % 2 else " ") + " ".join(own[40:])))
    rows += [rows[1], ("n", "one", None), ("e", "one", ""), (None, "one", "x"), ("x", None, notice)]
    df = spark.createDataFrame(rows, "id string, site string, text string").withColumn("first", F.lit(1))
    texts = {k: t for k, _, t in rows}
    for bits in (23, 3):
        found = boilerplate.repeated_spans(df, "id", "site", "text", sieve_bits=bits)
        covered = Counter()
        for r in found.collect():
            assert int(r["id"][1:]) % 2 and int(r["id"][1:]) < 40
            piece = " ".join(texts[r["id"]][r["first"] - 1 : r["last"]].split())
            assert piece in notice
            covered[r["id"]] += len(piece)
        assert len(covered) == 20 and min(covered.values()) > 0.5 * len(notice)
    kept = {r["id"]: r["text"] for r in boilerplate.without_spans(df.select("id", "text").distinct(), "id", "text", found).collect()}
    assert len(kept["d1"]) == len(texts["d1"]) - sum(r["last"] - r["first"] + 1 for r in found.collect() if r["id"] == "d1") and kept["d0"] == texts["d0"]
    assert boilerplate.repeated_spans(df.limit(0), "id", "site", "text").count() == 0


def brute_pieces(text, limit, overlap, min_fill):
    """Ends found by looking at every boundary, for texts of one byte a character."""
    off = token_offsets(text).tolist()
    n = len(off) - 1
    places = [(kind, {max(i for i, o in enumerate(off) if o <= m.end()) for m in pattern.finditer(text)}) for kind, pattern in splitting.BOUNDARIES]
    s, low, out = 0, 0, []
    while n - s > limit:
        end, kind = s + limit, "hard"
        inside = [(k, max(b for b in at if low < b <= s + limit)) for k, at in places if any(low < b <= s + limit for b in at)]
        full = [x for x in inside if x[1] - s >= min_fill * limit]
        if full:
            kind, end = full[0]
        elif inside:
            kind, end = max(inside, key=lambda x: x[1])
        out.append((off[s], off[end], kind))
        s, low = max(end - overlap, 0) if end - overlap > s else end, end
    return [*out, (off[s], off[n], "end")]


def test_pieces_are_those_of_a_plain_search():
    rng = random.Random(11)
    for _ in range(25):
        text = "The"
        for _ in range(rng.randint(20, 300)):
            text += rng.choice([" the", " page", " and", " work", " of", ".", ". The", "\n\nThe", "\n## The", "\nThe"] + [" time"] * rng.randint(1, 12))
        for limit, overlap in ((20, 0), (32, 5), (50, 12)):
            got = [(a, b, kind) for a, b, n, kind in splitting.split_text(text, limit, overlap) if n <= limit]
            want = brute_pieces(text, limit, overlap, 0.5)
            counts = TokenCounter().count
            if all(counts(text[a:b]) <= limit for a, b, _ in want):
                assert got == want, (limit, overlap, text)


def test_word_chunks_fall_into_step_again():
    rng = random.Random(2)
    word = lambda: rng.getrandbits(64)
    passage = [word() for _ in range(200)]

    def ends(*docs):
        flat = [x for d in docs for x in d]
        return boilerplate.word_chunks(np.array(flat, np.uint64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])).tolist()

    inner = [{e - k for e in ends([word() for _ in range(k)] + passage + [word() for _ in range(9)]) if 8 <= e - k <= 190} for k in (0, 7, 23)]
    assert inner[0] == inner[1] == inner[2] and len(inner[0]) > 12
    every = ends(passage)
    assert every[-1] == 200 and min(b - a for a, b in zip(every, every[1:-1], strict=False)) > 4
    both = ends(passage[:90], passage)
    assert both == ends(passage[:90]) + [90 + e for e in every], "documents do not touch each other"
    assert ends([]) == [] and ends([5]) == [1] and ends([7] * 30)[-1] == 30 and ends([1], [2], [3]) == [1, 2, 3]
