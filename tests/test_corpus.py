"""Sections, windows, copies, lookups and the crawl against plain models."""

import random
import re
from collections import deque

from pyspark.sql import functions as F

from siltmill.operators import chunking, crawl, curation, scoring
from siltmill.plans import corpus_queries
from siltmill.sources import corpus

LINES = ["# A", "## B", "### C", "#### D", "##### five", "#tag", "text one", "  ", "more text", "- item"]


def model_sections(text):
    path, lines, out = [], [], []

    def close():
        body = "\n".join(lines).strip(" ")
        if body.strip():
            out.append((" > ".join(path), body))

    for line in text.split("\n"):
        m = re.match(r"^(#{1,4})\s+(.*)$", line)
        if m:
            close()
            path, lines = path[: len(m[1]) - 1] + [m[2].strip()], []
        else:
            lines.append(line)
    close()
    return [(i, *x) for i, x in enumerate(out)]


def test_sections(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 14))) for _ in range(150)] + ["# h1\nx\n### a\ny\n### b\nz"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: [tuple(x) for x in r["s"]] for r in df.select("i", chunking.sections(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == model_sections(t), repr(t)
    assert got[150][-1][1] == "h1 > a > b"
    assert spark.createDataFrame([(None,)], "t string").select(chunking.sections(F.col("t")).alias("s")).first()["s"] == []


def model_starts(n, size, overlap):
    out, st = [], 0
    while st < n:
        out.append(st)
        if st + size >= n:
            break
        st += size - overlap
    return out


def test_windows(spark):
    for size, overlap in ((180, 30), (10, 9), (7, 0)):
        df = spark.range(0, 400).select(F.col("id").cast("int").alias("n"))
        for r in df.select("n", chunking.window_starts(F.col("n"), size, overlap).alias("s")).collect():
            assert r["s"] == model_starts(r["n"], size, overlap)


def test_expanded_span(spark):
    rows = [(n, st, min(180, n - st)) for n in (1, 449, 450, 451, 900, 2000) for st in range(0, n, 150)]
    df = spark.createDataFrame(rows, "n int, st int, c int")
    for cap in (450, 100):
        first, words = chunking.expanded_span(F.col("n"), F.col("st"), F.col("c"), cap)
        for r in df.select("*", first.alias("f"), words.alias("w")).collect():
            want = 0 if r["n"] <= cap else max(0, min(r["st"] - (cap - r["c"]) // 2, r["n"] - cap))
            assert (r["f"], r["w"]) == (want, min(r["n"], cap))


def test_page_chunks_number_through_the_page(spark):
    text = "intro words here\n# One\n" + "w " * 400 + "\n## Two\nlast"
    df = spark.createDataFrame([("k", "h", "T", text, "u"), ("k2", "h", None, None, "u")], "key string, hash string, title string, text string, url string")
    rows = chunking.page_chunks(df, "key", "hash", "title", "text").orderBy("n").collect()
    assert [r["id"] for r in rows] == [f"k_h_{i}" for i in range(len(rows))] and [r["n_words"] for r in rows] == [3, 180, 180, 100, 1]
    assert rows[0]["text"] == "T\nintro words here" and rows[-1]["text"] == "T | One > Two\nlast" and [r["s"] for r in rows] == [0, 1, 1, 1, 2]


def test_quote_ranks(spark):
    df = spark.createDataFrame([(["the quick brown fox", "jumps over", None], ["quick ... over", "fox…missing", "...", None, "uick", "Brown  FOX"])], "t array<string>, q array<string>")
    from siltmill.functions.text import norm_text

    got = df.select(scoring.quote_ranks(F.col("q"), F.transform("t", norm_text))).first()[0]
    assert got == [2, None, None, None, None, 1]


def test_miss_group(spark):
    rows = [(5, True, True), (6, True, True), (50, True, True), (51, True, True), (None, True, True), (None, True, False), (9, False, False), (1, False, False)]
    df = spark.createDataFrame(rows, "r int, i boolean, c boolean")
    assert [x[0] for x in df.select(scoring.miss_group(F.col("r"), F.col("i"), F.col("c"))).collect()] == ["hit", "B", "B", "C", "C", "A", "0", "hit"]


def test_contained_anywhere(spark):
    frags = spark.createDataFrame([(" a b ",), (" b c ",), (" zz ",), (" a a ",), ("  ",)], "f string")
    texts = spark.createDataFrame([(" x a b c ",), (" b a ",)], "t string")
    assert sorted(r[0] for r in scoring.contained_anywhere(frags, "f", texts, "t").collect()) == [" a b ", " b c "]


def test_crawl(spark):
    links = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "c"), ("c", "s"), ("c", "d"), ("d", "e"), (None, "x"), ("a", None)], "src string, dst string")
    found = {r["url"]: r["depth"] for r in crawl.frontier(links, spark.createDataFrame([("s",)], "url string"), 3).collect()}
    assert found == {"s": 0, "a": 1, "b": 1, "c": 2, "d": 3}
    urls = ["mailto:x@e.org", "https://other.org/en/", "https://e.org/en/a.pdf", "https://e.org/de/x", "https://E.org/en/x?a=1", "https://e.org/en/b.html", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r["reason"] for r in crawl.classify(df, "url", "e.org", ["/en/"]).collect()][:6] == ["ignored", "off_host", "non_html_extension", "off_path", "enqueue", "enqueue"]
    allowed = crawl.allowed_by_robots("User-agent: *\nDisallow: /private", "bot")
    rows = spark.createDataFrame([("https://e.org/private/x",), ("https://e.org/x",)], "u string").select(allowed("u")).collect()
    assert [r[0] for r in rows] == [False, True] and crawl.allowed_by_robots(None, "bot") is None
    gate = spark.createDataFrame([(200, "text/html"), (404, "text/html"), (None, None), (200, "application/pdf")], "s int, c string").select(crawl.page_gate(F.col("s"), F.col("c")))
    assert [r[0] for r in gate.collect()] == [None, "status 404", "status none", "content type application/pdf"]


MANIFEST = [(0, "https://e.org/a", "K1", "H1"), (1, "https://e.org/b?x=1", "K2", "H2"), (2, "https://e.org/c?x=1", "K3", "H3"), (3, "https://e.org/c?x=2", "K4", "H4")]


def manifest(spark, rows):
    df = spark.createDataFrame(rows, "seq int, url string, key string, content_hash string")
    return df.withColumns({"final_url": F.col("url"), "status": F.lit(200), "date_modified": F.lit(None).cast("string")})


def test_find_page(spark):
    p = spark.createDataFrame([(1, "x", "H2"), (2, "https://e.org/a", "zz"), (3, "https://e.org/b", None), (4, "https://e.org/c", None), (5, None, None)], "i int, url string, content_hash string")
    assert {r["i"]: r["page_key"] for r in corpus.find_page(p, manifest(spark, MANIFEST)).collect()} == {1: "K2", 2: "K1", 3: "K2", 4: None, 5: None}


GOLD = "array<struct<url:string,content_hash:string,quote:string>>"


def test_check_gold_statuses(spark):
    items = spark.createDataFrame(
        [("i", "temporal", "high", "2026-01-01", [("https://e.org/a", "H1", "first quote"), ("https://e.org/b?x=1", "H2", "second"), ("u", "H3", "third"), ("u", "H4", "fourth"), ("u", "H3", "absent")])],
        f"id string, category string, stale_risk string, valid_until string, gold_passages {GOLD}",
    )
    old = manifest(spark, MANIFEST)
    new = manifest(spark, [(0, "https://e.org/a", "N1", "H1"), (1, "https://e.org/b?x=1", "N2", "new"), (2, "https://e.org/c?x=1", "N3", "new")])
    texts = spark.createDataFrame([("K1", "the first quote"), ("K2", "a second"), ("K3", "a third"), ("K4", "a fourth"), ("N1", "x"), ("N2", "a second time"), ("N3", "gone")], "key string, text string")
    got = {r["passage"]: (r["status"], r["stale"]) for r in curation.check_gold(items, old, texts, new, texts, "2026-06-01").collect()}
    assert [got[i][0] for i in range(5)] == ["unchanged", "changed-ok", "BROKEN", "MISSING", "BAD-GOLD"]
    assert got[0][1] == ["temporal", "high stale risk", "past valid_until"]


def test_validate_drafts(spark):
    kind = f"id string, question string, gold_passages {GOLD}"
    a = [("https://e.org/a", "H1", "first")]
    drafts = spark.createDataFrame([("d1", "q", a * 2), ("d2", "", [("https://e.org/a", "H1", "nowhere"), ("", "H1", "x")]), ("d3", "q", None), ("e1", "q", a), ("d4", "q", [("https://z.org", "?", "first")]), (None, "q", a)], kind)
    texts = spark.createDataFrame([("K1", "the first text")], "key string, text string")
    existing = spark.createDataFrame([("e1", "q", [])], kind)
    got = {r["id"]: r for r in curation.validate_drafts(drafts, existing, manifest(spark, MANIFEST), texts, spark.createDataFrame([("https://e.org/a",)], "url string")).collect()}
    assert (got["d1"]["status"], got["d1"]["flags"]) == ("pass", [])
    assert got["d2"]["reasons"] == ["no question", "passage without url", "quote not in page"]
    assert got["d3"]["reasons"] == ["no gold"] and got["d4"]["reasons"] == ["no page"] and got[None]["reasons"] == ["no id"]
    assert got["e1"]["status"] == "duplicate" and got["e1"]["reasons"] == ["id exists", "gold differs"]


def test_freeze_refuses_short_categories(spark):
    import pytest

    rows = spark.createDataFrame([(f"{c}{i}", c) for c in curation.CATEGORIES for i in range(2)], "id string, category string")
    assert curation.freeze(rows, rows.limit(0), least=2).count() == 12
    with pytest.raises(ValueError, match="too few"):
        curation.freeze(rows.filter("category <> 'temporal'"), rows.limit(0), least=2)


def model_frontier(links, seeds):
    out = {}
    for src, dst, place in sorted(links, key=lambda x: x[2]):
        out.setdefault(src, []).append(dst)
    found, queue = {s: (0, None) for s in sorted(seeds)}, deque(sorted(seeds))
    while queue:
        url = queue.popleft()
        for dst in out.get(url, []):
            if dst not in found:
                found[dst] = (found[url][0] + 1, url)
                queue.append(dst)
    return found


def test_crawl_reaches_every_page_with_its_first_parent(spark, tmp_path):
    rng = random.Random(3)
    urls = [f"u{i:02d}" for i in range(40)]
    rng.shuffle(urls)
    pairs = [(urls[i], urls[i + 1]) for i in range(12)] + [(urls[rng.randrange(i - 6, i)], urls[i]) for i in range(13, 40) for _ in range(2)]
    rng.shuffle(pairs)
    links = [(a, b, n) for n, (a, b) in enumerate(pairs)]
    seeds = [urls[0], urls[7]]
    want = model_frontier(links, seeds)
    assert max(d for d, _ in want.values()) > 4
    rows = [(n, b, a, None) for a, b, n in links] + [(100 + n, s, None, s) for n, s in enumerate(seeds)]
    spark.createDataFrame(rows, "seq int, url string, parent string, seed string").write.parquet(str(tmp_path / "pages_manifest.parquet"))
    got = corpus_queries.crawl_reach(spark, str(tmp_path)).collect()
    assert {r["url"]: (r["depth"], r["parent"]) for r in got} == want and len(got) == len(want)


def test_frontier_fetches_the_first_pages_of_the_queue(spark):
    links = spark.createDataFrame([("s", "b", 2), ("s", "a", 1), ("a", "c", 3), ("b", "d", 1), ("c", "s", 1)], "src string, dst string, place int")
    seeds = spark.createDataFrame([("s",)], "url string")
    assert [tuple(r) for r in crawl.frontier(links, seeds).orderBy("url").collect()] == [("a", 1, "s"), ("b", 1, "s"), ("c", 2, "a"), ("d", 2, "b"), ("s", 0, None)]
    assert {r["url"] for r in crawl.frontier(links, seeds, max_pages=4).collect()} == {"s", "a", "b", "c"}
    assert {r["url"] for r in crawl.frontier(links, seeds, max_depth=1).collect()} == {"s", "a", "b"}
