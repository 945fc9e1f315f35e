"""Ranking, ledger, response tables, collections and the stream on small fixtures."""

import json
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmill.operators import ann, chunking, curation, ledger, questions, ranking, reasoning, responses, scoring
from siltmill.plans import ranking_queries
from siltmill.sources import collections, corpus
from siltmill.streaming import ingest


def test_exact_search_and_ties(spark):
    rows = [(i, [float(i % 3), 1.0, 0.0]) for i in range(30)] + [(98, [0.0, 0.0, 0.0]), (99, None)]
    v = spark.createDataFrame(rows, "id long, v array<float>")
    q = spark.createDataFrame([(1, [0.0, 2.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0])], "q long, v array<float>")
    got = [(r["q"], r["id"], r["rank"]) for r in ranking.exact_search(q, "q", "v", v, "id", "v", 4).orderBy("q", "rank").collect()]
    assert got == [(1, 0, 1), (1, 3, 2), (1, 6, 3), (1, 9, 4)]


def test_exact_search_of_many_questions_with_text_ids(spark):
    rng = np.random.default_rng(3)
    rows, asked = rng.integers(-3, 4, (8000, 6)).astype(float), rng.integers(-3, 4, (4000, 6)).astype(float)
    v = spark.createDataFrame([(f"c{i:05d}", x) for i, x in enumerate(rows.tolist())], "id string, v array<double>")
    q = spark.createDataFrame(list(enumerate(asked.tolist())), "q long, v array<double>")
    began = time.time()
    got = sorted(tuple(r) for r in ranking.exact_search(q, "q", "v", v, "id", "v", 7, block=1500).select("q", "rank", "id").collect())
    assert time.time() - began < 15  # sorting whole batches of text ids for each question takes far longer
    with np.errstate(invalid="ignore"):
        sims = np.nan_to_num(np.round((asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ (rows / np.linalg.norm(rows, axis=1, keepdims=True)).T, 12), nan=-np.inf)
    want = [(i, n + 1, f"c{j:05d}") for i, x in enumerate(sims) for n, j in enumerate(np.argsort(-x, kind="stable")[:7].tolist()) if np.isfinite(x[j])]
    assert got == want


def test_ann_recall_against_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)] + [(1000, None), (1001, [0.0] * 16)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.filter("id % 20 = 0").withColumnRenamed("id", "q")
    exact = {(r["q"], r["id"]) for r in ranking.exact_search(q, "q", "v", v, "id", "v", 10).collect()}
    index = ann.build(v, "id", "v")
    assert index.rows.count() == 600
    near = {(r["q"], r["id"]) for r in ann.search(index, q, "q", "v", 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_bm25_against_a_model(spark):
    rng = random.Random(2)
    docs = [(f"d{i:02d}", " ".join(rng.choice(["fee", "form", "port", "visa", "the", "x1"]) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    toks = {d: [w for w in t.split() if w != "the"] for d, t in docs}
    avg, n = sum(map(len, toks.values())) / len(toks), len(toks)
    query = "the visa form form"
    scores = {}
    for d, t in toks.items():
        tf, s = Counter(t), 0.0
        for w in {"visa", "form"}:
            df = sum(w in x for x in toks.values())
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s > 0:
            scores[d] = s
    want = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:7]
    got = ranking.bm25(spark.createDataFrame([("q", query)], "q string, t string"), "q", "t", spark.createDataFrame(docs, "id string, text string"), "id", "text", 7).orderBy("rank").collect()
    assert [r["id"] for r in got] == want and abs(got[0]["score"] - scores[want[0]]) < 1e-9


def test_lexical_search_in_many_blocks(spark):
    rng = random.Random(5)
    text = lambda most: " ".join(rng.choice(["fee", "form", "port", "visa", "pass", "x1"]) for _ in range(rng.randint(0, most)))
    docs = spark.createDataFrame([(f"d{i:03d}", text(12)) for i in range(300)], "id string, text string")
    asked = spark.createDataFrame([(i, text(3)) for i in range(40)], "q int, t string")
    search = lambda most, block: sorted((r["q"], r["rank"], r["id"], round(r["score"], 9)) for r in ranking.lexical_search(ranking.lexical_index(docs, "id", "text", most=most), asked, "q", "t", "id", 6, block).collect())
    one = search(2_000_000, 65536)
    assert one and search(100, 7) == one


LISTS = [("q", 0, 1, "a"), ("q", 0, 2, "b"), ("q", 1, 1, "b"), ("q", 1, 2, "c"), ("q", 1, 3, "a"), ("p", 0, 1, "z")]


def test_fusion(spark):
    df = spark.createDataFrame(LISTS, "q string, list_no int, rank int, id string")
    got = ranking.rrf(df, "q", "list_no", "rank", "id", 10).filter("q = 'q'").orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "a", "c"] and abs(got[0]["rrf_score"] - (1 / 62 + 1 / 61)) < 1e-12
    assert [r["id"] for r in ranking.round_robin(df, "q", "list_no", "rank", "id", 2).filter("q = 'q'").orderBy("fused_rank").collect()] == ["a", "b"]


def test_limits_are_taken_before_the_shuffle(spark):
    df = spark.createDataFrame(LISTS, "q string, list_no int, rank int, id string")
    plan = ranking.top(df, ["q"], [F.asc("rank")], 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_multihop_metrics(spark):
    df = spark.createDataFrame([("a", [1, 7]), ("b", [None, 3]), ("c", [None, None]), ("d", [])], "i string, r array<int>")
    m = scoring.multihop_metrics(df, "i", "r").first()
    assert m["num_items"] == 3 and abs(m["joint_hit10"] - 1 / 3) < 1e-12 and m["joint_hit5"] == 0 and abs(m["hit5"] - 2 / 3) < 1e-12
    assert abs(m["passage_recall5"] - 1 / 3) < 1e-12 and abs(m["mrr_first"] - (1 + 1 / 3) / 3) < 1e-12 and abs(m["passage_mrr"] - (1 + 1 / 7 + 1 / 3) / 6) < 1e-12


def test_failure_types(spark):
    rows = [("judge", "correct", True, True), (None, "correct", True, False), (None, "partial", True, False), (None, "partial", True, True), (None, "correct", False, True), (None, None, None, None)]
    df = spark.createDataFrame(rows, "e string, v string, g boolean, q boolean")
    got = [r[0] for r in df.select(scoring.failure_type(F.col("e"), F.col("v"), F.col("g"), F.col("q"))).collect()]
    assert got == ["error", None, "retrieval", "reading", "hallucination", "reading"]


def test_ledger(spark):
    runs = spark.createDataFrame([(1, "h1", 0.5, {"k": "5"}), (2, None, 0.9, {"k": "5", "r": "x"}), (3, "h2", None, {"k": "6"}), (4, "h1", 0.5, {"k": "6"})], "seq int, h string, hit5 double, config map<string,string>")
    assert {r["seq"]: r["version"] for r in ledger.version_labels(runs, "h", "seq").collect()} == {1: "v1", 2: None, 3: "v2", 4: "v1"}
    assert [r["seq"] for r in ledger.best_runs(runs.filter("h = 'h1'"), ["h"], ["hit5"], ["seq"]).collect()] == [1]
    diff = {r["seq"]: r["config_diff"] for r in ledger.with_previous(runs.withColumn("g", F.lit(1)), ["g"], ["seq"], "config").collect()}
    assert diff[2] == {"r": [None, "x"]} and diff[3] == {"k": ["5", "6"], "r": ["x", None]} and diff[4] == {} and diff[1] == {"k": [None, "5"]}
    rows = spark.createDataFrame([("a", "i", 3), ("a", "j", None), ("a", "k", 1), ("b", "i", 2), ("b", "j", None), ("b", "l", 1)], "run string, item string, rank int")
    got = {r["item"]: r["change"] for r in ledger.compare(rows, "run", "item", "rank", F.lit("a"), F.lit("b")).collect()}
    assert got == {"i": "improved", "j": "unchanged", "k": "only_first", "l": "only_second"}
    old, new = spark.createDataFrame([("a", 0.1)], "run string, m double"), spark.createDataFrame([("a", 0.9, 0.7)], "run string, m double, m2 double")
    assert tuple(ledger.rescore(old, new, "run", ["m", "m2"]).first()) == ("a", 0.1, 0.7)
    items = spark.createDataFrame([("b", "q", None), ("a", "q", None)], "id string, question string, gold_passages array<struct<url:string,content_hash:string,quote:string>>")
    one, two = ledger.eval_set_fingerprint(items).first(), ledger.eval_set_fingerprint(items.orderBy("id").union(items)).first()
    assert one == two and len(one["fingerprint"]) == 12 and one["n_items"] == 2
    other = ledger.eval_set_fingerprint(items.withColumn("question", F.when(F.col("id") == "a", "").otherwise(F.col("question")))).first()
    assert other["fingerprint"] != one["fingerprint"] and other["n_items"] == 2
    both = ledger.eval_set_fingerprint(items.withColumn("r", F.lit(1)).unionByName(items.limit(1).withColumn("r", F.lit(2))), ["r"]).collect()
    assert len({r["fingerprint"] for r in both}) == 2 and ledger.eval_set_fingerprint(items.limit(0)).first()["n_items"] == 0
    wide = {r["item"]: (r["runs"], r["n_runs"]) for r in ledger.run_ranks(rows, "run", "item", F.col("rank")).collect()}
    assert wide == {"i": ("a=3 b=2", 2), "j": ("a=- b=-", 2), "k": ("a=1", 1), "l": ("b=1", 1)}
    labelled = spark.createDataFrame([(1, "v1"), (2, "v1"), (3, "v2"), (4, None), (5, None)], "seq int, version string")
    assert [r["starts"] for r in ledger.version_starts(labelled, ["seq"]).orderBy("seq").collect()] == [True, False, True, True, False]


def test_responses(spark):
    req = spark.createDataFrame([("q1",), ("q2",)], "user string").withColumn("key", responses.request_key("m", "p", "v1", F.col("user")))
    cache = req.filter("user = 'q1'").select("key", F.lit('{"queries": [" a ", "", "b", 3]}').alias("response"), F.lit(1).alias("seq"))
    cache = cache.unionByName(req.filter("user = 'q1'").select("key", F.lit("old").alias("response"), F.lit(0).alias("seq")))
    assert [r["user"] for r in responses.missing(req, cache).collect()] == ["q2"]
    got = responses.answered(req.filter("user = 'q1'"), cache).select(responses.decomposed(F.col("user"), F.col("response"))).first()[0]
    assert got == ["a", "b"]
    kept = responses.captured(req, cache, "rag").select("user", "error.stage").collect()
    assert sorted((r["user"], r["stage"]) for r in kept) == [("q1", None), ("q2", "rag")]
    with pytest.raises(Exception, match="no response"):
        responses.answered(req, cache).collect()
    said = spark.createDataFrame([('{"category": "Multi-Hop"}',), ("{",), (None,)], "r string")
    assert [r[0] for r in said.select(responses.route(F.col("r"))).collect()] == ["multi-hop", "unknown", "unknown"]
    votes = spark.createDataFrame([("t", 0, "None"), ("t", 1, "Yes."), ("t", 2, "no"), ("t", 3, " yes"), ("u", 0, "none"), ("u", 1, None), ("u", 2, "x"), ("w", 0, "b"), ("w", 1, "a")], "t string, i int, a string")
    assert {r["t"]: r["answer"] for r in responses.majority(votes, ["t"], "a", "i").collect()} == {"t": "Yes.", "u": None, "w": "b"}
    ask = spark.createDataFrame([("temporal", "q", "g", ["x", None], "a"), ("single-fact", None, None, [], None)], "c string, q string, g string, l array<string>, a string")
    told = [r[0] for r in ask.select(responses.judge_request(F.col("c"), F.col("q"), F.col("g"), F.col("l"), F.col("a"))).collect()]
    assert responses.JUDGE_RULES["temporal"] in told[0] and "- x\n- \n" in told[0] and "RULE" not in told[1] and "(none)" in told[1]


def test_reasoning_trees(spark):
    flat, deep = '{"question": "a"}', '{"question": "a", "children": [{"question": "b", "children": [{"question": "d"}]}, {"question": "c"}]}'
    bad = '{"question": "a", "children": [{"question": " "}]}'
    trees = spark.createDataFrame([("q/0", flat), ("q/1", deep), ("q/2", deep), ("q/3", bad), ("q/4", "nonsense"), ("q/5", '{"question": "", "children": [{"question": "b"}]}'), ("q/6", json.dumps({"question": "a", "pattern": "parallel", "children": [{"question": str(i)} for i in range(6)]}))], "tree string, response string")
    nodes = responses.tree_nodes(trees, "tree", "response")
    shapes = responses.tree_shapes(nodes)
    got = {r["tree"]: (r["depth"], r["n_nodes"], r["n_leaves"]) for r in shapes.collect()}
    assert got == {"q/0": (0, 1, 1), "q/1": (2, 4, 2), "q/2": (2, 4, 2), "q/3": (0, 1, 1), "q/6": (1, 5, 4)}
    patterns = {(r["tree"], r["node_id"]): r["pattern"] for r in nodes.collect()}
    assert patterns["q/6", "0"] == "parallel" and patterns["q/1", "0"] == patterns["q/3", "0"] == "direct"
    named = shapes.withColumns({"q": F.split_part("tree", F.lit("/"), F.lit(1)), "s": F.split_part("tree", F.lit("/"), F.lit(2)).cast("int")})
    assert [tuple(r) for r in responses.modal_tree(named, "q", "s").collect()] == [("q", 0)]
    assert [tuple(r) for r in responses.modal_tree(named.filter("s <> 3"), "q", "s").collect()] == [("q", 1)]


def test_chain_and_passages(spark):
    first = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("p", 1, "z")], "q string, rank int, id string")
    second = spark.createDataFrame([("q", 0, 1, "c"), ("q", 0, 2, "a")], "q string, list_no int, rank int, id string")
    got = responses.chain_hop(first, second, "q", "rank", "id", 10).orderBy("q", "rank").collect()
    assert [(r["q"], r["id"]) for r in got] == [("p", "z"), ("q", "a"), ("q", "c"), ("q", "b")]
    assert responses.passages(first.withColumn("t", F.upper("id")), "q", "rank", "t", 1).filter("q = 'q'").first()["context"] == "[1] A"


def test_settings_are_checked():
    for wrong in ({"fusion": "x"}, {"search": "y"}, {"bm25_k": 5}):
        with pytest.raises(ValueError):
            questions.Settings(**wrong)


def test_collections(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    path, settings = f"file://{tmp_path}/c", {"chunk_size": 180, "dedupe": True}
    collections.write_collection(rows, path, settings)
    with pytest.raises(Exception, match="(?i)exist"):
        collections.write_collection(rows, path, settings)
    assert collections.open_collection(spark, path, settings).count() == 2
    with pytest.raises(ValueError, match="chunk_size"):
        collections.open_collection(spark, path, {"chunk_size": 90, "dedupe": True})
    collections.upsert(spark, path, spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int"), "id")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        collections.append_missing(rows, cache, ["id"])
    assert spark.read.parquet(cache).count() == 2
    one = collections.record_run(rows, rows.limit(1), f"file://{tmp_path}/r", f"file://{tmp_path}/ledger")
    two = collections.record_run(rows, rows.limit(1), f"file://{tmp_path}/r", f"file://{tmp_path}/ledger")
    assert two == one + "-2" and spark.read.json(f"file://{tmp_path}/ledger").count() == 2
    assert "| a  | 1 |" in collections.box_table(rows)
    sheet = collections.review_sheet(spark.createDataFrame([("i", "q?", "x", 1)], "id string, question string, category string, place int"))
    assert sheet == "## x\n\n- [ ] i: q?\n"


def test_jsonl_sources(spark, tmp_path):
    assert corpus.jsonl(spark, f"file://{tmp_path}/none.jsonl", "id string").count() == 0
    (tmp_path / "m.jsonl").write_text('{"seq": 0, "key": "k", "status": 200}\n\n{"seq": 1, "key": null, "status": 404}\n')
    (tmp_path / "text").mkdir()
    (tmp_path / "text/k.txt").write_text("# T\nbody")
    (tmp_path / "text/o.txt").write_text("other")
    pages = corpus.pages(corpus.jsonl(spark, f"file://{tmp_path}/m.jsonl", corpus.MANIFEST), corpus.page_texts(spark, f"file://{tmp_path}"))
    assert [(r["key"], r["text"]) for r in pages.collect()] == [("k", "# T\nbody")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text(f'{{"key": "k{i}", "title": "T", "content_hash": "h", "text": "one two three"}}\n')
    for _ in range(2):
        ingest.append_chunks(ingest.chunk_stream(ingest.read_pages(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["k0_h_0", "k1_h_0", "k2_h_0"]


def test_candidates_hold_the_dense_hits(spark, tmp_path):
    texts = [f"title\n{w} permit" for w in ("red", "green", "blue", "grey")] + [f"other{i}\nnothing {i} at all" for i in range(20)]
    spark.createDataFrame([(f"c{i:02d}", t, "u") for i, t in enumerate(texts)], "id string, text string, url string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([("q", "grey permit")], "id string, question string").write.parquet(str(tmp_path / "eval_items.parquet"))
    rows = ranking_queries.dense_candidates(spark, str(tmp_path)).orderBy("rank").collect()
    dense = [r for r in rows if r["sim"] is not None]
    vecs = spark.createDataFrame([("grey permit",)] + [(t,) for t in texts], "t string").select("t", ranking.hashed_vector(F.col("t")).alias("v")).collect()
    q, vs = np.array(vecs[0]["v"], float), [np.array(r["v"], float) for r in vecs[1:]]
    sims = [float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)) for v in vs]
    want = sorted(range(len(texts)), key=lambda i: (-round(sims[i], 9), i))[:10]
    assert [r["sim"] for r in dense] == pytest.approx([sims[i] for i in want], abs=1e-5) and dense[0]["id"] == "c03"
    assert {r["id"] for r in rows} >= {"c00", "c01", "c02", "c03"}


def test_retrieve_does_what_the_settings_say(spark):
    texts = [("a0", "grey permit office", "p1?x=1"), ("a1", "grey permit office desk", "p1"), ("b0", "grey permit", "p2"), ("b1", "Grey  permit", "p3"), ("c0", "blue fee table", "p4")]
    chunks = spark.createDataFrame([(i, t, "https://e.org/" + u) for i, t, u in texts], "id string, text string, url string")
    items = spark.createDataFrame([("q", "grey permit")], "item string, question string")

    def run(k=10, cache=None, sections=None, **changed):
        s = questions.Settings(**{"search": "exact", "reranker": "overlap", "bm25_k": 5, **changed})
        return questions.retrieve(items, "item", "question", chunks, k, s, sections, cache).orderBy("rank").collect()

    assert {r["id"] for r in run()} >= {"a0", "a1", "b0", "b1"}
    paged = run(k=3, collapse_pages=True)
    assert len({r["url"].split("?")[0] for r in paged}) == 3 and [r["rank"] for r in paged] == [1, 2, 3]
    assert "b1" not in {r["id"] for r in run(dedupe=True)}
    assert [r["id"] for r in run(search="hnsw", bm25_k=0, reranker=None)][0] in ("b0", "b1")
    words = "grey permit office desk".split()
    sections = spark.createDataFrame([("a0", "p1#0", "t | h", words, 0, 3), ("a1", "p1#0", "t | h", words, 0, 4)], "id string, section string, head string, words array<string>, start int, n_words int")
    units = {r["unit"]: r for r in run(expand=True, sections=sections)}
    assert units["p1#0[0:4]"]["text"] == "t | h\ngrey permit office desk" and {"b0", "b1"} <= set(units)
    assert len([u for u in units if u.startswith("p1")]) == 1
    hop = questions.Settings(search="exact", k=2, reranker="overlap", chain_hops=2, chain_context_k=1)
    asked = questions.chain_requests(items, "item", "question", questions.first_hop(items, "item", "question", chunks, hop), chunks, hop, None, "gpt-5-mini")
    cache = asked.select("key", F.lit('{"queries": ["blue fee table"]}').alias("response"), F.lit(0).alias("seq"))
    got = questions.retrieve(items, "item", "question", chunks, 10, hop, None, cache).orderBy("rank").collect()
    assert got[0]["id"] in ("b0", "b1") and got[1]["id"] == "c0"
    for wrong in ({"expand": True}, {"chain_hops": 2}, {"chain_hops": 3}, {"reranker": "model"}):
        with pytest.raises(ValueError):
            run(**wrong)
    pages = spark.createDataFrame([("k", "h", "t", "## A\none two three", "u")], "key string, hash string, title string, text string, url string")
    assert [tuple(r) for r in chunking.section_index(pages, "key", "hash", "title", "text", "url").collect()] == [("k_h_0", "u#0", "t | A", ["one", "two", "three"], 0, 3)]


def test_upsert_keeps_a_table_at_all_times(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    collections.upsert(spark, path, rows, "id")
    collections.upsert(spark, path, spark.createDataFrame([("b", 3), ("b", 3), ("c", 4)], "id string, n int"), "id")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["c"]


def test_box_table_wraps_and_tells_of_more(spark):
    shown = collections.box_table(spark.createDataFrame([("x" * 90, 1), ("y", None), ("z", 3)], "a string, b int"), most=2, width=40)
    assert shown.count("x") == 90 and "| y " in shown and "z" not in shown and shown.endswith("… and more rows")


def test_approved_ids_must_be_candidates(spark):
    rows = spark.createDataFrame([("a", "temporal"), ("b", "temporal")], "id string, category string")
    assert [tuple(r) for r in curation.approved_items(rows, ["b"]).collect()] == [("b", "temporal", "human")]
    with pytest.raises(ValueError, match="no candidates"):
        curation.approved_items(rows, ["b", "zz"])
    assert [r["id"] for r in curation.chosen(rows, "temporal", 1).collect()] == ["a"] and curation.chosen(rows, "other").count() == 0
    report = spark.createDataFrame([("unchanged",), ("BROKEN",)], "status string")
    assert curation.gold_status(report)[1] and not curation.gold_status(report.filter("status = 'unchanged'"))[1]


def test_embed_cached_embeds_what_is_missing_once(spark):
    texts = spark.createDataFrame([("a", 1), ("bb", 2), ("bb", 3), (None, 4), ("", 5)], "t string, n int")
    cache = spark.createDataFrame([("m", "a", [9.0]), ("other", "bb", [7.0])], "model string, t string, vec array<double>").select("model", F.sha2("t", 256).alias("text_hash"), "vec")
    found, new = ranking.embed_cached(texts, "t", cache, "m", ranking.embedder(lambda xs: [[len(x)] for x in xs]))
    assert {r["n"]: r["vec"] for r in found.collect()} == {1: [9.0], 2: [2.0], 3: [2.0], 4: None, 5: [0.0]}
    assert new.count() == 2 and {r["model"] for r in new.collect()} == {"m"}


def test_reasoning_traversal(spark):
    tree = {"question": "root", "pattern": "sequential", "children": [{"question": "who"}, {"question": "where is [answer 1]"}]}
    plain = {"question": "lost"}
    trees = spark.createDataFrame([("t", json.dumps(tree)), ("u", json.dumps(plain))], "tree string, response string")
    nodes = responses.tree_nodes(trees, "tree", "response")

    def search(asked):
        return asked.select("tree", "node_id", F.explode(F.array(*[F.struct(F.concat("query", F.lit(f"#{i}")).alias("id"), F.lit(i).alias("rank"), F.concat(F.lit(f"text {i} of "), "query").alias("text")) for i in (1, 2)])).alias("h")).select("tree", "node_id", "h.*")

    def leaf(q):
        return f"QUESTION:\n{q}\n\nPASSAGES:\n[1] text 1 of {q}\n\n[2] text 2 of {q}"

    said = [("rt_answer", leaf("who"), {"answer": "Ann"}), ("rt_answer", leaf("where is Ann"), {"answer": "None"}), ("rt_rewrite", "where is Ann\n(rewrite #1)", {"query": " Ann's place "}), ("rt_answer", leaf("Ann's place"), {"answer": "home"}),
            ("rt_combine", "QUESTION:\nroot\n\nSUB-ANSWERS:\n- who: Ann\n- where is Ann: home", {"answer": "Ann, at home"}), ("rt_answer", leaf("lost"), {"answer": ""}), ("rt_rewrite", "lost\n(rewrite #1)", {})]
    cache = spark.createDataFrame([(p, u, json.dumps(r)) for p, u, r in said], "p string, u string, response string")
    keyed = None
    for p in {p for p, _, _ in said}:
        part = cache.filter(F.col("p") == p).select(responses.request_key("m", p, "v1", F.col("u")).alias("key"), "response", F.lit(1).alias("seq"))
        keyed = part if keyed is None else keyed.unionByName(part)
    out = reasoning.traverse(nodes, search, keyed, "m", 10, rewrites=1)
    assert {(r["tree"], r["node_id"]): r["answer"] for r in out.answers.collect()} == {("t", "0"): "Ann, at home", ("t", "0.0"): "Ann", ("t", "0.1"): "home", ("u", "0"): None}
    assert [(r["tree"], r["list_no"], r["query"]) for r in out.steps.orderBy("tree", "list_no").collect()] == [("t", 0, "who"), ("t", 1, "where is Ann"), ("t", 2, "Ann's place"), ("u", 0, "lost"), ("u", 1, "lost")]
    hits = [(r["tree"], r["id"]) for r in out.hits.orderBy("tree", "rank").collect()]
    assert hits == [("t", "who#1"), ("t", "where is Ann#1"), ("t", "Ann's place#1"), ("t", "who#2"), ("t", "where is Ann#2"), ("t", "Ann's place#2"), ("u", "lost#1"), ("u", "lost#2")]


def test_retrieve_with_given_tools_routes_and_model_splits(spark):
    chunks = spark.createDataFrame([(x, x * 3, f"https://e.org/{x}") for x in "abcd"], "id string, text string, url string")
    items = spark.createDataFrame([("q1", "aa"), ("q2", "bb")], "item string, question string")
    embed = ranking.embedder(lambda texts: [[t.count(c) + 0.01 for c in "abcd"] for t in texts])
    tools = questions.Tools(embed, {"last": lambda q, t: F.ascii(t).cast("double")})
    hits = lambda s, cache=None: {(r["item"], r["rank"]): r["id"] for r in questions.retrieve(items, "item", "question", chunks, 10, s, None, cache, tools).collect()}
    plain = questions.Settings(search="exact", k=4)
    assert hits(plain)["q1", 1] == "a" and hits(plain)["q2", 1] == "b"
    assert [hits(questions.Settings(search="exact", k=4, reranker="last"))["q1", i] for i in (1, 2, 3, 4)] == list("dcba")
    with pytest.raises(ValueError, match="unknown reranker"):
        hits(questions.Settings(reranker="none of these"))
    assert hits(questions.Settings(search="exact", k=4, query_prefix="ccccc"))["q1", 1] == "c"
    key = lambda prompt, user: responses.request_key("gpt-5-mini", prompt, "v1", user)
    said = lambda prompt, response: items.select(key(prompt, F.col("question")).alias("key"), response.alias("response"), F.lit(1).alias("seq"))
    split = questions.Settings(search="exact", k=4, split_queries=True, split_method="llm", fusion="round_robin")
    parts = hits(split, said("decompose", F.when(F.col("item") == "q1", '{"queries": ["c", "d"]}').otherwise("{}")))
    assert [parts["q1", i] for i in (1, 2)] == ["c", "d"] and parts["q2", 1] == "b"
    with pytest.raises(ValueError, match="response table"):
        hits(split)
    chain = questions.Settings(search="exact", k=2, chain_hops=2, chain_context_k=1, route="llm")
    first = questions.first_hop(items, "item", "question", chunks, chain, tools)
    follow = questions.chain_requests(items, "item", "question", first, chunks, chain, None, "gpt-5-mini").filter("item = 'q1'").select("key", F.lit('{"missing": "d", "queries": ["d"]}').alias("response"), F.lit(1).alias("seq"))
    routes = said("route", F.when(F.col("item") == "q1", '{"category": "multi-hop"}').otherwise('{"category": "temporal"}'))
    both = hits(chain, routes.unionByName(follow))
    assert [both["q1", i] for i in (1, 2)] == ["a", "d"] and both["q2", 1] == "b" and "d" not in [both["q2", i] for i in (1, 2)]


def test_settings_from_a_file(tmp_path):
    path = tmp_path / "plain_c180.yaml"
    path.write_text("# a comment\nembedding_model: some/model\nchunk_size: 180  # words\nchunk_overlap: 30\ntop_k_retrieve: 100\nreranker: null\nsplit_queries: true\nfusion: round_robin\nchain_categories:\n  - multi-hop\n  - temporal\n")
    name, own, run = questions.load_settings(str(path))
    assert name == "plain_c180" and own == {"embedding_model": "some/model", "chunk_size": 180, "chunk_overlap": 30, "dedupe_chunks": False}
    assert run == questions.Settings(k=100, split_queries=True, fusion="round_robin", chain_categories=("multi-hop", "temporal"))
    path.write_text("embedding_model: m\nchunk_size: 1\nchunk_overlap: 0\ncollection: other\nchain_categories: [temporal]\n")
    assert questions.load_settings(str(path))[0] == "other" and questions.load_settings(str(path))[2].chain_categories == ("temporal",)
    for bad, why in (("chunk_size: 1\nchunk_overlap: 0\n", "missing"), ("embedding_model: m\nchunk_size: 1\nchunk_overlap: 0\nfuse: x\n", "unknown"), ("embedding_model: m\nchunk_size: 1\nchunk_overlap: 0\nfusion: x\n", "unknown fusion")):
        path.write_text(bad)
        with pytest.raises(ValueError, match=why):
            questions.load_settings(str(path))


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.2 * rng.normal(size=(3000, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9000, None), (9001, [0.0] * 16)], "id long, v array<double>")
    index = ann.build(v, "id", "v")
    assert index.probe <= 0.1 and index.rows.count() == 3000
    q = v.filter("id % 50 = 0").withColumnRenamed("id", "q")
    true = {(r["q"], r["id"]) for r in ranking.exact_search(q, "q", "v", v, "id", "v", 10).collect()}
    near = {(r["q"], r["id"]) for r in ann.search(index, q, "q", "v", 10).collect()}
    assert len(true & near) >= 0.9 * len(true)


def test_a_pool_reads_each_side_once_and_makes_each_vector_once(spark):
    made = spark.sparkContext.accumulator(0)

    def embed(texts):
        made.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    of = ranking.embedder(embed)
    chunks = spark.createDataFrame([(f"c{i:02d}", "fee " * (i + 1)) for i in range(20)], "id string, text string")
    items = spark.createDataFrame([("q", "fee fee")], "item string, question string")
    dense = ranking.exact_search(items.select("item", of(F.col("question")).alias("v")), "item", "v", chunks.select("id", of(F.col("text")).alias("v")), "id", "v", 3)
    sparse = ranking.bm25(items, "item", "question", chunks, "id", "text", 5)
    pool = ranking.pool(dense.withColumnRenamed("sim", "score"), sparse, ["item"], "id")
    rows = pool.orderBy("rank").collect()
    assert made.value == 21
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and [r["id"] for r in rows][:3] == ["c01", "c02", "c03"] and sum(r["score"] is None for r in rows) == len(rows) - 3


def test_retrieve_prepares_a_text_once_for_all_hits(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        made.add(1)
        return text.split()

    def score(query, text):
        return F.size(F.array_intersect(words(query), words(text))) / F.lit(1)

    ranking.PREPARED[score] = (words, lambda q, t: F.size(F.array_intersect(q, t)) / F.lit(1))
    chunks = spark.createDataFrame([(f"c{i}", "grey permit " + "fee " * i, None) for i in range(6)], "id string, text string, url string")
    items = spark.createDataFrame([(f"q{i:02d}", "grey permit fee") for i in range(30)], "item string, question string")
    tools = questions.Tools(rerankers={"words": score})
    s = questions.Settings(search="exact", reranker="words", k=6)
    rows = questions.retrieve(items, "item", "question", chunks, 6, s, tools=tools).collect()
    del ranking.PREPARED[score]
    assert len(rows) == 180 and made.value <= 36
    assert {r["rank"] for r in rows if r["id"] == "c0"} == {6}
