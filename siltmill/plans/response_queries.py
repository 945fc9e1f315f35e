"""Queries of the steps that a model answers, by tables of responses; of sinks, read back; of sources for answers.

The responses are made from recorded columns, as JSON, so that SQL can tell what must come out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmill.functions import text as tx
from siltmill.operators import chunking, ledger, questions, ranking, responses, scoring
from siltmill.plans.corpus_queries import _SECTIONS, _SPACE
from siltmill.plans.ranking_queries import _SPLIT, K, _bm25_sql, _chunks, _items
from siltmill.runtime import shared_dir, table
from siltmill.sources import collections, corpus

MODEL = "recorded"


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def _cached(requests: DataFrame, prompt: str, user: str, response: Column) -> tuple[DataFrame, DataFrame]:
    """Requests with their key, and the response table that answers them; each response is there twice, the first one wrong."""
    keyed = requests.withColumn("key", responses.request_key(MODEL, prompt, "v1", F.col(user)))
    right = keyed.select("key", response.alias("response"), F.lit(2).alias("seq")).distinct()
    return keyed, right.unionByName(right.select("key", F.lit("{}").alias("response"), F.lit(1).alias("seq")))


def llm_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches that a response names for each question: its parts, with blanks and empty ones; four at most."""
    items = _items(spark, sf_dir)
    parts = F.transform(tx.question_parts(F.col("question")), lambda p: F.concat(F.lit("  "), p, F.lit(" ")))
    requests, cache = _cached(items, "decompose", "question", _json(queries=F.concat(F.array(F.lit(" "), F.lit(None)), parts)))
    found = responses.answered(requests, cache).select("item", F.posexplode(responses.decomposed(F.col("question"), F.col("response"))).alias("list_no", "query"))
    return found


LLM_DECOMPOSE = f"""WITH {_SPLIT}, d AS (SELECT item, CASE WHEN len(p) >= 2 THEN list_transform(p[1:4], lambda x: trim(x)) ELSE [q] END AS p FROM q2)
SELECT item, CAST(unnest(range(len(p))) AS INTEGER) AS list_no, unnest(p) AS query FROM d"""


def _said(id_: Column, category: Column) -> Column:
    """The category that a response gives: now and then another one, in capitals, or none that there is."""
    digit = F.substring(F.sha2(id_, 256), 1, 1)
    return F.when(digit == "0", "something else").when(digit == "1", "multi-hop").when(digit == "2", F.upper(category)).otherwise(category)


_SAID = "CASE substr(sha256(id), 1, 1) WHEN '0' THEN 'unknown' WHEN '1' THEN 'multi-hop' ELSE coalesce(category, 'unknown') END"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items").filter("id is not null").select("id", "category", F.coalesce("question", F.lit("")).alias("question")).distinct()
    requests, cache = _cached(items.withColumn("user", F.concat_ws("\n", "id", "category", "question")), "route", "user", _json(category=_said(F.col("id"), F.col("category"))))
    return responses.answered(requests, cache).withColumn("predicted", responses.route(F.col("response")))


def route_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of items against those that a router's responses give."""
    rows = _routed(spark, sf_dir).select("id", "category", "predicted").distinct()
    return ledger.confusion(rows.withColumnRenamed("category", "gold"), "gold", "predicted").withColumn("accuracy", F.round("accuracy", 6))


_ROUTED = f"WITH p AS (SELECT DISTINCT id, category AS gold, {_SAID} AS predicted FROM eval_items WHERE id IS NOT NULL)"
ROUTE_CONFUSION = f"{_ROUTED} SELECT gold, predicted, count(*) AS n, round((SELECT avg(CASE WHEN gold = predicted THEN 1.0 ELSE 0 END) FROM p), 6) AS accuracy FROM p GROUP BY gold, predicted"


def router_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions take a second hop: those that the router calls multi-hop."""
    rows = _routed(spark, sf_dir)
    return rows.select("id", "predicted", responses.chains(F.col("predicted"), 2, ("multi-hop",)).alias("chains"), responses.chains(F.col("predicted"), 1, None).alias("one_hop")).distinct()


ROUTER_GATE = f"{_ROUTED} SELECT DISTINCT id, predicted, predicted = 'multi-hop' AS chains, FALSE AS one_hop FROM p"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, grounding and kind of failure from the responses of two judges; a result without response is kept as an error."""
    rows = table(spark, sf_dir, "e2e_rows").select("run_id", "id", "category", "question", "answer", "verdict", "reason", "grounded", "unsupported_claims", "quote_retrieved").distinct()
    user = responses.judge_request(F.col("category"), F.col("question"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.col("answer"))
    rows = rows.withColumn("user", F.concat_ws("\n", "run_id", "id", user))
    requests, cache = _cached(rows, "judge", "user", _json(verdict=F.col("verdict"), reason=F.col("reason"), grounded=F.col("grounded"), unsupported_claims=F.col("unsupported_claims")))
    cache = cache.filter(F.get_json_object("response", "$.verdict").isNotNull())
    found = responses.captured(requests.drop("verdict", "grounded", "unsupported_claims"), cache, "correctness_judge")
    there = F.col("error").isNull()
    found = found.withColumn("verdict", F.when(there, responses.verdict(F.col("response")))).withColumn("g", F.when(there, responses.grounding(F.col("response"))))
    kind = scoring.failure_type(F.col("error.stage"), F.col("verdict"), F.col("g.grounded"), F.col("quote_retrieved"))
    return found.select("run_id", "id", F.col("error.stage").alias("stage"), "verdict", F.col("g.grounded").alias("grounded"), F.coalesce(F.size("g.unsupported_claims"), F.lit(0)).alias("n_unsupported"), kind.alias("failure"))


JUDGED = """WITH r AS (SELECT DISTINCT run_id, id, category, question, answer, verdict, reason, grounded, unsupported_claims, quote_retrieved FROM e2e_rows)
SELECT run_id, id, CASE WHEN verdict IS NULL THEN 'correctness_judge' END AS stage, verdict, CASE WHEN verdict IS NOT NULL THEN grounded END AS grounded,
       CASE WHEN verdict IS NULL THEN 0 ELSE CAST(coalesce(len(unsupported_claims), 0) AS INTEGER) END AS n_unsupported,
       CASE WHEN verdict IS NULL THEN 'error' WHEN coalesce(verdict = 'correct' AND grounded, FALSE) THEN NULL WHEN coalesce(NOT quote_retrieved, FALSE) THEN 'retrieval'
            WHEN verdict <> 'correct' THEN 'reading' ELSE 'hallucination' END AS failure FROM r"""


def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the judge of correctness would be asked about each item's own gold answer, as a digest."""
    items = table(spark, sf_dir, "eval_items").select("id", "category", "question", "gold_answer", "answer", "gold_passages").distinct()
    gold = F.coalesce(F.nullif("gold_answer", F.lit("")), "answer")
    user = responses.judge_request(F.col("category"), F.col("question"), gold, F.transform("gold_passages", lambda p: p["quote"]), gold)
    return items.select("id", F.md5(user).alias("request"), F.length(user).alias("n_chars"))


_RULE = " ".join("WHEN '{}' THEN chr(10) || 'CATEGORY RULE: {}'".format(k, v.replace("'", "''")) for k, v in responses.JUDGE_RULES.items())
JUDGE_REQUESTS = f"""WITH i AS (SELECT DISTINCT id, category, question, gold_answer, answer, gold_passages FROM eval_items),
g AS (SELECT *, coalesce(coalesce(nullif(gold_answer, ''), answer), '') AS gold, array_to_string(list_transform(coalesce(gold_passages, []), lambda p: '- ' || coalesce(p.quote, '')), chr(10)) AS q FROM i),
u AS (SELECT id, 'CATEGORY: ' || coalesce(category, '') || coalesce(CASE category {_RULE} END, '') || chr(10) || chr(10) || 'QUESTION: ' || coalesce(question, '') || chr(10) || chr(10) || 'GOLD ANSWER: ' || gold
  || chr(10) || chr(10) || 'GOLD QUOTES:' || chr(10) || CASE WHEN q = '' THEN '(none)' ELSE q END || chr(10) || chr(10) || 'MODEL ANSWER:' || chr(10) || gold AS u FROM g)
SELECT id, md5(u) AS request, CAST(length(u) AS INTEGER) AS n_chars FROM u"""


def majority_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that most runs give to an item."""
    rows = table(spark, sf_dir, "e2e_rows").filter("id is not null").groupBy("run_id", "id").agg(F.min("answer").alias("answer"))
    return responses.majority(rows, ["id"], "answer", "run_id")


MAJORITY_ANSWERS = r"""WITH r AS (SELECT run_id, id, min(answer) AS answer FROM e2e_rows WHERE id IS NOT NULL GROUP BY ALL),
s AS (SELECT run_id, id, coalesce(nullif(trim(answer), ''), 'None') AS a FROM r),
n AS (SELECT *, regexp_replace(lower(a), '^[ .]+|[ .]+$', '', 'g') AS n FROM s),
c AS (SELECT id, n, count(*) AS c, min(struct_pack(r := run_id, a := a)) AS f FROM n GROUP BY ALL)
SELECT id, CASE WHEN n <> 'none' THEN f.a END AS answer FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, f) = 1"""


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reasoning tree for each item: its facts below the question, and below each of them the fact's first and last word."""
    items = table(spark, sf_dir, "eval_items").filter("id is not null").groupBy("id").agg(F.min(F.struct("question", "required_facts")).alias("x"))
    leaves = lambda f: F.transform(F.array(F.split_part(f, F.lit(" "), F.lit(1)), F.split_part(f, F.lit(" "), F.lit(-1))), lambda w: F.struct(w.alias("question")))
    child = lambda f: F.struct(f.alias("question"), F.lit("sequential").alias("pattern"), leaves(f).alias("children"))
    return items.select("id", _json(question=F.col("x.question"), pattern=F.lit("parallel"), children=F.transform("x.required_facts", child)).alias("response"))


def tree_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, nodes and leaves of those trees; of many facts the first four count."""
    return responses.tree_shapes(responses.tree_nodes(_trees(spark, sf_dir), "id", "response")).select(F.col("tree").alias("id"), "depth", "n_nodes", "n_leaves")


TREE_SHAPES = """WITH i AS (SELECT id, min(struct_pack(q := question, f := required_facts)) AS x FROM eval_items WHERE id IS NOT NULL GROUP BY id),
f AS (SELECT id, list_filter(coalesce(x.f, [])[1:4], lambda t: trim(coalesce(t, '')) <> '') AS f FROM i WHERE trim(coalesce(x.q, '')) <> ''),
k AS (SELECT id, f, CAST(coalesce(list_sum(list_transform(f, lambda t: (CASE WHEN trim(split_part(t, ' ', 1)) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(split_part(t, ' ', -1)) <> '' THEN 1 ELSE 0 END))), 0) AS BIGINT) AS w,
      len(list_filter(f, lambda t: trim(split_part(t, ' ', 1)) = '' AND trim(split_part(t, ' ', -1)) = '')) AS bare FROM f)
SELECT id, CASE WHEN w > 0 THEN 2 WHEN len(f) > 0 THEN 1 ELSE 0 END AS depth, 1 + len(f) + w AS n_nodes, CASE WHEN len(f) = 0 THEN 1 ELSE w + bare END AS n_leaves FROM k"""


def chain_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical rankings of the questions, with those of two follow-up searches by turns; the responses name the facts of an item."""
    items, chunks = _items(spark, sf_dir), _chunks(spark, sf_dir)
    facts = table(spark, sf_dir, "eval_items").filter("id is not null and question is not null").groupBy(F.col("id").alias("item")).agg(F.min("required_facts").alias("f"))
    requests, cache = _cached(items.join(facts, "item").withColumn("user", F.concat_ws("\n", "item", "question")), "chain", "user", _json(missing=F.lit("facts"), queries=F.col("f")))
    asked = responses.answered(requests, cache).select("item", responses.follow_up(F.col("response")).alias("u"))
    more = asked.select("item", F.posexplode("u.queries").alias("list_no", "query"))
    searches = items.select("item", F.lit(-1).alias("list_no"), F.col("question").alias("query")).unionByName(more)
    hits = ranking.bm25(searches.withColumn("q", F.struct("item", "list_no")), "q", "query", chunks, "id", "text", K).select("q.item", "q.list_no", "id", "rank")
    return responses.chain_hop(hits.filter("list_no < 0"), hits.filter("list_no >= 0"), "item", "rank", "id", K)


_FOLLOW = """SELECT id AS item, 0 AS list_no, min(question) AS query FROM eval_items WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY id
UNION ALL SELECT item, unnest(range(1, len(f) + 1)), unnest(f) FROM (SELECT id AS item, list_filter(list_transform(min(required_facts), lambda x: trim(x)), lambda x: x <> '')[1:2] AS f FROM eval_items WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY id)"""
CHAIN_HOP = f"""WITH {_bm25_sql(_FOLLOW)},
f AS (SELECT item, id, min(struct_pack(r := rank, l := list_no)) AS o FROM hits GROUP BY ALL)
SELECT item, id, CAST(row_number() OVER (PARTITION BY item ORDER BY o, id) AS INTEGER) AS rank FROM f QUALIFY rank <= {K}"""


def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hits of each question as numbered sources with the date of their page's last change, as a digest."""
    items, chunks = _items(spark, sf_dir), _chunks(spark, sf_dir)
    hits = ranking.bm25(items, "item", "question", chunks, "id", "text", 5).join(chunks, "id")
    dated = questions.dated(hits, corpus.modified_dates(table(spark, sf_dir, "pages_manifest")))
    found = responses.sources(dated, "item", "rank", "url", "text", "date_modified_int")
    return found.select("item", F.md5("context").alias("context"), F.length("context").alias("n_chars"))


ANSWER_SOURCES = f"""WITH {_bm25_sql("SELECT id AS item, 0 AS list_no, min(question) AS query FROM eval_items WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY id", 5)},
dr AS (SELECT seq, url, final_url, CAST(replace(regexp_extract(date_modified, '^(\\d{{4}})-(\\d{{2}})-(\\d{{2}})'), '-', '') AS INTEGER) AS d FROM pages_manifest WHERE regexp_matches(coalesce(date_modified, ''), '^\\d{{4}}-\\d{{2}}-\\d{{2}}')),
de AS (SELECT seq, 0 AS o, url AS u, d FROM dr UNION ALL SELECT seq, 1, final_url, d FROM dr WHERE final_url IS NOT NULL),
md AS (SELECT split_part(trim(u), '?', 1) AS mu, arg_max(d, seq * 2 + o) AS d FROM de WHERE u IS NOT NULL GROUP BY 1),
cu AS (SELECT id, arg_min(url, struct_pack(t := text, u := url)) AS url FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id),
b AS (SELECT item, rank, '[' || rank || '] ' || coalesce(url, '') || ' (modified ' || coalesce(CAST(d AS VARCHAR), 'unknown') || ')' || chr(10) || text AS b
      FROM hits JOIN docs USING (id) JOIN cu USING (id) LEFT JOIN md ON md.mu = split_part(trim(coalesce(url, '')), '?', 1)),
c AS (SELECT item, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS c FROM b GROUP BY item)
SELECT item, md5(c) AS context, CAST(length(c) AS INTEGER) AS n_chars FROM c"""


def expand_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of each document, the last first, expanded to their sections or 450 words of them; one hit for each unit."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.lit("h").alias("content_hash"), "title", "text", F.col("doc_id").cast("string").alias("url"))
    sections = chunking.section_index(docs, "key", "content_hash", "title", "text", "url")
    ids = sections.select("id", F.substring_index("id", "_", 1).alias("key"), F.substring_index("id", "_", -1).cast("int").alias("n"))
    hits = ids.select(F.col("key").cast("long").alias("doc_id"), "id", (F.lit(1_000_000) - F.col("n")).alias("rank"))
    found = questions.expanded(hits, "doc_id", hits.select("id", F.lit("").alias("text")), sections, 450)
    return found.select("doc_id", "id", "rank", "expanded_words", F.md5("text").alias("text"))


EXPAND_HITS = f"""WITH RECURSIVE {_SECTIONS},
w AS (SELECT doc_id, s, heading_path, list_filter(string_split_regex(body, '{_SPACE}'), lambda w: w <> '') AS w FROM sections),
e AS (SELECT doc_id, s, heading_path, w, unnest(list_filter(range(0, greatest(len(w), 1), 150), lambda st: st < len(w) AND (st = 0 OR st - 150 + 180 < len(w)))) AS start FROM w),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, start) - 1 AS n, least(180, len(w) - start) AS nw FROM e),
x AS (SELECT *, CASE WHEN len(w) <= 450 THEN 0 ELSE greatest(0, least(start - floor((450 - nw) / 2), len(w) - 450)) END AS first, least(len(w), 450) AS words FROM c),
k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, s, first, words ORDER BY n DESC) = 1)
SELECT doc_id, doc_id || '_h_' || n AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS INTEGER) AS rank, CAST(words AS INTEGER) AS expanded_words,
       md5(trim(coalesce(title, '') || ' | ' || heading_path || chr(10) || array_to_string(w[CAST(first AS BIGINT) + 1:CAST(first AS BIGINT) + words], ' '))) AS text FROM k JOIN documents d USING (doc_id)"""


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[len(t), t.count(" "), t.count("e")] for t in texts]


def embed_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all chunk texts by a given embedder: from a cache, filled before the last fetch, or newly made."""
    chunks = table(spark, sf_dir, "chunks").filter("text is not null").select("text", "fetched_int").distinct()
    last = table(spark, sf_dir, "chunks").agg(F.max("fetched_int")).first()[0]
    embed = ranking.embedder(_lengths)
    old = chunks.filter(F.col("fetched_int") < F.lit(last)).select("text").distinct()
    cache = old.select(F.lit(MODEL).alias("model"), F.sha2("text", 256).alias("text_hash"), embed(F.col("text")).alias("vec"))
    found, new = ranking.embed_cached(chunks.select("text").distinct(), "text", cache, MODEL, embed)
    fresh = new.select("text_hash", F.lit(True).alias("new"))
    shown = F.array_join(F.transform("vec", lambda x: x.cast("int").cast("string")), ",").alias("vec")
    return found.select(F.sha2("text", 256).alias("text_hash"), shown).join(fresh, "text_hash", "left").select("text_hash", "vec", F.coalesce("new", F.lit(False)).alias("new"))


EMBED_CACHED = """WITH c AS (SELECT DISTINCT text, fetched_int FROM chunks WHERE text IS NOT NULL),
o AS (SELECT DISTINCT text FROM c WHERE fetched_int < (SELECT max(fetched_int) FROM chunks))
SELECT DISTINCT sha256(text) AS text_hash, concat_ws(',', length(text), length(text) - length(replace(text, ' ', '')), length(text) - length(replace(text, 'e', ''))) AS vec, text NOT IN (SELECT text FROM o) AS new FROM c"""


def collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of the listing's rows before its last day, with those of the last day put in; read back."""
    rows = table(spark, sf_dir, "chunk_output").filter("id is not null and fetched_int is not null").groupBy("id", "fetched_int").agg(F.max("n_words").alias("n_words"))
    last = rows.agg(F.max("fetched_int")).first()[0]
    path = f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}"
    first = rows.filter(F.col("fetched_int") < F.lit(last)).groupBy("id").agg(F.max_by("n_words", "fetched_int").alias("n_words"), F.max("fetched_int").alias("fetched_int"))
    collections.write_collection(first, path, {})
    collections.upsert(spark, path, rows.filter(F.col("fetched_int") == F.lit(last)), "id")
    return collections.open_collection(spark, path, {}).select("id", "fetched_int", "n_words")


COLLECTION_UPSERT = """WITH r AS (SELECT id, fetched_int, max(n_words) AS n_words FROM chunk_output WHERE id IS NOT NULL AND fetched_int IS NOT NULL GROUP BY ALL)
SELECT id, fetched_int, n_words FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_int DESC) = 1"""


def cache_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response cache to which what is missing was appended twice: the questions of one split, then all; counted."""
    items = table(spark, sf_dir, "eval_items").filter("question is not null").select(responses.request_key(MODEL, "route", "v1", F.col("question")).alias("key"), "split", "question").distinct()
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    collections.append_missing(items.filter("split = 'dev'").select("key", F.md5("question").alias("response")), path, ["key"])
    collections.append_missing(items.select("key", F.md5("question").alias("response")), path, ["key"])
    return spark.read.parquet(path).groupBy("response").agg(F.count(F.lit(1)).alias("n"))


CACHE_APPENDED = "SELECT md5(question) AS response, 1 AS n FROM (SELECT DISTINCT question FROM eval_items WHERE question IS NOT NULL)"


def run_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of the last run, recorded twice under one name, and the ledger's two records, read back."""
    rows = table(spark, sf_dir, "e2e_rows")
    last = rows.agg(F.max("run_id")).first()[0]
    own = rows.filter(F.col("run_id") == F.lit(last)).select("run_id", "id", "verdict", "error").distinct()
    run = own.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_errors"))
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    for _ in range(2):
        collections.record_run(own, run, f"{path}/results", f"{path}/ledger")
    known = spark.read.schema("run_id string, n long, n_errors long, results_file string").json(f"{path}/ledger")
    held = spark.read.schema("run_id string, id string, verdict string").json([f"{path}/results", f"{path}/results-2"])
    name = F.element_at(F.split("results_file", "/"), -1).alias("results_file")
    return known.select("run_id", "n", "n_errors", name).join(held.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("verdict").alias("n_verdicts")), "run_id")


RUN_RECORDED = """WITH r AS (SELECT DISTINCT run_id, id, verdict, error FROM e2e_rows WHERE run_id = (SELECT max(run_id) FROM e2e_rows)),
k AS (SELECT run_id, count(*) AS n, count(error) AS n_errors, 2 * count(*) AS n_rows, 2 * count(verdict) AS n_verdicts FROM r GROUP BY run_id)
SELECT run_id, n, n_errors, unnest(['results', 'results-2']) AS results_file, n_rows, n_verdicts FROM k"""

_ALL = {
    "llm_decompose": (llm_decompose, LLM_DECOMPOSE), "route_confusion": (route_confusion, ROUTE_CONFUSION), "router_gate": (router_gate, ROUTER_GATE),
    "judged": (judged, JUDGED), "judge_requests": (judge_requests, JUDGE_REQUESTS), "majority_answers": (majority_answers, MAJORITY_ANSWERS),
    "tree_shapes": (tree_shapes, TREE_SHAPES), "chain_hop": (chain_hop, CHAIN_HOP), "answer_sources": (answer_sources, ANSWER_SOURCES), "expand_hits": (expand_hits, EXPAND_HITS),
    "embed_cached": (embed_cached, EMBED_CACHED), "collection_upsert": (collection_upsert, COLLECTION_UPSERT), "cache_appended": (cache_appended, CACHE_APPENDED), "run_recorded": (run_recorded, RUN_RECORDED),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}
