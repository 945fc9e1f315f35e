"""Curation queries over evaluation items and a pair of crawls, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmill.operators import curation
from siltmill.plans.scoring_queries import _fragments, _norm
from siltmill.runtime import table
from siltmill.sources import corpus

_COLS = ["id", "question", "category", "gold_passages", "stale_risk", "valid_until", "source_file"]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select(*_COLS).distinct()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts by key; a key fetched twice has its last text."""
    docs = table(spark, sf_dir, "documents").filter("page_key is not null and text is not null")
    return docs.groupBy(F.col("page_key").alias("key")).agg(F.max_by("text", "doc_id").alias("text"))


def eval_items_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with gold, the first of each id over the files."""
    items = corpus.merged_items(corpus.items_with_gold(_items(spark, sf_dir)), ["source_file", "question"])
    return items.select("id", "category", "source_file", F.size("gold_passages").alias("n_passages"))


EVAL_ITEMS_LOADED = """SELECT id, category, source_file, CAST(len(gold_passages) AS INTEGER) AS n_passages FROM (SELECT DISTINCT id, question, category, gold_passages, source_file FROM eval_items)
WHERE len(gold_passages) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_file NULLS FIRST, question NULLS FIRST) = 1"""


def draft_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out items as drafts, checked against the rest."""
    items = _items(spark, sf_dir).withColumn("split", F.lit(None))
    files = F.col("source_file") >= "set_01"
    drafts, existing = items.filter(files), items.filter(~files)
    indexed = table(spark, sf_dir, "chunks").select(F.explode(F.concat(F.array("url"), F.coalesce("also_urls", F.array().cast("array<string>")))).alias("url"))
    found = curation.validate_drafts(drafts, existing, table(spark, sf_dir, "pages_manifest").distinct(), _texts(spark, sf_dir), indexed)
    return found.select("id", "status", F.array_join("reasons", "; ").alias("reasons"), F.array_join("flags", "; ").alias("flags"), "n_passages")


_FOUND = """
m AS (SELECT DISTINCT * FROM pages_manifest WHERE key IS NOT NULL),
bh AS (SELECT content_hash, arg_max(key, seq) AS hk, content_hash AS hh FROM m GROUP BY content_hash),
mu AS (SELECT url AS u, key, content_hash, seq FROM m UNION ALL SELECT final_url, key, content_hash, seq FROM m WHERE final_url IS NOT NULL),
bu AS (SELECT u, arg_max(struct_pack(k := key, h := content_hash), seq) AS x FROM mu WHERE u IS NOT NULL GROUP BY u),
up AS (SELECT split_part(trim(u), '?', 1) AS path, any_value(key) AS pk FROM mu WHERE u IS NOT NULL GROUP BY 1 HAVING count(DISTINCT key) = 1),
pg AS (SELECT key, arg_max(content_hash, seq) AS ph FROM m GROUP BY key),
tx AS (SELECT page_key, arg_max(text, doc_id) AS text FROM documents WHERE page_key IS NOT NULL AND text IS NOT NULL GROUP BY page_key)"""


def _passages(source: str) -> str:
    return f"""
g AS (SELECT *, unnest(range(len(gold_passages))) AS passage, unnest(gold_passages) AS g FROM {source}),
f AS (SELECT g.* EXCLUDE (gold_passages), g.g.url AS url, g.g.quote AS quote, coalesce(hk, x.k, pk) AS page_key, coalesce(hh, x.h, ph) AS page_hash
      FROM g LEFT JOIN bh ON bh.content_hash = g.g.content_hash LEFT JOIN bu ON bu.u = g.g.url
      LEFT JOIN up ON up.path = split_part(trim(coalesce(g.g.url, '')), '?', 1) LEFT JOIN pg ON pg.key = up.pk),
c AS (SELECT f.*, {_fragments('quote')} AS fr, {_norm('tx.text')} AS nt FROM f LEFT JOIN tx ON tx.page_key = f.page_key),
p AS (SELECT *, len(fr) > 0 AND len(list_filter(fr, lambda q: NOT contains(nt, q))) = 0 AS in_page FROM c)"""


DRAFT_VALIDATION = f"""
WITH {_FOUND},
i AS (SELECT DISTINCT id, question, category, gold_passages, stale_risk, valid_until, source_file FROM eval_items),
d AS (SELECT *, row_number() OVER () AS rw FROM i WHERE source_file >= 'set_01'), ex AS (SELECT id, any_value(gold_passages) AS gp FROM i WHERE source_file < 'set_01' GROUP BY id),
iu AS (SELECT DISTINCT split_part(trim(coalesce(x, '')), '?', 1) AS iu FROM (SELECT url AS x FROM chunks UNION ALL SELECT unnest(also_urls) FROM chunks)),
{_passages('d')},
b AS (SELECT rw, list_sort(list_distinct(list(CASE WHEN trim(coalesce(url, '')) = '' THEN 'passage without url' WHEN trim(coalesce(quote, '')) = '' THEN 'passage without quote'
      WHEN page_key IS NULL THEN 'no page' WHEN NOT in_page THEN 'quote not in page' WHEN iu IS NULL THEN 'url not indexed' END)
      )) AS bad FROM p LEFT JOIN iu ON iu.iu = split_part(trim(coalesce(url, '')), '?', 1) GROUP BY rw),
z AS (SELECT d.*, ex.gp, ex.id IS NOT NULL AS twice, coalesce(len(d.gold_passages), 0) AS n, list_filter(list_concat(
      [CASE WHEN trim(coalesce(d.id, '')) = '' THEN 'no id' END, CASE WHEN trim(coalesce(d.question, '')) = '' THEN 'no question' END, CASE WHEN coalesce(len(d.gold_passages), 0) = 0 THEN 'no gold' END],
      coalesce(bad, [])), lambda x: x IS NOT NULL) AS r FROM d LEFT JOIN b USING (rw) LEFT JOIN ex ON ex.id = d.id)
SELECT id, CASE WHEN twice THEN 'duplicate' WHEN len(r) > 0 THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN twice AND gp IS DISTINCT FROM gold_passages THEN 'id exists; gold differs' WHEN twice THEN 'id exists' ELSE array_to_string(r, '; ') END AS reasons,
  CASE WHEN n < 2 THEN 'fewer than two passages' ELSE '' END AS flags, CAST(n AS INTEGER) AS n_passages FROM z"""


def gold_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold passages against the manifest as a new crawl, in which pages are gone, changed in their hash, or in their text.

    Which ones is read off the digits of a page's key.
    """
    manifest = table(spark, sf_dir, "pages_manifest").distinct()
    digits = lambda at: F.conv(F.substring("key", at, 2), 16, 10).cast("int")
    new = manifest.filter(~F.coalesce(digits(3) % 7 == 0, F.lit(False))).withColumn("content_hash", F.when(digits(1) % 3 == 0, F.substring(F.sha2("content_hash", 256), 1, 16)).otherwise(F.col("content_hash")))
    texts = _texts(spark, sf_dir)
    changed = texts.withColumn("text", F.when(digits(5) % 2 == 0, F.replace("text", F.lit("e"), F.lit("x"))).otherwise(F.col("text")))
    found = curation.check_gold(corpus.items_with_gold(_items(spark, sf_dir)), manifest, texts, new, changed, "2026-06-01")
    return found.select("id", "passage", "url", "old_hash", "new_hash", "status", F.array_join("stale", "; ").alias("stale"))


_GOLD = f"""
WITH {_FOUND},
i AS (SELECT DISTINCT id, question, category, gold_passages, stale_risk, valid_until, source_file FROM eval_items WHERE len(gold_passages) > 0),
{_passages('i')},
ou AS (SELECT key, arg_max(url, seq) AS ou FROM m GROUP BY key),
nw AS (SELECT url, arg_max(struct_pack(k := key, h := CASE WHEN CAST('0x' || key[1:2] AS INTEGER) % 3 = 0 THEN substr(sha256(content_hash), 1, 16) ELSE content_hash END), seq) AS n
       FROM m WHERE status = 200 AND CAST('0x' || key[3:4] AS INTEGER) % 7 <> 0 GROUP BY url),
nt AS (SELECT page_key AS nk, {_norm("CASE WHEN CAST('0x' || page_key[5:6] AS INTEGER) % 2 = 0 THEN replace(text, 'e', 'x') ELSE text END")} AS new_text FROM tx),
gc AS (SELECT id, CAST(passage AS INTEGER) AS passage, p.url, page_hash AS old_hash, nw.n.h AS new_hash,
  CASE WHEN p.page_key IS NULL OR NOT coalesce(in_page, FALSE) THEN 'BAD-GOLD' WHEN nw.url IS NULL THEN 'MISSING' WHEN nw.n.h IS NOT DISTINCT FROM page_hash THEN 'unchanged'
       WHEN len(fr) > 0 AND len(list_filter(fr, lambda q: NOT coalesce(contains(new_text, q), FALSE))) = 0 THEN 'changed-ok' ELSE 'BROKEN' END AS status,
  array_to_string(list_filter([CASE WHEN category = 'temporal' THEN 'temporal' END, CASE WHEN stale_risk = 'high' THEN 'high stale risk' END, CASE WHEN valid_until < '2026-06-01' THEN 'past valid_until' END], lambda x: x IS NOT NULL), '; ') AS stale
FROM p LEFT JOIN ou ON ou.key = p.page_key LEFT JOIN nw ON nw.url = ou.ou LEFT JOIN nt ON nt.nk = nw.n.k)"""
GOLD_CHECK = f"{_GOLD} SELECT * FROM gc"


def gold_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses of that check, counted."""
    return curation.gold_status(gold_check(spark, sf_dir))[0]


def draft_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out items as drafts of their category, checked for consistency, gold and quotes that the other items have."""
    items = table(spark, sf_dir, "eval_items").select(*_COLS, "answerable", "answer", "gold_answer").distinct()
    late = F.col("source_file") >= "set_01"
    drafts, existing = items.filter(late).withColumn("wanted", F.col("category")), items.filter(~late)
    indexed = table(spark, sf_dir, "chunks").select(F.explode(F.concat(F.array("url"), F.coalesce("also_urls", F.array().cast("array<string>")))).alias("url"))
    found = curation.check_drafts(drafts, existing, table(spark, sf_dir, "pages_manifest").distinct(), _texts(spark, sf_dir), indexed)
    return found.select("id", "category", "source_file", F.array_join("reasons", "; ").alias("reasons"), F.array_join("flags", "; ").alias("flags"))


_DRAFTS = f"""
WITH {_FOUND},
i AS (SELECT DISTINCT id, question, category, gold_passages, stale_risk, valid_until, source_file, answerable, answer, gold_answer FROM eval_items),
d AS (SELECT *, row_number() OVER () AS rw FROM i WHERE source_file >= 'set_01'),
iu AS (SELECT DISTINCT split_part(trim(coalesce(x, '')), '?', 1) AS iu FROM (SELECT url AS x FROM chunks UNION ALL SELECT unnest(also_urls) FROM chunks)),
eq AS (SELECT DISTINCT {_norm('g.quote')} AS q FROM (SELECT unnest(gold_passages) AS g FROM i WHERE source_file < 'set_01')),
hs AS (SELECT DISTINCT content_hash AS known FROM pages_manifest WHERE content_hash IS NOT NULL),
{_passages('d')},
b AS (SELECT rw, list_sort(list_distinct(list(CASE WHEN trim(coalesce(url, '')) = '' THEN 'passage without url' WHEN trim(coalesce(quote, '')) = '' THEN 'passage without quote'
      WHEN page_key IS NULL THEN 'no page' WHEN NOT in_page THEN 'quote not in page' WHEN iu IS NULL THEN 'url not indexed' END))) AS bad,
      list_sort(list(CASE WHEN known IS NULL THEN 'passage ' || (passage + 1) || ': not in the current snapshot' END)) AS stale,
      list_sort(list(CASE WHEN q IS NOT NULL THEN 'passage ' || (passage + 1) || ': quote of an existing item' END)) AS twice
      FROM p LEFT JOIN iu ON iu.iu = split_part(trim(coalesce(url, '')), '?', 1) LEFT JOIN hs ON hs.known = p.g.content_hash LEFT JOIN eq ON eq.q = {_norm('p.quote')} GROUP BY rw),
z AS (SELECT d.*, coalesce(len(d.gold_passages), 0) AS n, bad, stale, twice FROM d LEFT JOIN b USING (rw)),
dc AS (SELECT id, category, source_file, array_to_string(list_filter(list_concat(
  [CASE WHEN category IS NULL THEN NULL END, CASE WHEN trim(coalesce(answer, '')) = '' AND trim(coalesce(gold_answer, '')) = '' THEN 'no answer' END],
  CASE WHEN category = 'unanswerable' THEN [CASE WHEN answerable IS DISTINCT FROM FALSE THEN 'not marked unanswerable' END, CASE WHEN n > 0 THEN 'unanswerable with gold' END]
  ELSE list_concat([CASE WHEN answerable IS DISTINCT FROM TRUE THEN 'not marked answerable' END, CASE WHEN trim(coalesce(question, '')) = '' THEN 'no question' END, CASE WHEN n = 0 THEN 'no gold' END], coalesce(bad, []), coalesce(twice, [])) END),
  lambda x: x IS NOT NULL), '; ') AS reasons,
  CASE WHEN category = 'unanswerable' THEN '' ELSE array_to_string(list_filter(list_concat([CASE WHEN category = 'multi-hop' AND n < 2 THEN 'fewer than two passages' END], coalesce(stale, [])), lambda x: x IS NOT NULL), '; ') END AS flags FROM z)"""


def draft_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five drafts of each category that pass the check."""
    return curation.candidates(draft_check(spark, sf_dir).filter("id is not null and category is not null"), F.col("reasons") == "", ["source_file", "id"])


DRAFT_CANDIDATES = f"""{_DRAFTS} SELECT id, category, source_file, reasons, flags, CAST(row_number() OVER (PARTITION BY category ORDER BY source_file NULLS FIRST, id) AS INTEGER) AS place
FROM dc WHERE id IS NOT NULL AND category IS NOT NULL AND reasons = '' QUALIFY place <= 5"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "eval_items").select("id", "category", "split", "verified_by").filter("id is not null").distinct()
    dev = items.filter(F.col("split").eqNullSafe(F.lit("dev"))).drop("split")
    return dev, items.filter(~F.col("split").eqNullSafe(F.lit("dev")) & (F.col("verified_by") == "human")).drop("split")


def eval_set_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dev items and approved ones as one set, and whether the set may be frozen: ten items of each category at least."""
    both = curation.combined(*_halves(spark, sf_dir))
    gate = curation.category_counts(both).agg(F.bool_and("enough").alias("frozen"))
    return both.join(F.broadcast(gate)).select("id", "category", "split", "frozen")  # one row


EVAL_SET_FREEZE = """WITH i AS (SELECT DISTINCT id, category, split, verified_by FROM eval_items WHERE id IS NOT NULL),
b AS (SELECT id, category, 'dev' AS split FROM i WHERE split = 'dev' UNION ALL SELECT id, category, 'test' FROM i WHERE split IS DISTINCT FROM 'dev' AND verified_by = 'human'),
c AS (SELECT category, count(*) AS n FROM b WHERE category IN ('ambiguous', 'conditional', 'multi-hop', 'single-fact', 'temporal', 'unanswerable') GROUP BY category)
SELECT id, category, split, (SELECT count(*) FILTER (n >= 10) = 6 FROM c) AS frozen FROM b"""


def eval_set_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each category in that set."""
    return curation.category_counts(curation.combined(*_halves(spark, sf_dir)))


EVAL_SET_GATE = """WITH i AS (SELECT DISTINCT id, category, split, verified_by FROM eval_items WHERE id IS NOT NULL),
b AS (SELECT category FROM i WHERE split = 'dev' OR verified_by = 'human')
SELECT c.category, count(b.category) AS n, count(b.category) >= 10 AS enough FROM (SELECT unnest(['ambiguous', 'conditional', 'multi-hop', 'single-fact', 'temporal', 'unanswerable']) AS category) c LEFT JOIN b USING (category) GROUP BY c.category"""

_ALL = {
    "eval_items_loaded": (eval_items_loaded, EVAL_ITEMS_LOADED), "draft_validation": (draft_validation, DRAFT_VALIDATION), "gold_check": (gold_check, GOLD_CHECK),
    "gold_status": (gold_status, f"{_GOLD} SELECT status, count(*) AS n FROM gc GROUP BY status"), "draft_check": (draft_check, f"{_DRAFTS} SELECT * FROM dc"),
    "draft_candidates": (draft_candidates, DRAFT_CANDIDATES), "eval_set_freeze": (eval_set_freeze, EVAL_SET_FREEZE), "eval_set_gate": (eval_set_gate, EVAL_SET_GATE),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}
