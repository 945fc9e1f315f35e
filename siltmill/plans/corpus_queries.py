"""Queries over the corpus: texts, urls, manifest, sections, chunks, copies; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltmill.functions import text as tx
from siltmill.functions import urls
from siltmill.operators import chunking, crawl, ranking
from siltmill.plans.scoring_queries import _fragments, _norm
from siltmill.runtime import table
from siltmill.sources import corpus

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOP_WORDS)
_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"


def norm_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form and word count of each document."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.norm_text(t).alias("norm"), tx.word_count(t).alias("n_words"))


NORM_TOKENS = f"""SELECT doc_id, {_norm('text')} AS norm,
CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '')) AS INTEGER) AS n_words FROM documents"""


def stopword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index terms of each chunk."""
    rows = table(spark, sf_dir, "chunks").select("id", "text").distinct()
    return rows.select("id", F.array_join(tx.index_tokens(F.col("text")), " ").alias("terms"))


STOPWORD_TOKENS = rf"""SELECT id, array_to_string(list_filter(regexp_extract_all(lower(nfc_normalize(replace(coalesce(text, ''), chr(64257), 'fi'))), '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN ({_STOP})), ' ') AS terms
FROM (SELECT DISTINCT id, text FROM chunks)"""


def quote_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments of each gold quote."""
    items = table(spark, sf_dir, "eval_items").select("id", "gold_passages").distinct()
    one = items.select("id", F.posexplode("gold_passages").alias("passage", "p"))
    return one.select("id", "passage", F.posexplode(tx.quote_fragments(F.col("p.quote"))).alias("part", "fragment"))


QUOTE_PARTS = f"""
WITH i AS (SELECT DISTINCT id, gold_passages FROM eval_items),
p AS (SELECT id, unnest(range(len(gold_passages))) AS passage, unnest(gold_passages) AS g FROM i),
f AS (SELECT id, passage, {_fragments('g.quote')} AS f FROM p)
SELECT id, CAST(passage AS INTEGER) AS passage, CAST(unnest(range(len(f))) AS INTEGER) AS part, unnest(f) AS fragment FROM f"""


def date_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of pages as numbers."""
    rows = table(spark, sf_dir, "pages_manifest")
    return rows.select("seq", tx.date_int(F.col("date_modified")).alias("modified_int"), tx.date_int(F.col("fetched_at")).alias("fetched_int"))


DATE_INTS = r"""SELECT seq, CAST(nullif(replace(regexp_extract(date_modified, '^(\d{4})-(\d{2})-(\d{2})'), '-', ''), '') AS INTEGER) AS modified_int,
CAST(nullif(replace(regexp_extract(fetched_at, '^(\d{4})-(\d{2})-(\d{2})'), '-', ''), '') AS INTEGER) AS fetched_int FROM pages_manifest"""


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching form, page, host and key of each url."""
    u = F.col("url")
    rows = table(spark, sf_dir, "pages_manifest").select("url").distinct()
    return rows.select("url", urls.match_url(u).alias("match"), urls.page_url(u).alias("page"), urls.host(u).alias("host"), urls.short_hash(u).alias("key"))


URL_FORMS = r"""SELECT url, split_part(trim(url), '?', 1) AS match,
  lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://)?[^/]*')) || substr(b, length(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://)?[^/]*')) + 1) AS page,
  nullif(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '') AS host, substr(sha256(url), 1, 16) AS key
FROM (SELECT DISTINCT url, regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') AS b FROM pages_manifest)"""


def normal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl's normal form of each url."""
    return table(spark, sf_dir, "pages_manifest").select("url").distinct().select("url", urls.normal_url(F.col("url")).alias("normal"))


NORMAL_URLS = r"""
WITH u AS (SELECT DISTINCT url, regexp_replace(url, '#.*$', '') AS f FROM pages_manifest),
p AS (SELECT url, split_part(f, '?', 1) AS b, CASE WHEN contains(f, '?') THEN substr(f, length(split_part(f, '?', 1)) + 2) ELSE '' END AS q FROM u),
k AS (SELECT url, regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*') AS h, b,
      array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '=.') AND lower(split_part(x, '=', 1)) NOT IN
      ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid'))), '&') AS q FROM p)
SELECT url, lower(h) || CASE WHEN regexp_replace(substr(b, length(h) + 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(substr(b, length(h) + 1), '/+$', '') END
       || CASE WHEN q = '' THEN '' ELSE '?' || q END AS normal FROM k"""


def manifest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages with a text, as the index loads them."""
    docs = table(spark, sf_dir, "documents").select(F.col("page_key").alias("key"), "text", "doc_id")
    return corpus.pages(table(spark, sf_dir, "pages_manifest").distinct(), docs).select("seq", "key", "content_hash", "doc_id")


MANIFEST_PAGES = r"""SELECT DISTINCT seq, m.key, content_hash, doc_id FROM (SELECT DISTINCT * FROM pages_manifest) m JOIN documents d ON d.page_key = m.key
WHERE status = 200 AND m.key IS NOT NULL AND regexp_matches(coalesce(d.text, ''), '[^\s\p{Z}]')"""


def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each page, under any of its urls, was last modified; the last row of a url counts."""
    return corpus.modified_dates(table(spark, sf_dir, "pages_manifest"))


PAGE_DATES = r"""
WITH r AS (SELECT seq, url, final_url, CAST(replace(regexp_extract(date_modified, '^(\d{4})-(\d{2})-(\d{2})'), '-', '') AS INTEGER) AS d FROM pages_manifest
           WHERE regexp_matches(coalesce(date_modified, ''), '^\d{4}-\d{2}-\d{2}')),
e AS (SELECT seq, 0 AS o, url AS u, d FROM r UNION ALL SELECT seq, 1, final_url, d FROM r WHERE final_url IS NOT NULL)
SELECT split_part(trim(u), '?', 1) AS url, arg_max(d, seq * 2 + o) AS modified_int FROM e WHERE u IS NOT NULL GROUP BY 1"""


def snapshot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page key of each path that names exactly one page."""
    return corpus.unique_paths(table(spark, sf_dir, "pages_manifest"))


SNAPSHOT_LOOKUP = r"""
WITH e AS (SELECT DISTINCT split_part(trim(u), '?', 1) AS path, key FROM
  (SELECT url AS u, key FROM pages_manifest WHERE key IS NOT NULL UNION ALL SELECT final_url, key FROM pages_manifest WHERE key IS NOT NULL AND final_url IS NOT NULL))
SELECT path, any_value(key) AS key FROM e GROUP BY path HAVING count(DISTINCT key) = 1"""


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.page_sections(docs, "doc_id", "text")


_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_HEAD = r"^(#{1,4})\s+(.*)$"
_SECTIONS = rf"""
l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{_LINES}') AS x FROM documents)),
h AS (SELECT *, length(regexp_extract(line, '{_HEAD}', 1)) AS lv, trim(regexp_extract(line, '{_HEAD}', 2)) AS title FROM l),
n AS (SELECT *, CAST(sum(CASE WHEN lv > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS sec FROM h),
p AS (SELECT DISTINCT doc_id, 0 AS sec, CAST([] AS VARCHAR[]) AS path FROM l
      UNION ALL SELECT p.doc_id, n.sec, list_concat(path[1:lv - 1], [title]) FROM p JOIN n ON n.doc_id = p.doc_id AND n.sec = p.sec + 1 AND n.lv > 0),
b AS (SELECT doc_id, sec, trim(string_agg(line, chr(10) ORDER BY i)) AS body FROM n WHERE lv = 0 GROUP BY doc_id, sec),
sections AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INTEGER) AS s, array_to_string(path, ' > ') AS heading_path, body
             FROM b JOIN p USING (doc_id, sec) WHERE regexp_matches(body, '[^\s\p{{Z}}]'))"""
PAGE_SECTIONS = f"WITH RECURSIVE {_SECTIONS} SELECT doc_id, s, heading_path, body FROM sections"
PAGE_CHUNKS = f"""WITH RECURSIVE {_SECTIONS},
w AS (SELECT doc_id, s, heading_path, list_filter(string_split_regex(body, '{_SPACE}'), lambda w: w <> '') AS w FROM sections),
e AS (SELECT doc_id, s, heading_path, w, unnest(list_filter(range(0, greatest(len(w), 1), 150), lambda st: st < len(w) AND (st = 0 OR st - 150 + 180 < len(w)))) AS start FROM w),
c AS (SELECT *, array_to_string(w[start + 1:start + 180], ' ') AS piece, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, start) - 1 AS INTEGER) AS n FROM e)
SELECT doc_id, concat_ws('_', page_key, substr(sha256(coalesce(d.text, '')), 1, 16), CAST(n AS VARCHAR)) AS id, n, s, CAST(start AS INTEGER) AS start,
       CAST(len(w[start + 1:start + 180]) AS INTEGER) AS n_words, heading_path,
       coalesce(title, '') || CASE WHEN heading_path <> '' THEN ' | ' || heading_path ELSE '' END || chr(10) || piece AS text
FROM c JOIN documents d USING (doc_id)"""


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each document: windows of 180 words with 30 words of overlap, by section."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "page_key", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("content_hash"), "title", "text")
    out = chunking.page_chunks(docs, "page_key", "content_hash", "title", "text")
    return out.select("doc_id", "id", "n", "s", "start", "n_words", "heading_path", "text")


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over whole documents, headings not looked at."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.windows(tx.split_words(F.col("text")))).alias("n", "w"))
    return rows.select("doc_id", "n", F.col("w.start").alias("start"), F.col("w.piece").alias("piece"))


CHUNK_WINDOWS = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, w, list_filter(range(0, greatest(len(w), 1), 150), lambda st: st < len(w) AND (st = 0 OR st - 150 + 180 < len(w))) AS st FROM w),
e AS (SELECT doc_id, w, unnest(range(len(st))) AS n, unnest(st) AS start FROM s)
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(start AS INTEGER) AS start, array_to_string(w[start + 1:start + 180], ' ') AS piece FROM e"""


def chunk_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of each text, with its copies and their other urls."""
    rows = table(spark, sf_dir, "chunks").filter("text is not null and id is not null").select("id", "text", "url", "fetched_int").distinct()
    folded = chunking.fold_copies(rows, "text", "url", ["fetched_int", "id"])
    return folded.select("id", "url", "n_copies", F.array_join("also_urls", " ").alias("also_urls"))


CHUNK_DEDUPE = f"""
WITH c AS (SELECT DISTINCT id, text, url, fetched_int, {_norm('text')} AS k FROM chunks WHERE text IS NOT NULL AND id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fetched_int NULLS FIRST, id) AS n, count(*) OVER (PARTITION BY k) AS n_copies, list(url) OVER (PARTITION BY k) AS us FROM c)
SELECT id, url, CAST(n_copies AS INTEGER) AS n_copies, array_to_string(list_sort(list_filter(list_distinct(us), lambda u: u <> url)), ' ') AS also_urls FROM r WHERE n = 1"""


def chunk_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with the first one of its text."""
    rows = table(spark, sf_dir, "chunks").filter("text is not null and id is not null").select("id", "text", "url", "fetched_int").distinct()
    return chunking.copy_members(rows, "text", "id", ["fetched_int"])


CHUNK_COPIES = f"""
WITH c AS (SELECT DISTINCT id, fetched_int, {_norm('text')} AS k FROM chunks WHERE text IS NOT NULL AND id IS NOT NULL),
f AS (SELECT k, id AS first_id FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY fetched_int NULLS FIRST, id) = 1)
SELECT DISTINCT c.id, f.first_id FROM c JOIN f ON f.k = c.k"""


def section_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of documents as hits, expanded to at most 450 words, one hit kept for each unit."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.split_words(F.col("text")).alias("w"))
    hits = rows.select("doc_id", F.size("w").alias("n"), F.explode(chunking.window_starts(F.size("w"), 180, 30)).alias("start"))
    length = F.least(F.lit(180), F.col("n") - F.col("start"))
    first, words = chunking.expanded_span(F.col("n"), F.col("start"), length, 450)
    ranked = hits.withColumns({"first": first, "words": words, "rank": F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("start")))})
    return chunking.collapse_units(ranked, "doc_id", ["first"], "rank").select("doc_id", "first", "words", "chunk_rank", "rank")


SECTION_EXPAND = f"""
WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '')) AS n FROM documents),
h AS (SELECT doc_id, n, unnest(list_filter(range(0, greatest(n, 1), 150), lambda st: st < n AND (st = 0 OR st - 150 + 180 < n))) AS start FROM w),
x AS (SELECT *, CASE WHEN n <= 450 THEN 0 ELSE greatest(0, least(start - floor((450 - least(180, n - start)) / 2), n - 450)) END AS first, least(n, 450) AS words,
      row_number() OVER (PARTITION BY doc_id ORDER BY start DESC) AS chunk_rank FROM h),
k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, first ORDER BY chunk_rank) = 1)
SELECT doc_id, CAST(first AS INTEGER) AS first, CAST(words AS INTEGER) AS words, CAST(chunk_rank AS INTEGER) AS chunk_rank,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_rank) AS INTEGER) AS rank FROM k"""


def vector_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a cache of vectors, filled before the last fetch, doesn't hold."""
    chunks = table(spark, sf_dir, "chunks")
    last = chunks.agg(F.max("fetched_int")).first()[0]
    cache = chunks.filter(F.col("fetched_int") < F.lit(last)).select(F.lit("hashed-64").alias("model"), F.sha2("text", 256).alias("text_hash")).distinct()
    return ranking.missing_vectors(chunks, "text", cache, "hashed-64").select("text_hash")


VECTOR_CACHE_MISSES = """SELECT DISTINCT sha256(text) AS text_hash FROM chunks WHERE text IS NOT NULL
AND sha256(text) NOT IN (SELECT sha256(text) FROM chunks WHERE fetched_int < (SELECT max(fetched_int) FROM chunks) AND text IS NOT NULL)"""


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts and missing dates of the chunk listing, by snapshot."""
    rows = table(spark, sf_dir, "chunk_output").distinct()
    return rows.groupBy("fetched_int").agg(
        F.count(F.lit(1)).alias("n"), F.min("n_words").alias("least"), F.max("n_words").alias("most"), F.round(F.avg("n_words"), 6).alias("mean"),
        F.percentile("n_words", F.lit(0.5)).alias("median"), F.count_distinct("url").alias("n_urls"), F.count_if(F.col("heading").isNull()).alias("no_heading"),
    )


CHUNK_STATS = """SELECT fetched_int, count(*) AS n, min(n_words) AS least, max(n_words) AS most, round(avg(n_words), 6) AS mean, CAST(quantile_cont(n_words, 0.5) AS DOUBLE) AS median,
count(DISTINCT url) AS n_urls, count(*) FILTER (heading IS NULL) AS no_heading FROM (SELECT DISTINCT * FROM chunk_output) GROUP BY fetched_int"""


def crawl_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and problem pages by depth."""
    return crawl.inspection(table(spark, sf_dir, "pages_manifest").distinct())


CRAWL_INSPECTION = """SELECT depth, count(*) AS n, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (status IS DISTINCT FROM 200) AS not_ok,
count(*) FILTER (coalesce(n_chars < 200, FALSE)) AS short, count(DISTINCT key) AS n_keys FROM (SELECT DISTINCT * FROM pages_manifest) GROUP BY depth"""


def link_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl of one seed's host does with each known link."""
    rows = table(spark, sf_dir, "pages_manifest")
    links = rows.select(F.col("url"), F.col("parent")).distinct()
    allowed = rows.select(urls.host(F.col("seed")).alias("host")).filter("host is not null").groupBy("host").count().orderBy(F.desc("count"), "host").limit(1)
    host = allowed.first()
    return crawl.classify(links, "url", host["host"] if host else "", ["/en/", "/fr/"])


LINK_CLASSES = r"""
WITH h AS (SELECT lower(regexp_extract(trim(seed), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages_manifest),
b AS (SELECT host FROM h WHERE host <> '' GROUP BY host ORDER BY count(*) DESC, host LIMIT 1),
l AS (SELECT DISTINCT url, parent, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
      regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages_manifest)
SELECT url, parent, CASE WHEN NOT regexp_matches(url, '(?i)^https?://') THEN 'ignored' WHEN host IS DISTINCT FROM (SELECT host FROM b) THEN 'off_host'
  WHEN regexp_matches(path, '\.[A-Za-z0-9]{1,5}$') AND NOT regexp_matches(lower(path), '\.(html?|php|aspx?)$') THEN 'non_html_extension'
  WHEN NOT (starts_with(path, '/en/') OR starts_with(path, '/fr/')) THEN 'off_path' ELSE 'enqueue' END AS reason FROM l"""


def crawl_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why known links are not followed, counted."""
    return crawl.skipped(link_classes(spark, sf_dir), "url")[0]


CRAWL_SKIPS = f"SELECT reason, count(*) AS n FROM ({LINK_CLASSES}) WHERE reason NOT IN ('enqueue', 'ignored') GROUP BY reason"


def crawl_off_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty links off the crawl's paths."""
    return crawl.skipped(link_classes(spark, sf_dir), "url")[1]


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages_manifest")
    links = rows.filter("parent is not null").select(F.col("parent").alias("src"), F.col("url").alias("dst"), F.col("seq").alias("place"))
    seeds = rows.filter("seed is not null").select(F.col("seed").alias("url")).distinct()
    return crawl.frontier(links, seeds)


def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first depth of each page reached from the seeds over the recorded links."""
    return _frontier(spark, sf_dir).drop("parent")


def crawl_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first depth and first parent of each page reached from the seeds over the recorded links."""
    return _frontier(spark, sf_dir)


#: No page here is as many as thirty links from a seed; the bound ends the recursion where links go round.
CRAWL_FRONTIER = """
WITH RECURSIVE l AS (SELECT DISTINCT parent AS src, url AS dst FROM pages_manifest WHERE parent IS NOT NULL AND url IS NOT NULL),
f AS (SELECT DISTINCT seed AS url, 0 AS depth FROM pages_manifest WHERE seed IS NOT NULL
      UNION SELECT dst, depth + 1 FROM f JOIN l ON l.src = f.url WHERE depth < 30)
SELECT url, min(depth) AS depth FROM f GROUP BY url"""


_ALL = {
    "norm_tokens": (norm_tokens, NORM_TOKENS), "stopword_tokens": (stopword_tokens, STOPWORD_TOKENS), "quote_fragments": (quote_parts, QUOTE_PARTS),
    "date_to_int": (date_ints, DATE_INTS), "url_norm": (url_forms, URL_FORMS), "url_normalize_full": (normal_urls, NORMAL_URLS),
    "manifest_filter": (manifest_pages, MANIFEST_PAGES), "page_dates": (page_dates, PAGE_DATES), "snapshot_lookup": (snapshot_lookup, SNAPSHOT_LOOKUP),
    "section_split": (page_sections, PAGE_SECTIONS), "page_chunks": (page_chunks, PAGE_CHUNKS), "chunk_windows": (chunk_windows, CHUNK_WINDOWS),
    "chunk_dedupe": (chunk_dedupe, CHUNK_DEDUPE), "chunk_copies": (chunk_copies, CHUNK_COPIES), "expand_window": (section_expand, SECTION_EXPAND), "embed_cache_antijoin": (vector_cache_misses, VECTOR_CACHE_MISSES),
    "chunk_stats": (chunk_stats, CHUNK_STATS), "crawl_inspection": (crawl_inspection, CRAWL_INSPECTION), "link_classify": (link_classes, LINK_CLASSES), "crawl_skips": (crawl_skips, CRAWL_SKIPS),
    "crawl_off_path": (crawl_off_path, f"SELECT DISTINCT url FROM ({LINK_CLASSES}) WHERE reason = 'off_path' ORDER BY url LIMIT 40"),
    "crawl_frontier": (crawl_frontier, CRAWL_FRONTIER), "crawl_reach": (crawl_reach, None),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}
