"""Loading a crawl, evaluation sets and run ledgers from files or tables; lookups over a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmill.functions.text import date_int
from siltmill.functions.urls import match_url

MANIFEST = (
    "seq int, url string, depth int, parent string, seed string, fetched_at string, status int, final_url string, error string, key string, "
    "content_hash string, title string, date_modified string, n_links int, n_chars int"
)
EVAL_ITEM = (
    "id string, question string, category string, answerable boolean, gold_answer string, answer string, required_facts array<string>, "
    "gold_passages array<struct<url: string, content_hash: string, quote: string>>, valid_as_of string, valid_until string, stale_risk string, "
    "source string, verified_by string, vocab_overlap_flag string, notes string, split string"
)


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines with a declared schema; missing files are an empty table, blank lines are skipped."""
    paths = [path] if isinstance(path, str) else list(path)
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(there).dropna(how="all")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def page_texts(spark: SparkSession, run_dir: str) -> DataFrame:
    """(key, text) of the text files of a crawl, named by key."""
    files = spark.read.text(f"{run_dir}/text/*.txt", wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return files.select(F.regexp_replace("name", r"\.txt$", "").alias("key"), F.col("value").alias("text"))


def pages(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """Manifest rows that were fetched with success, have a key and a text that isn't blank, with the text."""
    ok = manifest.filter("status = 200 and key is not null")
    return ok.join(texts.filter(F.col("text").rlike(r"[^\s\p{Z}]")), "key")


def items_with_gold(items: DataFrame) -> DataFrame:
    """Evaluation items that have gold passages."""
    return items.filter(F.coalesce(F.size("gold_passages"), F.lit(0)) > 0)


def merged_items(items: DataFrame, order: list[str]) -> DataFrame:
    """The first occurrence of each id, by ``order`` (file, then line)."""
    first = Window.partitionBy("id").orderBy(*order)
    return items.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def _urls(manifest: DataFrame, *keep: str) -> DataFrame:
    own = manifest.select(*keep, F.posexplode(F.array("url", "final_url")).alias("_o", "u"))
    return own.filter("u is not null")


def modified_dates(manifest: DataFrame) -> DataFrame:
    """(url, modified_int): the date of each url's last dated row, by seq."""
    dated = manifest.withColumn("d", date_int(F.col("date_modified"))).filter("d is not null")
    rows = _urls(dated, "seq", "d").select(match_url(F.col("u")).alias("url"), "d", F.struct("seq", "_o").alias("at"))
    return rows.groupBy("url").agg(F.max_by("d", "at").alias("modified_int"))


def unique_paths(manifest: DataFrame) -> DataFrame:
    """(path, key): urls without query that name exactly one page."""
    rows = _urls(manifest.filter("key is not null"), "key").select(match_url(F.col("u")).alias("path"), "key").distinct()
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("key")).filter("n = 1").drop("n")


def find_page(passages: DataFrame, manifest: DataFrame, path_fallback: bool = True) -> DataFrame:
    """``passages`` (url, content_hash, …) with page_key and page_hash: by content hash, else exact url, else unique path."""
    known = manifest.filter("key is not null")
    by_hash = known.groupBy("content_hash").agg(F.max_by(F.struct("key", "content_hash"), "seq").alias("h"))
    by_url = _urls(known, "key", "content_hash", "seq").groupBy("u").agg(F.max_by(F.struct("key", "content_hash"), "seq").alias("x"))
    out = passages.join(by_hash, "content_hash", "left").join(by_url, passages["url"] == by_url["u"], "left").drop("u")
    found = [F.col("h"), F.col("x")]
    if path_fallback:
        page = known.groupBy("key").agg(F.max_by("content_hash", "seq").alias("content_hash"))
        paths = unique_paths(manifest).join(page, "key").select("path", F.struct("key", "content_hash").alias("p"))
        out = out.withColumn("_m", match_url(passages["url"])).join(paths, F.col("_m") == F.col("path"), "left").drop("_m", "path")
        found.append(F.col("p"))
    best = F.coalesce(*found)
    return out.withColumn("page_key", best["key"]).withColumn("page_hash", best["content_hash"]).drop("h", "x", "p")
