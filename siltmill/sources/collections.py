"""Collections of chunks, caches and ledgers as written tables."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmill.functions.text import norm_text
from siltmill.functions.urls import match_url
from siltmill.sources.corpus import _exists

#: Settings that a collection was built with and that a reader must agree on.
INDEX_SETTINGS = ("chunking_method", "chunk_size", "chunk_overlap", "add_heading_path", "dedupe", "embedding_model")


def _meta(path: str) -> str:
    return f"{path.rstrip('/')}_settings"


def write_collection(chunks: DataFrame, path: str, settings: dict, rebuild: bool = False) -> None:
    """Writes a collection with its settings. An existing one is refused unless it is to be rebuilt."""
    mode = "overwrite" if rebuild else "errorifexists"
    chunks.write.mode(mode).parquet(path)
    one = json.dumps({k: settings.get(k) for k in INDEX_SETTINGS}, sort_keys=True)
    chunks.sparkSession.createDataFrame([(one,)], "settings string").coalesce(1).write.mode(mode).json(_meta(path))


def open_collection(spark: SparkSession, path: str, settings: dict) -> DataFrame:
    """Opens a collection; raises, before any job on it, if it was built with other settings."""
    had = json.loads(spark.read.json(_meta(path)).first()["settings"])
    wrong = {k: (had.get(k), settings.get(k)) for k in INDEX_SETTINGS if had.get(k) != settings.get(k)}
    if wrong:
        raise ValueError(f"the collection was built with other settings: {wrong}")
    return spark.read.parquet(path)


@dataclass(frozen=True)
class EvalCollection:
    """A collection as an evaluation needs it: its chunks, the pages in it, those and their copies' pages, and its distinct normal texts."""

    chunks: DataFrame
    pages: DataFrame
    indexed: DataFrame
    texts: DataFrame


def open_for_eval(spark: SparkSession, path: str, settings: dict, search: str = "exact", bm25_k: int = 0) -> EvalCollection:
    """Opens a collection with checks of its settings and of the search before any job; its tables are not computed yet."""
    if search not in ("hnsw", "exact"):
        raise ValueError(f"unknown search {search}")
    if bm25_k and search != "exact":
        raise ValueError("lexical candidates need the exact search")
    chunks = open_collection(spark, path, settings)
    none = F.array().cast("array<string>")
    others = F.coalesce(F.col("also_urls"), none) if "also_urls" in chunks.columns else none
    of = lambda urls: chunks.select(F.explode(urls).alias("u")).select(match_url(F.col("u")).alias("url")).filter("url <> ''").distinct()
    texts = chunks.filter("text is not null").select(norm_text(F.col("text")).alias("text")).distinct()
    return EvalCollection(chunks, of(F.array("url")), of(F.concat(F.array("url"), others)), texts)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str) -> None:
    """Replaces rows of the same key and adds the others; of rows with one key, and with all equal, one stays.

    The new table is written beside the old one, then takes its place.
    """
    rows = rows.distinct()
    if not _exists(spark, path):
        rows.write.parquet(path)
        return
    old = spark.read.parquet(path)
    fresh = f"{path.rstrip('/')}_{uuid.uuid4().hex}"
    old.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True).write.parquet(fresh)
    _replace(spark, fresh, path)


def _replace(spark: SparkSession, fresh: str, path: str) -> None:
    """Puts a written table in the place of another. The old one is moved aside first and goes last, so one is always there."""
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    aside = f"{path.rstrip('/')}_old_{uuid.uuid4().hex}"
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(at(path), at(aside)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(at(fresh), at(path)):
        fs.rename(at(aside), at(path))
        raise OSError(f"cannot rename {fresh} to {path}")
    fs.delete(at(aside), True)


def append_missing(rows: DataFrame, path: str, key: list[str]) -> None:
    """Appends the rows whose key a cache lacks, so a stopped job can go on where it was."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(key)
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*key), key, "left_anti")
    new.write.mode("append").parquet(path)


def record_run(results: DataFrame, run: DataFrame, results_path: str, ledger_path: str) -> str:
    """Writes a run's rows, then its ledger record, so that a record without rows can't be. Returns the rows' path.

    A path that is taken gets -2, -3, …
    """
    spark, path, n = results.sparkSession, results_path, 1
    while _exists(spark, path):
        n += 1
        path = f"{results_path}-{n}"
    results.write.mode("errorifexists").json(path)
    run.withColumn("results_file", F.lit(path)).write.mode("append").json(ledger_path)
    return path


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def review_sheet(candidates: DataFrame, most: int = 500) -> str:
    """A Markdown sheet of candidates by category, for a person to read; refuses more than ``most``."""
    rows = candidates.orderBy("category", "place").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} candidates")
    out: list[str] = []
    last = object()
    for r in rows:
        if r["category"] != last:
            last = r["category"]
            out.append(f"\n## {last}\n")
        out.append(f"- [ ] {r['id']}: {r['question'] if 'question' in r else ''}".rstrip())
    return "\n".join(out).strip() + "\n"


def write_pages(pages: DataFrame, path: str) -> None:
    """Raw HTML and text of fetched pages, a row for each key."""
    pages.select("key", "html", "text").write.mode("overwrite").parquet(path)


def box_table(rows: DataFrame, most: int = 200, width: int = 40) -> str:
    """A table for a terminal: long values go on in the next line, and a last line tells if there are more rows."""
    found = rows.limit(most + 1).collect()
    cells = [rows.columns, *[["" if v is None else str(v) for v in r] for r in found[:most]]]
    wrapped = [[[line[i : i + width] for line in c.split("\n") for i in range(0, max(1, len(line)), width)] for c in row] for row in cells]
    widths = [max(len(x) for row in wrapped for x in row[i]) for i in range(len(cells[0]))]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    out = [line]
    for n, row in enumerate(wrapped):
        for k in range(max(map(len, row))):
            out.append("| " + " | ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(row, widths, strict=True)) + " |")
        if n == 0:
            out.append(line)
    return "\n".join([*out, line, *(["… and more rows"] if len(found) > most else [])])
