"""Command line: registered queries, an index of a crawl, an evaluation of it, comparison and table of recorded runs.

python -m siltmill list
python -m siltmill run NAME --data DIR [--out PATH] [--rows N]
python -m siltmill index --config FILE --crawl DIR --out PATH [--rebuild]
python -m siltmill eval --config FILE --index PATH --items FILE --results DIR --ledger DIR --change TEXT [--category C] [--limit N]
python -m siltmill table --ledger DIR [--show-test]
python -m siltmill compare --results PATH PATH
"""

from __future__ import annotations

import argparse
import importlib
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmill.functions.text import norm_text
from siltmill.operators import chunking, curation, ledger, questions, scoring
from siltmill.runtime import cut, session
from siltmill.sources import collections, corpus
from siltmill.sources.collections import box_table

PLANS = ("record_queries", "corpus_queries", "ranking_queries", "scoring_queries", "ledger_queries", "curation_queries", "response_queries")
RUN = "run_id string, timestamp string, change string, n long, hit5 double, hit50 double, mrr double, miss_0 long, miss_a long, miss_b long, miss_c long, eval_set_hash string, results_file string, settings string"


def index(spark: SparkSession, config: str, crawl: str, out: str, rebuild: bool = False) -> None:
    """Chunks of a crawl folder as a collection."""
    _, own, _ = questions.load_settings(config)
    manifest = corpus.jsonl(spark, f"{crawl}/manifest.jsonl", corpus.MANIFEST)
    pages = corpus.pages(manifest, corpus.page_texts(spark, crawl))
    heads = bool(own.get("add_heading_path", True))
    chunks = chunking.page_chunks(pages.select("key", "content_hash", "title", "url", "text"), "key", "content_hash", "title", "text", own["chunk_size"], own["chunk_overlap"], heads)
    if own["dedupe_chunks"]:
        chunks = chunking.fold_copies(chunks.select("id", "text", "url", "title", "heading_path"), "text", "url", ["id"])
    collections.write_collection(chunks, out, _index_settings(own), rebuild)


def _index_settings(own: dict) -> dict:
    return own | {"dedupe": own["dedupe_chunks"], "chunking_method": own.get("chunking_method", "section_words"), "add_heading_path": own.get("add_heading_path", True)}


def evaluate(spark: SparkSession, config: str, path: str, items_file: str, results: str, runs: str, change: str, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Retrieves for all items, scores the rankings, stores rows and run record; gives the record."""
    _, own, settings = questions.load_settings(config)
    known = collections.open_for_eval(spark, path, _index_settings(own), settings.search, settings.bm25_k)
    items = curation.chosen(corpus.items_with_gold(corpus.jsonl(spark, items_file, corpus.EVAL_ITEM)), category, limit)
    asked = cut(items.select(F.col("id").alias("item"), "question", "category", "split", "gold_passages"))
    hits = cut(questions.retrieve(asked.select("item", "question"), "item", "question", known.chunks, settings.k, settings))
    ranked = hits.join(known.chunks.select("id", "text"), "id").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("hits"))  # k for each item
    joined = asked.join(ranked, "item", "left")
    texts = F.coalesce(F.transform("hits", lambda h: norm_text(h["text"])), F.array().cast("array<string>"))
    ranks = scoring.quote_ranks(F.transform("gold_passages", lambda p: p["quote"]), texts)
    scored = cut(joined.select("item", "category", "split", "gold_passages", ranks.alias("passage_ranks")).withColumn("rank", scoring.worst(F.col("passage_ranks"))))
    one = scored.select("item", F.posexplode("gold_passages").alias("p", "g"), "passage_ranks").select("item", F.get("passage_ranks", F.col("p")).alias("r"), F.col("g.url").alias("url"), F.col("g.quote").alias("quote"))
    groups = scoring.passage_misses(one, "r", "url", "quote", known.indexed, known.texts, "text")
    worst = groups.groupBy("item").agg(F.min("miss").alias("miss"))  # 0 before A before B before C
    rows = scored.join(worst, "item", "left").withColumn("miss_group", F.when(F.col("rank") <= 5, F.lit(None)).otherwise(F.col("miss"))).drop("miss", "gold_passages")
    now = datetime.now(UTC)
    finger = ledger.eval_set_fingerprint(items).select(F.col("fingerprint").alias("eval_set_hash"))
    record = rows.agg(F.count(F.lit(1)).alias("n"), *scoring.rank_metrics(F.col("rank")), *scoring.miss_counts(F.col("miss_group"))).join(F.broadcast(finger))  # one row each
    record = record.select(F.lit(now.strftime("%Y%m%d-%H%M%S")).alias("run_id"), F.lit(now.isoformat()).alias("timestamp"), F.lit(change).alias("change"), "*", F.lit(repr(settings)).alias("settings"))
    collections.record_run(rows, record, f"{results}/{now:%Y%m%d-%H%M%S}", runs)
    return record


def runs_table(spark: SparkSession, runs: str) -> DataFrame:
    """Recorded runs with the version of their items, the best of each version marked."""
    labelled = ledger.version_labels(corpus.jsonl(spark, f"{runs}/*.json", RUN), "eval_set_hash", "run_id")
    best = ledger.best_runs(labelled, ["version"], ["hit5"], ["run_id"]).select("run_id", F.lit("*").alias("best"))
    shown = ledger.version_starts(labelled, ["run_id"]).join(best, "run_id", "left")
    return shown.select("run_id", "version", F.coalesce("best", F.lit("")).alias("best"), F.when(F.col("starts"), "new set").otherwise("").alias("set"), "change", "n", "hit5", "hit50", "mrr", F.concat_ws("/", "miss_0", "miss_a", "miss_b", "miss_c").alias("0/A/B/C")).orderBy("run_id")


def compare(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Items of two recorded results with both ranks and what became of them."""
    rows = [spark.read.schema("item string, rank int").json(p).withColumn("run", F.lit(n)) for n, p in enumerate((first, second))]
    return ledger.compare(rows[0].unionByName(rows[1]), "run", "item", "rank", F.lit(0), F.lit(1)).orderBy("item")


def queries() -> dict:
    known: dict = {}
    for m in PLANS:
        known |= importlib.import_module(f"siltmill.plans.{m}").queries()
    return known


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="siltmill")
    parser.add_argument("--master", default="local[*]")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="the names of the core queries")
    run = sub.add_parser("run", help="run a query over a folder of Parquet tables")
    run.add_argument("name")
    run.add_argument("--data", required=True)
    run.add_argument("--out", help="write Parquet there instead of showing rows")
    run.add_argument("--rows", type=int, default=20)
    ix = sub.add_parser("index", help="chunk a crawl into a collection")
    for name in ("--config", "--crawl", "--out"):
        ix.add_argument(name, required=True)
    ix.add_argument("--rebuild", action="store_true")
    ev = sub.add_parser("eval", help="retrieve and score for all items")
    for name in ("--config", "--index", "--items", "--results", "--ledger", "--change"):
        ev.add_argument(name, required=True)
    ev.add_argument("--category")
    ev.add_argument("--limit", type=int)
    sub.add_parser("table", help="recorded runs").add_argument("--ledger", required=True)
    sub.add_parser("compare", help="two recorded results").add_argument("--results", nargs=2, required=True)
    a = parser.parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(queries())))
        return 0
    if a.command == "run" and a.name not in queries():
        parser.error(f"unknown query {a.name}")
    spark = session(a.master)
    if a.command == "run":
        df = queries()[a.name](spark, a.data)
        if a.out:
            df.write.mode("errorifexists").parquet(a.out)
        else:
            print(box_table(df, a.rows))
    elif a.command == "index":
        index(spark, a.config, a.crawl, a.out, a.rebuild)
    elif a.command == "eval":
        print(box_table(evaluate(spark, a.config, a.index, a.items, a.results, a.ledger, a.change, a.category, a.limit)))
    elif a.command == "table":
        print(box_table(runs_table(spark, a.ledger)))
    else:
        print(box_table(compare(spark, *a.results)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
