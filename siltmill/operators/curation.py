"""Drafts, evaluation sets, and gold quotes against a new crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmill.functions.text import norm_text, quote_fragments
from siltmill.functions.urls import match_url
from siltmill.operators.categories import CATEGORIES
from siltmill.runtime import cut
from siltmill.sources.corpus import find_page


def _holds(text: Column, quote: Column) -> Column:
    """Whether a text has all fragments of a quote, as whole words."""
    parts = quote_fragments(quote)
    return (F.size(parts) > 0) & F.forall(parts, lambda f: F.coalesce(F.contains(norm_text(text), f), F.lit(False)))


def check_passages(items: DataFrame, manifest: DataFrame, texts: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each gold passage: page found, quote in it. ``texts`` has key and text.

    Only pages that some passage names have their text normalised.
    """
    one = items.select(*keep, F.posexplode_outer("gold_passages").alias("passage", "_p"))
    one = one.select(*keep, "passage", F.col("_p.url").alias("url"), F.col("_p.content_hash").alias("content_hash"), F.col("_p.quote").alias("quote"))
    found = find_page(one, manifest)
    named = texts.select(F.col("key").alias("page_key"), F.col("text").alias("_t"))
    joined = found.join(named, "page_key", "left")
    return joined.withColumn("in_page", _holds(F.col("_t"), F.col("quote"))).drop("_t")


def validate_drafts(drafts: DataFrame, existing: DataFrame, manifest: DataFrame, texts: DataFrame, indexed: DataFrame) -> DataFrame:
    """(id, status, reasons, flags, n_passages) of each draft item.

    ``drafts`` and ``existing`` are evaluation items, ``indexed`` has the urls of the index. A draft whose id exists
    is a duplicate, noted if its gold differs. Otherwise it fails for each missing field, unknown page, quote that is
    not in its page or page that is not indexed; fewer than two passages are flagged.
    """
    known = existing.select("id", F.to_json("gold_passages").alias("_gold")).groupBy("id").agg(F.min("_gold").alias("_gold"))
    own = drafts.withColumn("_row", F.monotonically_increasing_id())
    checked = check_passages(own, manifest, texts, ["_row"])
    urls = indexed.select(match_url(F.col("url")).alias("_u")).distinct().withColumn("_indexed", F.lit(True))
    checked = checked.withColumn("_u", match_url(F.col("url"))).join(urls, "_u", "left").filter("passage is not null")
    problem = (
        F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "passage without url")
        .when(F.coalesce(F.trim("quote"), F.lit("")) == "", "passage without quote")
        .when(F.col("page_key").isNull(), "no page")
        .when(~F.col("in_page"), "quote not in page")
        .when(F.col("_indexed").isNull(), "url not indexed")
    )
    bad = checked.groupBy("_row").agg(F.array_sort(F.collect_set(problem)).alias("_bad"))
    joined = own.join(bad, "_row", "left").join(known, "id", "left")
    n = F.coalesce(F.size("gold_passages"), F.lit(0))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reasons = F.concat(
        F.array_compact(F.array(F.when(blank("id"), "no id"), F.when(blank("question"), "no question"), F.when(n <= 0, "no gold"))),
        F.coalesce("_bad", F.array().cast("array<string>")),
    )
    twice = F.col("_gold").isNotNull()
    differs = twice & ~F.col("_gold").eqNullSafe(F.to_json("gold_passages"))
    return joined.select(
        "id",
        F.when(twice, "duplicate").when(F.size(reasons) > 0, "fail").otherwise("pass").alias("status"),
        F.when(twice, F.array_compact(F.array(F.lit("id exists"), F.when(differs, "gold differs")))).otherwise(reasons).alias("reasons"),
        F.array_compact(F.array(F.when((n < 2), "fewer than two passages"))).alias("flags"),
        F.greatest(n, F.lit(0)).cast("int").alias("n_passages"),
    )


def check_gold(items: DataFrame, old: DataFrame, old_texts: DataFrame, new: DataFrame, new_texts: DataFrame, today: str) -> DataFrame:
    """(id, passage, url, old_hash, new_hash, status, stale) of each gold passage against a new crawl.

    The page is sought in the old crawl by hash, url or unique path, and in the new one by the old page's url. Status, the first that holds:
    BAD-GOLD (not in the old page), MISSING (no new page), unchanged, changed-ok (quote still there), BROKEN.
    """
    before = check_passages(items, old, old_texts, ["id", "category", "stale_risk", "valid_until"]).filter("passage is not null")
    old_url = old.filter("key is not null").groupBy("key").agg(F.max_by("url", "seq").alias("_old_url"))
    before = before.join(old_url.withColumnRenamed("key", "page_key"), "page_key", "left")
    latest = new.filter("key is not null and status = 200").groupBy(F.col("url").alias("_old_url")).agg(F.max_by(F.struct("key", "content_hash"), "seq").alias("_n"))
    joined = before.join(latest, "_old_url", "left").join(new_texts.select(F.col("key").alias("_k"), F.col("text").alias("_t")), F.col("_n.key") == F.col("_k"), "left")
    status = (
        F.when(F.col("page_key").isNull() | ~F.coalesce("in_page", F.lit(False)), "BAD-GOLD")
        .when(F.col("_n").isNull(), "MISSING")
        .when(F.col("_n.content_hash").eqNullSafe(F.col("page_hash")), "unchanged")
        .when(_holds(F.col("_t"), F.col("quote")), "changed-ok")
        .otherwise("BROKEN")
    )
    stale = F.array_compact(
        F.array(
            F.when(F.col("category") == "temporal", "temporal"),
            F.when(F.col("stale_risk") == "high", "high stale risk"),
            F.when(F.col("valid_until") < today, "past valid_until"),
        )
    )
    return joined.select("id", "passage", "url", F.col("page_hash").alias("old_hash"), F.col("_n.content_hash").alias("new_hash"), status.alias("status"), stale.alias("stale"))


def check_drafts(drafts: DataFrame, existing: DataFrame, manifest: DataFrame, texts: DataFrame, indexed: DataFrame, category: str = "wanted") -> DataFrame:
    """``drafts`` with reasons (which fail a draft) and flags (for a reviewer). The column ``category`` says which was wanted.

    Consistency of category, answer and answerability; an unanswerable draft must have no gold, and nothing else of it
    is looked at. The others must pass ``validate_drafts``, and no quote may be one that an existing item has. A
    passage whose hash is not among the manifest's is flagged as stale, a multi-hop draft with one passage too.
    """
    rows = cut(drafts.withColumn("_row", F.monotonically_increasing_id()))
    fields = ["id", "question", "gold_passages"]
    schema = validate_drafts(rows.select(F.col("_row").cast("string").alias("id"), "question", "gold_passages"), existing.select(*fields).filter("false"), manifest, texts, indexed)
    schema = schema.select(F.col("id").cast("long").alias("_row"), F.col("reasons").alias("_reasons"), F.col("flags").alias("_flags"))
    one = rows.select("_row", F.posexplode("gold_passages").alias("p", "g")).select("_row", "p", F.col("g.content_hash").alias("content_hash"), norm_text(F.col("g.quote")).alias("q"))
    hashes = manifest.select("content_hash").filter("content_hash is not null").distinct().withColumn("_known", F.lit(True))
    quotes = existing.select(F.explode("gold_passages").alias("g")).select(norm_text(F.col("g.quote")).alias("q")).distinct().withColumn("_used", F.lit(True))
    n = (F.col("p") + 1).cast("string")
    said = one.join(hashes, "content_hash", "left").join(quotes, "q", "left").groupBy("_row").agg(
        F.array_sort(F.collect_set(F.when(F.col("_known").isNull(), F.concat(F.lit("passage "), n, F.lit(": not in the current snapshot"))))).alias("_stale"),
        F.array_sort(F.collect_set(F.when(F.col("_used").isNotNull(), F.concat(F.lit("passage "), n, F.lit(": quote of an existing item"))))).alias("_twice"),
    )
    none, empty = F.array().cast("array<string>"), lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    joined = rows.join(schema, "_row", "left").join(said, "_row", "left")
    hopeless = F.col(category) == "unanswerable"
    common = F.array_compact(F.array(F.when(~F.col("category").eqNullSafe(F.col(category)), "other category"), F.when(empty("answer") & empty("gold_answer"), "no answer")))
    closed = F.array_compact(F.array(F.when(~F.col("answerable").eqNullSafe(F.lit(False)), "not marked unanswerable"), F.when(F.coalesce(F.size("gold_passages"), F.lit(0)) > 0, "unanswerable with gold")))
    open_ = F.concat(F.array_compact(F.array(F.when(~F.col("answerable").eqNullSafe(F.lit(True)), "not marked answerable"))), F.coalesce("_reasons", none), F.coalesce("_twice", none))
    shown = F.concat(F.when(F.col(category) == "multi-hop", F.coalesce("_flags", none)).otherwise(none), F.coalesce("_stale", none))
    reasons = F.concat(common, F.when(hopeless, closed).otherwise(open_))
    return joined.withColumns({"reasons": reasons, "flags": F.when(hopeless, none).otherwise(shown)}).drop("_row", "_reasons", "_flags", "_stale", "_twice")


def candidates(drafts: DataFrame, passing: Column, order: list[str], per_category: int = 5) -> DataFrame:
    """The first passing drafts of each category in file order."""
    w = Window.partitionBy("category").orderBy(*order)
    return drafts.filter(passing).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_category)


def approved_items(candidates_: DataFrame, approved: list[str]) -> DataFrame:
    """The candidates with these ids, as verified by a person. Raises where an id is none of them."""
    known = {r["id"] for r in candidates_.filter(F.col("id").isin(approved)).select("id").distinct().collect()} if approved else set()
    if unknown := sorted(set(approved) - known):
        raise ValueError(f"no candidates: {unknown}")
    return candidates_.filter(F.col("id").isin(approved)).withColumn("verified_by", F.lit("human"))


def category_counts(items: DataFrame, least: int = 10) -> DataFrame:
    """(category, n, enough) of each of the six categories: the gate of a set."""
    all_ = items.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    n = items.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return all_.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= least).alias("enough"))


def combined(dev: DataFrame, approved: DataFrame) -> DataFrame:
    """Dev items, and approved ones as test."""
    return dev.withColumn("split", F.lit("dev")).unionByName(approved.withColumn("split", F.lit("test")), allowMissingColumns=True)


def freeze(dev: DataFrame, approved: DataFrame, least: int = 10) -> DataFrame:
    """The evaluation set. Raises unless all categories have enough items."""
    both = combined(dev, approved)
    short = {r["category"]: r["n"] for r in category_counts(both, least).filter("not enough").collect()}
    if short:
        raise ValueError(f"too few items: {short}")
    return both


def gold_status(report: DataFrame) -> tuple[DataFrame, bool]:
    """(status, n) of a gold check, and whether anything in it is wrong: a caller's exit code."""
    counts = report.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts, bool(counts.filter(F.col("status").isin("BROKEN", "MISSING", "BAD-GOLD")).take(1))


def chosen(items: DataFrame, category: str | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """Items of one category, and the first few of them, for a trial run."""
    rows = items if category is None else items.filter(F.col("category") == category)
    return rows if limit is None else rows.orderBy(order).limit(limit)
