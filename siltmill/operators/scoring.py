"""Scoring rankings against gold passages, and the metrics of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmill.functions.text import bound, norm_text, quote_fragments
from siltmill.functions.urls import match_url
from siltmill.runtime import cut


def first_place(found: Column) -> Column:
    """The place, from 1, of the first true in an array of booleans; null without one."""
    return F.nullif(F.array_position(found, True), F.lit(0)).cast("int")


def quote_rank(quote: Column, normal_texts: Column) -> Column:
    """The rank at which a quote is complete: the worst of its fragments' first places.

    Null if any fragment is in no text, and for a quote without words. ``normal_texts`` are norm_text forms in rank
    order; they are computed once for a row, however many quotes it has.
    """
    ranks = F.transform(quote_fragments(quote), lambda f: first_place(F.transform(normal_texts, lambda t: F.coalesce(F.contains(t, f), F.lit(False)))))
    return F.when((F.size(ranks) > 0) & F.forall(ranks, lambda r: r.isNotNull()), F.array_max(ranks))


def quote_ranks(quotes: Column, normal_texts: Column) -> Column:
    return bound(normal_texts, lambda t: F.transform(quotes, lambda q: quote_rank(q, t)))


def url_rank(urls: Column, wanted: Column) -> Column:
    """The first place of a url that matches one of the wanted ones."""
    forms = F.transform(wanted, match_url)
    return first_place(F.transform(urls, lambda u: F.array_contains(forms, match_url(u))))


def whole_quote_ranks(quotes: Column, normal_texts: Column) -> Column:
    """The older check: the first text that has a quote from end to end, ellipses and all; null where none has."""
    return bound(normal_texts, lambda t: F.transform(quotes, lambda q: bound(norm_text(q), lambda n: first_place(F.transform(t, lambda x: F.coalesce(F.contains(x, n), F.lit(False)))))))


def check_retrieval(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """``results`` (gold_passages, chunks of rank, url, text) with url_rank, quote_ranks, quote_ranks_fixed and whether all are found.

    A gold page counts under its own url and under those of its manifest row. Ranks are those that the chunks bear. An
    item without gold has null for what is found, and no ranks. ``quote_ranks`` compares whole quotes,
    ``quote_ranks_fixed`` their fragments.
    """
    known = manifest.filter("content_hash is not null").groupBy("content_hash").agg(F.max_by(F.array("url", "final_url"), "seq").alias("_urls"))
    rows = results.withColumn("_row", F.monotonically_increasing_id())
    rows = cut(rows)
    golds = rows.select("_row", F.explode("gold_passages").alias("g")).select("_row", F.col("g.url").alias("u"), F.col("g.content_hash").alias("content_hash"))
    named = golds.join(known, "content_hash", "left").select("_row", F.explode(F.array_compact(F.concat(F.array("u"), F.coalesce("_urls", F.array())))).alias("u"))
    ok = named.groupBy("_row").agg(F.collect_set("u").alias("_ok"))  # three for each gold passage of a row at most
    joined = rows.join(ok, "_row", "left")
    chunks = F.coalesce("chunks", F.array())
    at = lambda place: F.get(chunks, place - 1)["rank"]
    quotes = F.transform("gold_passages", lambda p: p["quote"])
    texts = F.transform(chunks, lambda c: norm_text(c["text"]))
    url = F.filter(chunks, lambda c: F.array_contains("_ok", c["url"]))
    gold = F.coalesce(F.size("gold_passages"), F.lit(0)) > 0
    none = F.array().cast("array<int>")
    whole, parts = F.transform(whole_quote_ranks(quotes, texts), at), F.transform(quote_ranks(quotes, texts), at)
    out = joined.withColumns({"url_rank": F.when(gold, F.get(url, F.lit(0))["rank"]), "quote_ranks": F.when(gold, whole).otherwise(none), "quote_ranks_fixed": F.when(gold, parts).otherwise(none)})
    all_ = lambda c: F.when(gold, F.forall(c, lambda r: r.isNotNull()))
    return out.withColumns({"url_retrieved": F.when(gold, F.col("url_rank").isNotNull()), "quote_retrieved": all_("quote_ranks"), "quote_retrieved_fixed": all_("quote_ranks_fixed")}).drop("_row", "_ok")


def passage_misses(passages: DataFrame, rank: str, url: str, quote: str, indexed: DataFrame, corpus: DataFrame, text: str) -> DataFrame:
    """``passages`` with miss: null up to rank 5, else 0, A, B or C, by the rules of ``miss_group`` for one passage.

    ``indexed`` has the urls of the index, ``corpus`` the normal texts of its units.
    """
    rows = cut(passages.withColumn("_u", match_url(F.col(url))).withColumn("_p", F.monotonically_increasing_id()))
    urls = indexed.select(match_url(F.col("url")).alias("_u")).distinct().withColumn("_in", F.lit(True))
    parts = rows.select("_p", F.explode(quote_fragments(F.col(quote))).alias("f"))
    inside = contained_anywhere(parts, "f", corpus, text).withColumn("_found", F.lit(True))
    whole = parts.join(inside, "f", "left").groupBy("_p").agg(F.bool_and(F.coalesce("_found", F.lit(False))).alias("_held"))
    joined = rows.join(urls, "_u", "left").join(whole, "_p", "left")
    group = miss_group(F.col(rank), F.col("_in").isNotNull(), F.coalesce("_held", F.lit(False)))
    return joined.withColumn("miss", F.nullif(group, F.lit("hit"))).drop("_u", "_p", "_in", "_held")


def worst(ranks: Column) -> Column:
    """The worst rank; null where any is missing or there is none."""
    return F.when((F.size(ranks) > 0) & F.forall(ranks, lambda r: r.isNotNull()), F.array_max(ranks))


def miss_group(rank: Column, indexed: Column, contained: Column) -> Column:
    """hit up to 5; 0: gold page not indexed; A: quote in no unit; C: not retrieved or beyond 50; B: 6 to 50."""
    return F.when(rank <= 5, "hit").when(~indexed, "0").when(~contained, "A").when(rank.isNull() | (rank > 50), "C").otherwise("B")


def rank_metrics(rank: Column) -> list[Column]:
    """hit5, hit50 and mrr over rows; a null rank counts as no hit and 0. Null over no rows."""
    within = lambda k: F.avg(F.coalesce((rank <= k).cast("int"), F.lit(0)))
    return [within(5).alias("hit5"), within(50).alias("hit50"), F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr")]


def miss_counts(group: Column) -> list[Column]:
    return [F.count_if(group == g).alias(f"miss_{g.lower()}") for g in ("0", "A", "B", "C")]


def metrics_by(rows: DataFrame, rank: str, levels: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Metrics over everything and by each level, in one pass with grouping sets. ``level`` names the grouping."""
    cube = rows.groupingSets([[lv] for lv in levels] + [[]], *levels)
    name = F.coalesce(*[F.when(F.grouping(lv) == 0, F.lit(lv)) for lv in levels], F.lit("all"))
    value = F.coalesce(*[F.when(F.grouping(lv) == 0, F.coalesce(F.col(lv), F.lit("-"))) for lv in levels], F.lit("all"))
    out = cube.agg(name.alias("level"), value.alias("value"), F.count(F.lit(1)).alias("n"), *rank_metrics(F.col(rank)), *(extra or []))
    return out.drop(*levels)


def multihop_metrics(items: DataFrame, item: str, ranks: str) -> DataFrame:
    """One row: joint and single hits, passage recall and reciprocal ranks of items with several passages.

    ``ranks`` is an array with a rank or null for each passage; an item counts once, passage_mrr over passages.
    """
    r = F.col(ranks)
    have = F.filter(r, lambda x: x.isNotNull())
    last, first = worst(r), F.array_min(have)
    within = lambda k: F.size(F.filter(have, lambda x: x <= k)) / F.size(r)
    rows = items.filter(F.size(r) > 0).select(
        F.col(item), last.alias("last"), first.alias("first"), within(5).alias("r5"), within(10).alias("r10"),
        F.aggregate(have, F.lit(0.0), lambda s, x: s + 1.0 / x).alias("inv"), F.size(r).alias("n"),
    )
    share = lambda c, k: F.avg(F.coalesce((F.col(c) <= k).cast("int"), F.lit(0)))
    return rows.agg(
        F.count(F.lit(1)).alias("num_items"),
        *[share("last", k).alias(f"joint_hit{k}") for k in (5, 10, 50)],
        *[share("first", k).alias(f"hit{k}") for k in (5, 10, 50)],
        F.avg("r5").alias("passage_recall5"),
        F.avg("r10").alias("passage_recall10"),
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr_first"),
        F.avg(F.coalesce(1.0 / F.col("last"), F.lit(0.0))).alias("mrr_joint"),
        (F.sum("inv") / F.sum("n")).alias("passage_mrr"),
    )


def complete_mean(value: Column) -> Column:
    """The rounded mean, null unless every row has the value."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.bround(F.avg(value), 0).cast("int"))


def failure_type(error: Column, verdict: Column, grounded: Column, quote_retrieved: Column) -> Column:
    """What went wrong with an answered item; null if nothing."""
    ok = (verdict == "correct") & grounded
    return (
        F.when(error.isNotNull(), "error")
        .when(F.coalesce(ok, F.lit(False)), None)
        .when(F.coalesce(~quote_retrieved, F.lit(False)), "retrieval")
        .when(F.coalesce(verdict != "correct", F.lit(True)), "reading")
        .otherwise("hallucination")
    )


def contained_anywhere(fragments: DataFrame, fragment: str, corpus: DataFrame, normal_text: str) -> DataFrame:
    """The distinct fragments (norm_text forms) that stand in some text.

    A fragment can only stand in a text that has all its words, so fragments meet texts on their rarest word, counted
    over the corpus, and the substring test runs on those pairs only. A fragment whose rarest word is in very many texts is
    split over them by the join's skew handling.
    """
    distinct = fragments.select(F.col(fragment).alias("f")).filter(F.trim("f") != "").distinct()
    word = distinct.select("f", F.explode(F.array_distinct(F.split(F.trim("f"), " "))).alias("w"))
    texts = corpus.select(F.col(normal_text).alias("t")).withColumn("h", F.xxhash64("t"))
    words = texts.select("h", F.explode(F.array_distinct(F.split(F.trim("t"), " "))).alias("w"))
    used = words.join(word.select("w").distinct(), "w", "left_semi")
    df_ = used.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rarest = word.join(df_, "w").groupBy("f").agg(F.min_by("w", F.struct("n", "w")).alias("w"), F.count(F.lit(1)).alias("found"))
    whole = rarest.join(word.groupBy("f").agg(F.count(F.lit(1)).alias("all")), "f").filter("found = all").select("f", "w")
    pairs = used.join(whole, "w").select("h", "f").join(texts, "h").filter(F.contains("t", "f"))
    return pairs.select(F.col("f").alias(fragment)).distinct()


def uncovered(gold_urls: DataFrame, url: str, indexed: DataFrame, indexed_url: str) -> DataFrame:
    """The distinct gold pages that are not indexed, in matching form."""
    want = gold_urls.select(match_url(F.col(url)).alias("url")).filter("url <> ''").distinct()
    return want.join(indexed.select(match_url(F.col(indexed_url)).alias("url")).distinct(), "url", "left_anti")
