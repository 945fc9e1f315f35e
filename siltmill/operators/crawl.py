"""Crawl bookkeeping as tables: robots rules, link classes, the breadth-first frontier, inspection."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmill.functions.urls import host
from siltmill.runtime import cut

#: Extensions that may be pages.
HTML_EXTENSIONS = r"\.(html?|php|aspx?)$"


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def link_class(url: Column, allowed_host: str, prefixes: Sequence[str]) -> Column:
    """ignored (mail, phone, scripts), off_host, non_html_extension, off_path or enqueue, in this order."""
    path = path_of(url)
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | path.startswith(p)
    return (
        F.when(~url.rlike(r"(?i)^https?://"), "ignored")
        .when(~host(url).eqNullSafe(F.lit(allowed_host)), "off_host")
        .when(path.rlike(r"\.[A-Za-z0-9]{1,5}$") & ~F.lower(path).rlike(HTML_EXTENSIONS), "non_html_extension")
        .when(~inside, "off_path")
        .otherwise("enqueue")
    )


def classify(links: DataFrame, url: str, allowed_host: str, prefixes: Sequence[str], visited: DataFrame | None = None) -> DataFrame:
    """Links with ``reason``; those already visited are dropped without one."""
    fresh = links if visited is None else links.join(visited.select(url).distinct(), url, "left_anti")
    return fresh.withColumn("reason", link_class(F.col(url), allowed_host, prefixes))


def allowed_by_robots(robots: str | None, agent: str) -> Column | None:
    """A function column ``url -> may be fetched`` for one site's robots.txt; None, which allows all, without rules.

    The rules are those of one site, a few kilobytes, and travel with the function.
    """
    if not robots:
        return None
    lines = robots.splitlines()

    def check(urls: pd.Series) -> pd.Series:
        rules = RobotFileParser()
        rules.parse(lines)
        return urls.map(lambda u: u is not None and rules.can_fetch(agent, u))

    return F.pandas_udf(check, T.BooleanType())


def page_gate(status: Column, content_type: Column) -> Column:
    """Why a response is no page; null if it is one."""
    return F.when(~status.eqNullSafe(F.lit(200)), F.concat(F.lit("status "), F.coalesce(status.cast("string"), F.lit("none")))).when(
        ~F.coalesce(F.lower(content_type).contains("html"), F.lit(False)), F.concat(F.lit("content type "), F.coalesce(content_type, F.lit("none")))
    )


def frontier(links: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_pages: int | None = None) -> DataFrame:
    """(url, depth, parent): pages reached from the seeds, breadth first, to ``max_depth`` or until a level is empty.

    The parent is the page whose link puts the url into the queue first: of the last level's pages that link to it, the
    one that comes first in that queue itself, which holds a level's pages in the order of their parents' turns and,
    below a parent, of ``place`` (by url where links have none). Seeds have no parent and take turns by url.

    ``max_pages``: only so many pages are fetched, those that are first in the queue, failed ones among them.

    Each level is one join of the last level with the links and one anti-join with what is known; a level's pages are
    written before the next begins. The number of rounds is the depth, whatever the number of pages.
    """
    place = F.col("place").cast("long") if "place" in links.columns else F.lit(0).cast("long")
    edges = links.select("src", "dst", place.alias("place")).filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("place").alias("place"))
    start = seeds.select("url").filter("url is not null").distinct()
    level = cut(_turns(start.withColumns({"depth": F.lit(0), "parent": F.lit(None).cast("string")}), ["url"]))
    known = level
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        first = F.min_by(F.struct("turn", "place", F.col("url").alias("parent")), F.struct("turn", "place"))
        found = level.join(edges, level["url"] == edges["src"]).groupBy("dst").agg(first.alias("f")).select(F.col("dst").alias("url"), "f.*")
        fresh = found.join(known.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)).withColumnRenamed("turn", "of")
        level = cut(_turns(fresh, ["of", "place", "url"]))
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return (known if max_pages is None else known.orderBy("depth", "turn").limit(max_pages)).drop("turn")


def _turns(level: DataFrame, order: list[str]) -> DataFrame:
    """The pages of a level with their place in the queue, which grows in the order of the columns.

    The rows are sorted across partitions; the turn grows with the partition and the row.
    """
    return level.orderBy(*order).withColumn("turn", F.monotonically_increasing_id()).select("url", "depth", "parent", "turn")


def inspection(manifest: DataFrame) -> DataFrame:
    """Pages, errors, bad statuses and short pages by depth."""
    return manifest.groupBy("depth").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("error").alias("errors"),
        F.count_if(~F.col("status").eqNullSafe(F.lit(200))).alias("not_ok"),
        F.count_if(F.coalesce(F.col("n_chars") < 200, F.lit(False))).alias("short"),
        F.count_distinct("key").alias("n_keys"),
    )


def skipped(classified: DataFrame, url: str, most: int = 40) -> tuple[DataFrame, DataFrame]:
    """(reason, n) of the links that a crawl doesn't follow, and the first ``most`` distinct ones off its paths."""
    out = classified.filter(~F.col("reason").isin("enqueue", "ignored"))
    first = out.filter("reason = 'off_path'").select(url).distinct().orderBy(url).limit(most)
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n")), first
