"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmill.functions.urls import host
from siltmill.llm import boilerplate, mixing, neardup, packing, pair_defects, splitting
from siltmill.llm.tokens import token_count
from siltmill.runtime import table

#: What the problem statement of this project's data asks of near-duplicate chunks.
CHUNK_SHINGLE, CHUNK_THRESHOLD = 3, 0.6


def _chunk_copies(spark: SparkSession, sf_dir: str) -> neardup.NearDup:
    return neardup.near_duplicates(table(spark, sf_dir, "chunks"), "id", "text", CHUNK_SHINGLE, CHUNK_THRESHOLD)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose texts are alike. The suffix filter is the sketch bound of ``neardup``; it loses no pair."""
    return neardup.linked_pairs(_chunk_copies(spark, sf_dir))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with a text, the group it belongs to, its copies and its links."""
    return neardup.groups(_chunk_copies(spark, sf_dir)).select(F.col("key").alias("id"), "group_id", "n_copies", "n_links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answer pairs that are unusable, with the defect."""
    return pair_defects.defects(table(spark, sf_dir, "e2e_rows"), ["run_id", "id"], "question", "answer", "category", table(spark, sf_dir, "documents").select("text", "lang"))


def _chunk_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, sf_dir, "chunks").withColumn("site", host(F.col("url")))
    return chunks, boilerplate.repeated_lines(chunks, "id", "site", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of chunks that are repeated excessively on their site."""
    return _chunk_lines(spark, sf_dir)[1]


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk texts without those lines."""
    chunks, lines = _chunk_lines(spark, sf_dir)
    return boilerplate.without_lines(chunks.select("id", "text").distinct(), "id", "text", lines)


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of text that are repeated excessively on their site, wherever lines end, by content-defined chunks."""
    chunks = table(spark, sf_dir, "chunks").withColumn("site", host(F.col("url")))
    return boilerplate.repeated_spans(chunks, "id", "site", "text")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    copies = neardup.groups(neardup.near_duplicates(docs, "doc_id", "text")).select(F.col("key").alias("doc_id"), "group_id")
    sized = docs.select("doc_id", mixing.source_name(F.col("source")).alias("source"), token_count(F.col("text")).alias("n_tokens"))
    return packing.pack(sized.join(copies, "doc_id", "left"), "doc_id", "n_tokens", "source", "group_id")


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training container of each document, or of each piece of a larger one."""
    return _packed(spark, sf_dir).drop("source")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers, what they hold and what is left."""
    return packing.containers(_packed(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "source", token_count(F.col("text")))


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is repeated."""
    return _mixed(spark, sf_dir).selection


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares asked and reached."""
    return _mixed(spark, sf_dir).shares


def p8_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The goals of the sources by capped water-filling, with texts measured in bytes, which SQL can count too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", mixing.source_name(F.col("source")).alias("source"), F.octet_length("text").alias("size")).filter("size > 0")
    found = mixing.goals(docs.groupBy("doc_id", "source").agg(F.max("size").alias("size")), table(spark, sf_dir, "mix_targets"))
    return found.select("source", "size", F.round("goal", 3).alias("goal"), "clamped")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents above the limit."""
    pieces = splitting.split_oversized(table(spark, sf_dir, "documents"), "doc_id", "text", keep_small=False)
    return pieces.filter("n_pieces > 1").select("doc_id").distinct()


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return splitting.split_oversized(docs, "doc_id", "text")


def queries() -> dict:
    of = (p2_found, p2_groups, p4_found, p6_found, p6_clean, p6_spans, p7_assignment, p7_containers, p8_selection, p8_shares, p8_goals, p9_found, p9_pieces)
    return {f.__name__: f for f in of}
