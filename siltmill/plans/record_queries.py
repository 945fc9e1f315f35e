"""Queries of the general record problems: nested records, snapshots, drifting files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmill.functions.text import is_blank, squeezed
from siltmill.functions.urls import page_url
from siltmill.operators import schema_drift, shredding, snapshots
from siltmill.runtime import cut, table

E2E_KEY = ["run_id", "id"]


def _entity(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """A flat table, without the record hash: the key names a record here."""
    rows = table(spark, sf_dir, "e2e_rows")
    return shredding.shred(rows, E2E_KEY, [label])[label].drop("record_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each child record of a result."""
    rows = table(spark, sf_dir, "e2e_rows")
    nodes = cut(shredding.adjacency(rows, E2E_KEY, ["chunks[].rank", "quote_ranks", "unsupported_claims"]))
    of = lambda label, columns=None: shredding.entity(nodes, rows.schema, E2E_KEY, label, columns)
    at = lambda df, child: df.select("run_id", "id", F.lit(child).alias("child"), "pos")
    claims = of("unsupported_claims[]").filter(~is_blank(F.col("value")))
    found = (
        at(of("chunks[]", ["rank"]), "chunk")
        .unionByName(at(of("quote_ranks[]"), "quote_rank"))
        .unionByName(at(claims, "unsupported_claim"))
    )
    return found.distinct()


def p1_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of results: their scalar fields. What is nested in a result is in the tables below, by its key."""
    return _entity(spark, sf_dir, "")


def p1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat child table of errors: at most one of each result."""
    return _entity(spark, sf_dir, "error")


def p1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat child table of retrieved chunks."""
    return _entity(spark, sf_dir, "chunks[]")


def p1_quote_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat child table of quote ranks."""
    return _entity(spark, sf_dir, "quote_ranks[]")


def p1_quote_ranks_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat child table of quote ranks with the fixed matching."""
    return _entity(spark, sf_dir, "quote_ranks_fixed[]")


def p1_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat child table of unsupported claims."""
    return _entity(spark, sf_dir, "unsupported_claims[]")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages added, removed or changed between consecutive snapshots."""
    rows = table(spark, sf_dir, "chunk_output")
    columns = [F.col("id"), squeezed(F.col("title")), squeezed(F.col("heading")), F.col("depth"), F.col("n_words")]
    changes = snapshots.snapshot_changes(rows, page_url(F.col("url")), F.col("fetched_int"), columns)
    return changes.select(F.col("key").alias("url"), F.col("snapshot").alias("fetched_int"), "change_kind")


def _run_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(schema_drift.read_fields(table(spark, sf_dir, "runs_raw"), "ledger", "file_no", "line_no", "raw_record", "run_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a field between consecutive files of a ledger."""
    changes = schema_drift.field_changes(_run_fields(spark, sf_dir))
    return changes.select(F.col("grp").alias("ledger"), "file_no", "change_kind", "field_path", "new_path")


def _union(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The values of all runs in the latest layout, and its schema."""
    fields = _run_fields(spark, sf_dir)
    heads = cut(schema_drift.file_schemas(fields))
    names = cut(schema_drift.latest_names(schema_drift.field_changes(fields), heads))
    return cut(schema_drift.union_rows(fields, names)), cut(schema_drift.union_schema(heads, names))


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs in one table in the latest layout."""
    rows, schema = _union(spark, sf_dir)
    return schema_drift.union_table(rows, schema, leave_out=["run_id"]).withColumnsRenamed({"grp": "ledger", "run": "run_id"})


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in long form: for each run and field of the latest layout the type of the field and the value, as text."""
    rows, schema = _union(spark, sf_dir)
    return rows.join(schema, "path").select(F.col("grp").alias("ledger"), F.col("run").alias("run_id"), F.col("path").alias("field"), "kind", "file_no", "value")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_results, p1_errors, p1_chunks, p1_quote_ranks, p1_quote_ranks_fixed, p1_claims, p3_found, p5_found, p5_runs, p5_values)}
