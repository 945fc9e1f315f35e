"""Nested records, snapshots and drifting files on small fixtures."""

import json
import random

from pyspark.sql import functions as F

from siltmill.operators import schema_drift, shredding, snapshots
from siltmill.plans import record_queries

KIND = "run string, id string, node string, chunks array<struct<rank:int,tags:array<string>,pos:string>>, marks array<int>, extra map<string,int>, raw binary"
ROWS = [
    ("r1", "a", "clash", [(1, ["x", None], "p"), None, (None, [], None)], [3, None], {"k": 1}, b"\x00\xff"),
    ("r1", "a", "clash", [(1, ["x", None], "p"), None, (None, [], None)], [3, None], {"k": 1}, b"\x00\xff"),
    ("r1", "b", None, [], None, None, None),
    (None, "c", "", None, [], {}, b""),
    ("r1", "d", "long " * 50_000, [(2, None, "")], [0], None, None),
]


def test_shred_keeps_every_element_and_link(spark):
    df = spark.createDataFrame(ROWS, KIND)
    out = shredding.shred(df, ["run", "id"], ["", "chunks[]", "chunks[].tags[]", "marks[]", "extra[]"])
    chunks = {(r["id"], r["chunks_pos"], r["pos"]): r for r in out["chunks[]"].collect()}
    assert {(k[0], k[2]) for k in chunks} == {("a", 1), ("a", 3), ("d", 1)}
    assert chunks["a", "p", 1]["rank"] == 1 and chunks["a", None, 3]["rank"] is None and chunks["a", "p", 1]["node_id"] == "/chunks/1".lstrip("/")
    tags = {(r["id"], r["parent_id"], r["pos"], r["value"]) for r in out["chunks[].tags[]"].collect()}
    assert tags == {("a", "chunks/1/tags", 1, "x"), ("a", "chunks/1/tags", 2, None)}
    assert sorted((r["id"], r["pos"], r["value"]) for r in out["marks[]"].collect() if r["value"] is not None) == [("a", 1, 3), ("d", 1, 0)]
    roots = {r["id"]: r for r in out[""].collect()}
    assert set(roots) == {"a", "b", "c", "d"} and bytes(roots["a"]["raw"]) == b"\x00\xff" and len(roots["d"]["node"]) == 250_000
    assert [(r["key"], r["value"]) for r in out["extra[]"].collect()] == [("k", 1)]


def test_shred_same_key_other_content_stays_apart(spark):
    df = spark.createDataFrame([("r", "a", [1, None]), ("r", "a", [None, 1])], "run string, id string, marks array<int>")
    found = shredding.shred(df, ["run", "id"], ["marks[]"])["marks[]"]
    assert found.count() == 4 and found.select("record_id").distinct().count() == 2


def test_shred_empty_table(spark):
    out = shredding.shred(spark.createDataFrame([], KIND), ["run", "id"], ["", "chunks[]", "marks[]"])
    assert all(df.count() == 0 for df in out.values()) and "rank" in out["chunks[]"].columns


def brute_changes(rows):
    days = sorted({d for _, d, _ in rows if d is not None})
    sets = {}
    for k, d, v in rows:
        if k is not None and d is not None:
            sets.setdefault((k, d), set()).add(v)
    out = set()
    for a, b in zip(days, days[1:], strict=False):
        for k in {k for k, d in sets if d in (a, b)}:
            x, y = sets.get((k, a)), sets.get((k, b))
            if x != y:
                out.add((k, b, "added" if x is None else "removed" if y is None else "changed"))
    return out


def test_snapshot_changes_random(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", "hot", "hot", "hot", None]), rng.choice([1, 2, 4, 9, None]), rng.choice(["x", "y", "", None])) for _ in range(300)]
    rows += rows[:40] + [("late", 9, "z"), ("back", 1, "z"), ("back", 4, "z")]
    df = spark.createDataFrame(rows, "k string, d int, v string")
    found = snapshots.snapshot_changes(df, F.col("k"), F.col("d"), [F.col("v")])
    assert {tuple(r) for r in found.collect()} == brute_changes(rows)
    assert found.count() == len(brute_changes(rows))


def test_snapshot_changes_swapped_values_count(spark):
    df = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, "a")], "k string, d int, v string, w string")
    assert snapshots.snapshot_changes(df, F.col("k"), F.col("d"), [F.col("v"), F.col("w")]).count() == 1
    assert snapshots.snapshot_changes(df.limit(0), F.col("k"), F.col("d"), [F.col("v")]).count() == 0
    assert snapshots.snapshot_changes(df.filter("d = 1"), F.col("k"), F.col("d"), [F.col("v")]).count() == 0


def _files(files):
    return [("l", no, i, x if isinstance(x, str) or x is None else json.dumps(x)) for no, lines in files.items() for i, x in enumerate(lines)]


def _fields(spark, rows):
    df = spark.createDataFrame(rows, "ledger string, file_no int, line_no int, raw string")
    return schema_drift.read_fields(df, "ledger", "file_no", "line_no", "raw", "run_id")


def test_field_changes(spark):
    files = {
        1: [{"run_id": "a", "c": {"x": 1, "t": "u"}, "g": 5, "e": {}}, {"run_id": "b", "c": {"x": 2, "t": "v"}, "g": 6, "o": True}, "", "{bad", None, "[1]", "NaN"],
        2: [{"run_id": "b", "c": {"y": 2, "t": ["v"]}, "o": True, "m": {"n": None}}, {"run_id": "d", "c": {"y": 9}, "h": 1.5}],
        4: [{"run_id": "z", "other": 1}],
        5: ["broken"],
    }
    found = {tuple(r)[2:] + (r["file_no"],) for r in schema_drift.field_changes(_fields(spark, _files(files))).collect()}
    assert found == {
        ("renamed", "c.x", "c.y", 2),
        ("retyped", "c.t", "", 2),
        ("removed", "g", "", 2),
        ("added", "h", "", 2),
        ("removed", "run_id", "", 5),
        ("removed", "other", "", 5),
    }


def test_field_changes_whole_and_broken_numbers_are_one_type(spark):
    files = {1: [{"run_id": "a", "x": 1}], 2: [{"run_id": "a", "x": 1.5}], 3: [{"run_id": "a", "x": True}]}
    found = [(r["file_no"], r["change_kind"]) for r in schema_drift.field_changes(_fields(spark, _files(files))).collect()]
    assert found == [(3, "retyped")]
    assert schema_drift.field_changes(_fields(spark, [])).count() == 0


def _changes(spark, files):
    return sorted((r["file_no"], r["change_kind"], r["field_path"], r["new_path"]) for r in schema_drift.field_changes(_fields(spark, _files(files))).collect())


def test_a_rename_needs_the_same_types_and_values(spark):
    swapped = {1: [{"run_id": "a", "a": "5"}, {"run_id": "b", "a": 7}], 2: [{"run_id": "a", "b": 5}, {"run_id": "b", "b": "7"}]}
    assert _changes(spark, swapped) == [(2, "added", "b", ""), (2, "removed", "a", "")]
    whole = {1: [{"run_id": "a", "a": 5.0, "l": [1.0, {"k": 2.0}]}], 2: [{"run_id": "a", "b": 5, "m": [1, {"k": 2}]}]}
    assert _changes(spark, whole) == [(2, "renamed", "a", "b"), (2, "renamed", "l", "m")]
    fewer = {1: [{"run_id": "a", "a": 1}, {"run_id": "b"}], 2: [{"run_id": "a", "b": 1}, {"run_id": "b", "b": 1}]}
    assert _changes(spark, fewer) == [(2, "added", "b", ""), (2, "removed", "a", "")]
    no_run = {1: [{"run_id": "a", "a": 1}], 2: [{"run_id": "z", "b": 1}]}
    assert _changes(spark, no_run) == [(2, "added", "b", ""), (2, "removed", "a", "")]


def test_every_pair_that_agrees_is_a_rename(spark):
    files = {1: [{"run_id": "a", "x": 1}], 2: [{"run_id": "a", "q.x": 1, "b": 1}]}
    assert _changes(spark, files) == [(2, "renamed", "x", "b"), (2, "renamed", "x", "q.x")]


def test_lone_surrogates_and_very_long_values(spark):
    rows = [("l", 1, 0, '{"run_id": "a", "x": "\\ud800", "y": "' + "z" * 200_000 + '"}'), ("l", 2, 0, '{"run_id": "a", "w": "\\ud800", "y": 1}')]
    found = sorted((r["change_kind"], r["field_path"], r["new_path"]) for r in schema_drift.field_changes(_fields(spark, rows)).collect())
    assert found == [("renamed", "x", "w"), ("retyped", "y", "")]


def test_copies_of_a_line_count_once(spark):
    files = {1: [{"run_id": "a", "x": 1}] * 50 + [{"run_id": "a", "x": 2}], 2: [{"run_id": "a", "y": 2}] * 3 + [{"run_id": "a", "y": 1}]}
    assert _changes(spark, files) == [(2, "renamed", "x", "y")]


def _union(spark, rows):
    fields = _fields(spark, rows).cache()
    heads = schema_drift.file_schemas(fields)
    names = schema_drift.latest_names(schema_drift.field_changes(fields), heads)
    return schema_drift.union_rows(fields, names), schema_drift.union_schema(heads, names)


def test_union_table_has_the_latest_layout(spark):
    files = {
        1: [{"run_id": "a", "x": 1, "t": "u"}, {"run_id": "b", "x": 2, "t": "v"}],
        2: [{"run_id": "b", "y": 2, "t": ["v"]}, {"run_id": "c", "y": 3.5, "t": ["w", "q"]}],
    }
    rows, schema = _union(spark, _files(files))
    assert sorted(tuple(r)[:2] for r in schema.collect()) == [("run_id", "string"), ("t", "array"), ("y", "double")]
    found = {r["run"]: (r["file_no"], r["t"], r["y"]) for r in schema_drift.union_table(rows, schema, ["run_id"]).collect()}
    assert found == {"a": (1, ["u"], 1.0), "b": (2, ["v"], 2.0), "c": (2, ["w", "q"], 3.5)}
    few = schema_drift.union_table(rows, schema, ["run_id"], most_columns=1)
    assert few.columns == ["grp", "run", "file_no", "t", "more_fields"] and {r["run"]: r["more_fields"] for r in few.collect()} == {"a": {"y": "1"}, "b": {"y": "2"}, "c": {"y": "3.5"}}


def test_a_list_that_a_run_lacks_is_null(spark):
    rows, schema = _union(spark, _files({1: [{"run_id": "a", "t": ["x", None, 1]}, {"run_id": "b", "t": "é"}, {"run_id": "c", "n": 1}, {"run_id": "d", "t": []}]}))
    table = {r["run"]: (r["n"], r["t"]) for r in schema_drift.union_table(rows, schema, ["run_id"]).collect()}
    assert table == {"a": (None, ["x", None, "1"]), "b": (None, ["é"]), "c": (1, None), "d": (None, [])}


def test_a_chain_of_renames_ends_in_the_last_name(spark):
    files = {n: [{"run_id": f"r{m}", f"n{n}": m} for m in (n - 1, n)] for n in range(1, 12)}
    rows, schema = _union(spark, _files(files))
    assert {(r["run"], r["path"], r["value"]) for r in rows.collect() if r["path"] != "run_id"} == {(f"r{m}", "n11", str(m)) for m in range(12)}
    assert sorted(r["path"] for r in schema.collect()) == ["n11", "run_id"]


def test_names_that_differ_in_case_are_two_columns(spark):
    rows, schema = _union(spark, _files({1: [{"run_id": "a", "Limit": 1, "limit": 2, "file_no": 3, "x.y": 4}]}))
    table = schema_drift.union_table(rows, schema, ["run_id"])
    assert table.columns == ["grp", "run", "file_no", "Limit", "file_no_2", "limit_2", "x.y"]
    assert tuple(table.first()) == ("l", "a", 1, 1, 3, 2, 4)
    empty, none = _union(spark, [])
    assert schema_drift.union_table(empty, none).columns == ["grp", "run", "file_no"]


def test_every_field_of_a_result_is_in_a_flat_table(spark, tmp_path):
    kind = "run_id string, id string, answer string, chunks array<struct<rank:int>>, quote_ranks array<int>, quote_ranks_fixed array<int>, unsupported_claims array<string>, error struct<stage:string,message:string,trace:string>"
    rows = [("r", "a", "x", [(1,)], [1], [2, None], ["c"], None), ("r", "b", None, None, None, [], None, ("answer", "timed out", None)), ("r", "c", None, None, None, None, None, (None, None, None))]
    spark.createDataFrame(rows + rows[:2], kind).write.parquet(str(tmp_path / "e2e_rows.parquet"))
    errors = record_queries.p1_errors(spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["parent_id"], r["stage"] or "", r["message"], r["trace"]) for r in errors) == [("b", "", "answer", "timed out", None), ("c", "", "", None, None)]
    fixed = record_queries.p1_quote_ranks_fixed(spark, str(tmp_path)).collect()
    assert {(r["id"], r["pos"], r["value"]) for r in fixed} == {("a", 1, 2), ("a", 2, None)} and len(fixed) == 2
    flat = [f for n, f in record_queries.queries().items() if n.startswith("p1_") and n != "p1_found"]
    nodes = {r["node_id"].split("/")[0] for f in flat for r in f(spark, str(tmp_path)).select("node_id").collect()}
    assert nodes == {"", "chunks", "quote_ranks", "quote_ranks_fixed", "unsupported_claims", "error"}
