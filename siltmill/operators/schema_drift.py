"""Files whose fields drift: one consistent table, and a log of every change.

1. ``read_fields`` parses each line once, in parallel over files, into a packed row: run and (path, JSON type, value).
2. ``file_schemas`` folds paths and types into a header for each file, map-side; values are not read for it.
3. ``promote`` is the lattice through which headers fold into the type of the union schema.
4. ``field_changes`` compares the headers of consecutive files. Values are looked at only for fields that are gone or
   new there, and only through one fingerprint for each field of each pair of files.
5. ``latest_names`` follows renames to the last file; ``union_rows`` and ``union_table`` rename, cast and pivot all
   runs into one table in the latest layout.

Defined results: lines that are null, blank, not valid JSON or not an object hold no field; so do nulls and empty
objects. Repeated lines count once. A file without a valid line is still a file, one without fields. Where the
file before is missing, no change is reported. A value is its JSON type and content: "5" is not 5, and 5.0 is 5.
Columns other than those named are ignored; an empty table gives empty results.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmill.runtime import cut

log = logging.getLogger(__name__)

BOOLEAN, INTEGER, FRACTION, STRING, ARRAY = 1, 2, 4, 8, 16
NUMBER = INTEGER | FRACTION
_FIELD = pa.struct([("path", pa.string()), ("type", pa.int32()), ("value", pa.string())])
_PACKED = pa.schema([("grp", pa.string()), ("file_no", pa.int32()), ("line_no", pa.int32()), ("run", pa.string()), ("fields", pa.list_(_FIELD))])
_AT = ["grp", "file_no", "path"]


def promote(bits: Column) -> Column:
    """The least type that holds all types of a set: the lattice boolean, bigint < double < string, anything < array.

    A boolean and a number meet in string. A list takes scalars as lists of one, so it is the top.
    """
    has = lambda b: bits.bitwiseAND(F.lit(b)) != 0
    return (
        F.when(has(ARRAY), "array")
        .when(has(STRING) | (has(BOOLEAN) & has(NUMBER)), "string")
        .when(has(BOOLEAN), "boolean")
        .when(has(FRACTION), "double")
        .otherwise("bigint")
    )


def json_types(bits: Column) -> Column:
    """The bits without the difference between whole numbers and fractions, which JSON doesn't make."""
    return F.when(bits.bitwiseAND(F.lit(NUMBER)) != 0, bits.bitwiseOR(F.lit(NUMBER))).otherwise(bits)


def _refuse(name: str) -> None:
    raise ValueError(name)


def _plain(x: object) -> object:
    """Whole fractions as integers, at any depth."""
    if isinstance(x, float):
        return int(x) if x.is_integer() else x
    if isinstance(x, list):
        return [_plain(y) for y in x]
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return x


def _leaves(value: dict) -> Iterator[tuple[str, int, str]]:
    stack: list[tuple[str, object]] = [("", value)]
    while stack:
        at, x = stack.pop()
        if isinstance(x, dict):
            stack.extend((f"{at}.{k}" if at else k, v) for k, v in x.items())
        elif x is None:
            continue
        elif isinstance(x, bool):
            yield at, BOOLEAN, "true" if x else "false"
        elif isinstance(x, int):
            yield at, INTEGER, str(x)
        elif isinstance(x, float):
            yield at, FRACTION, str(int(x)) if x.is_integer() else repr(x)
        elif isinstance(x, str):
            yield at, STRING, x
        else:
            yield at, ARRAY, json.dumps(_plain(x), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _parsed(text: str | None) -> dict | None:
    try:
        x = json.loads(text, parse_constant=_refuse)  # type: ignore[arg-type]
    except (ValueError, TypeError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def _texts(values: list[str | None]) -> pa.Array:
    """Texts as Arrow has them; a lone surrogate, which JSON can name but UTF-8 can't hold, becomes a question mark."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def read_fields(df: DataFrame, group: str, file_no: str, line_no: str, record: str, run_path: str) -> DataFrame:
    """(grp, file_no, line_no, run, fields): one row for each line; no fields where the line is not valid.

    ``fields`` is an array of (path, type, value). JSON of unknown depth is beyond the built-in readers, which want a
    schema, so the lines pass through one Arrow-batched parse; everything after it is built in.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, offsets, paths, types, values = [], [0], [], [], []
            for text in batch.column("record").to_pylist():
                x, run = _parsed(text), None
                for p, t, v in _leaves(x) if x else ():
                    paths.append(p)
                    types.append(t)
                    values.append(v)
                    run = v if p == run_path else run
                runs.append(run)
                offsets.append(len(paths))
            fields = pa.StructArray.from_arrays([_texts(paths), pa.array(types, pa.int32()), _texts(values)], fields=list(_FIELD))
            packed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("file_no"), batch.column("line_no"), _texts(runs), packed], schema=_PACKED)

    lines = df.select(
        F.col(group).cast("string").alias("grp"),
        F.col(file_no).cast("int").alias("file_no"),
        F.col(line_no).cast("int").alias("line_no"),
        F.col(record).cast("string").alias("record"),
    ).filter("grp is not null and file_no is not null")
    return lines.mapInArrow(parse, "grp string, file_no int, line_no int, run string, fields array<struct<path:string,type:int,value:string>>")


def file_schemas(fields: DataFrame) -> DataFrame:
    """(grp, file_no, path, types): the header of each file, folded map-side; path null for each file there is."""
    here = F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(0).alias("type"))), F.transform("fields", lambda x: F.struct(x["path"].alias("path"), x["type"].alias("type")))))
    return fields.select("grp", "file_no", here.alias("f")).groupBy("grp", "file_no", F.col("f.path").alias("path")).agg(F.bit_or("f.type").alias("types"))


def _differences(heads: DataFrame) -> DataFrame:
    """(grp, file_no, path, types0, types): fields gone (types null), new (types0 null) or of another type.

    Each field of a group is followed through its files in order, so headers are not joined with themselves; a change
    counts where both files of its pair exist.
    """
    typed = heads.filter("path is not null").withColumn("types", json_types(F.col("types")))
    w = Window.partitionBy("grp", "path").orderBy("file_no")
    after = F.coalesce(F.lead("file_no").over(w) == F.col("file_no") + 1, F.lit(False))
    before = F.coalesce(F.lag("file_no").over(w) == F.col("file_no") - 1, F.lit(False))
    none = F.lit(None).cast("int")
    seen = typed.withColumns({"_after": after, "_before": before, "_types0": F.lag("types").over(w)})
    step = lambda no, old, new: F.struct(no.alias("file_no"), old.alias("types0"), new.alias("types"))
    steps = F.array_compact(
        F.array(
            F.when(~F.col("_after"), step(F.col("file_no") + 1, F.col("types"), none)),
            F.when(~F.col("_before"), step(F.col("file_no"), none, F.col("types"))),
            F.when(F.col("_before") & (F.col("types") != F.col("_types0")), step(F.col("file_no"), F.col("_types0"), F.col("types"))),
        )
    )
    files = heads.filter("path is null").select("grp", "file_no")
    sides = files.select("grp", "file_no", F.lit(1).alias("side")).unionByName(files.select("grp", (F.col("file_no") + 1).alias("file_no"), F.lit(2).alias("side")))
    pairs = sides.groupBy("grp", "file_no").agg(F.bit_or("side").alias("sides")).filter("sides = 3").select("grp", "file_no")
    return seen.select("grp", "path", F.explode(steps).alias("s")).select("grp", "path", "s.*").join(pairs, ["grp", "file_no"])


def _fingerprints(fields: DataFrame, changed: DataFrame) -> DataFrame:
    """(grp, file_no, path, n, h1, h2): what a gone or new field holds over the runs that both files have.

    A line carries only its fields that are gone in the next file or new in its own, as hashes. Rows are made distinct
    before they are summed, so copies of a line count once and no field of a file is gathered in one task.
    """
    names = lambda c: F.collect_set(F.when(c, F.col("path")))
    wanted = changed.filter("types is null or types0 is null")
    sides = wanted.select("grp", F.when(F.col("types").isNull(), F.col("file_no") - 1).otherwise(F.col("file_no")).alias("file_no"), "path", F.col("types").isNull().alias("gone"))
    by_file = cut(sides.groupBy("grp", "file_no").agg(names(F.col("gone")).alias("gone"), names(~F.col("gone")).alias("new")))
    lines = fields.filter("run is not null").join(by_file, ["grp", "file_no"], "left")
    kind = lambda x: F.when(x["type"] == FRACTION, INTEGER).otherwise(x["type"])
    hashed = lambda x: F.struct(x["path"].alias("path"), F.xxhash64(kind(x), x["value"]).alias("v"))
    marker = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(0).cast("bigint").alias("v")))
    held = lambda c: F.concat(marker, F.coalesce(F.transform(F.filter("fields", lambda x: F.array_contains(F.col(c), x["path"])), hashed), F.array()))
    old = lines.select("grp", (F.col("file_no") + 1).alias("file_no"), "run", F.lit(1).alias("side"), F.explode(held("gone")).alias("f"))
    new = lines.select("grp", "file_no", "run", F.lit(2).alias("side"), F.explode(held("new")).alias("f"))
    rows = old.unionByName(new).select("grp", "file_no", "run", "side", "f.*").distinct()
    both = Window.partitionBy("grp", "file_no", "run")
    shared = rows.withColumn("_sides", F.bit_or("side").over(both)).filter("_sides = 3 and path is not null")
    print_ = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "run", "v"))
    return shared.groupBy(*_AT, "side").agg(F.count(F.lit(1)).alias("n"), print_("a").alias("h1"), print_("b").alias("h2"))


def field_changes(fields: DataFrame) -> DataFrame:
    """(grp, file_no, change_kind, field_path, new_path): each change against the file before.

    A field that is gone and one that is new are a rename if their types agree and, over the runs in both files,
    they hold the same values in the same runs, at least one. Every such pair is reported: where a gone field agrees
    with two new ones, it is renamed to each of them.
    """
    heads = cut(file_schemas(fields))
    changed = cut(_differences(heads))
    prints = _fingerprints(fields, changed)
    gone = prints.filter("side = 1").join(changed.filter("types is null").select(*_AT, F.col("types0").alias("kind")), _AT)
    new = prints.filter("side = 2").join(changed.filter("types0 is null").select(*_AT, F.col("types").alias("kind")), _AT)
    on = ["grp", "file_no", "kind", "n", "h1", "h2"]
    same = cut(gone.select(*on, F.col("path").alias("field_path")).join(new.select(*on, F.col("path").alias("new_path")), on).select("grp", "file_no", "field_path", "new_path"))
    part = same.select("grp", "file_no", F.explode(F.array("field_path", "new_path")).alias("path")).distinct()
    rest = changed.join(part, _AT, "left_anti").select(
        "grp",
        "file_no",
        F.when(F.col("types").isNull(), "removed").when(F.col("types0").isNull(), "added").otherwise("retyped").alias("change_kind"),
        F.col("path").alias("field_path"),
        F.lit("").alias("new_path"),
    )
    return same.select("grp", "file_no", F.lit("renamed").alias("change_kind"), "field_path", "new_path").unionByName(rest)


def latest_names(changes: DataFrame, heads: DataFrame) -> DataFrame:
    """(grp, file_no, path, latest): the fields whose name changes after a file, with the name that they end with.

    Of several renames of one field at a time, that to the same last name counts, else the first by name. Chains of
    renames are shortened by pointer doubling: as many rounds as the binary logarithm of the longest chain.
    """
    last = lambda c: F.element_at(F.split(F.col(c), r"\."), -1)
    order = [(last("field_path") != last("new_path")).cast("int")]
    first = lambda by, then: F.row_number().over(Window.partitionBy("grp", "file_no", by).orderBy(*order, then))
    renames = changes.filter("change_kind = 'renamed'").withColumn("k", first("field_path", "new_path")).filter("k = 1").withColumn("k", first("new_path", "field_path")).filter("k = 1")
    events = cut(renames.select("grp", F.col("file_no").alias("at"), F.col("field_path").alias("old"), F.col("new_path").alias("new")))
    none = F.lit(None).cast("struct<at:int,new:string>")
    row = lambda df, name, at, kind, event: df.select("grp", F.col(name).alias("name"), F.col(at).alias("at"), F.lit(kind).alias("kind"), event.alias("event"))
    rows = (
        row(events, "old", "at", 0, F.struct("at", "new"))
        .unionByName(row(events, "new", "at", 1, none))
        .unionByName(row(heads.filter("path is not null"), "path", "file_no", 2, none))
    )
    later = Window.partitionBy("grp", "name").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    found = cut(rows.withColumn("next", F.last("event", ignorenulls=True).over(later)).filter("kind > 0"))
    ends = found.filter("kind = 1").select("grp", "at", F.col("name").alias("new"), F.coalesce("next", F.struct("at", F.col("name").alias("new"))).alias("to"))
    while True:
        far = ends.select("grp", F.struct("at", "new").alias("to"), F.col("to").alias("end"))
        ends = cut(ends.join(far, ["grp", "to"]).select("grp", "at", "new", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
        if not ends.filter("moved").take(1):
            break
        ends = ends.drop("moved")
    named = found.filter("kind = 2 and next is not null").select("grp", F.col("at").alias("file_no"), F.col("name").alias("path"), F.col("next.at").alias("at"), F.col("next.new").alias("new"))
    return named.join(ends, ["grp", "at", "new"]).select("grp", "file_no", "path", F.col("to.new").alias("latest"))


def union_schema(heads: DataFrame, names: DataFrame) -> DataFrame:
    """(path, kind, n_files): the union schema, headers folded through the lattice.

    Where a field was retyped, the type in the last file of its group counts.
    """
    named = heads.filter("path is not null").join(names, _AT, "left").select("grp", "file_no", "types", F.coalesce("latest", "path").alias("path"))
    in_file = named.groupBy("grp", "path", "file_no").agg(F.bit_or("types").alias("types"))
    latest = in_file.groupBy("grp", "path").agg(F.max_by("types", "file_no").alias("types"), F.count(F.lit(1)).alias("n_files"))
    return latest.groupBy("path").agg(promote(F.bit_or("types")).alias("kind"), F.sum("n_files").alias("n_files"))


def union_rows(fields: DataFrame, names: DataFrame) -> DataFrame:
    """(grp, run, path, file_no, type, value): for each run and field of the latest layout, the value that the last file has.

    Where two fields of a line have one name in the end, the one that bears it there counts.
    """
    by_file = cut(names.groupBy("grp", "file_no").agg(F.map_from_arrays(F.collect_list("path"), F.collect_list("latest")).alias("names")))
    lines = fields.filter("run is not null").join(by_file, ["grp", "file_no"], "left").select("grp", "run", "file_no", "line_no", "names", F.explode("fields").alias("f"))
    path = F.coalesce(F.element_at("names", F.col("f.path")), F.col("f.path"))
    rows = lines.select("grp", "run", path.alias("path"), F.struct("file_no", "line_no", (path == F.col("f.path")).alias("own"), F.col("f.type").alias("type"), F.col("f.value").alias("value")).alias("x"))
    return rows.groupBy("grp", "run", "path").agg(F.max("x").alias("x")).select("grp", "run", "path", "x.file_no", "x.type", "x.value")


def column_names(paths: Sequence[str], taken: Sequence[str] = ("grp", "run", "file_no", "more_fields")) -> dict[str, str]:
    """A column for each path. Of paths that differ in case only, all but the first by name get _2, _3, … and are logged."""
    used, out = {t.lower() for t in taken}, {}
    for p in sorted(paths):
        name, n = p, 1
        while name.lower() in used:
            n += 1
            name = f"{p}_{n}"
        if name != p:
            log.warning("field %s is column %s: a column of that name is there", p, name)
        used.add(name.lower())
        out[p] = name
    return out


def _cast(text: Column, kind: str) -> Column:
    return F.from_json(text, "array<string>") if kind == "array" else text if kind == "string" else text.try_cast(kind)


def _spread(known: Sequence[tuple[str, str]]):  # noqa: ANN202
    """Takes a run's fields apart into a column of texts for each known path; a list's text is JSON.

    Whole batches at once: a column picks its values by their places among all fields of a batch.
    """
    paths = pa.array([p for p, _ in known], pa.string())
    kinds = [k for _, k in known]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("fields")
            offsets = held.offsets.to_numpy()
            flat = held.flatten()
            row = np.repeat(np.arange(len(batch)), np.diff(offsets))
            column = pc.fill_null(pc.index_in(flat.field("path"), paths), -1).to_numpy(zero_copy_only=False)
            type_, value = flat.field("type").to_numpy(zero_copy_only=False), flat.field("value")
            order = np.argsort(column, kind="stable")
            cuts = np.searchsorted(column[order], np.arange(len(kinds) + 1))
            out = [batch.column("grp"), batch.column("run"), batch.column("file_no")]
            for i, kind in enumerate(kinds):
                at = order[cuts[i] : cuts[i + 1]]
                place = np.full(len(batch), -1, np.int64)
                place[row[at]] = at
                texts = value.take(pa.array(np.maximum(place, 0), mask=place < 0))
                if kind == "array" and (type_[at] != ARRAY).any():
                    texts = pa.array([t if t is None or type_[j] == ARRAY else json.dumps([t], ensure_ascii=False) for t, j in zip(texts.to_pylist(), place.tolist(), strict=True)], pa.string())
                out.append(texts)
            yield pa.RecordBatch.from_arrays(out, names=["grp", "run", "file_no", *[f"v{i}" for i in range(len(kinds))]])

    return spread


def union_table(rows: DataFrame, schema: DataFrame, leave_out: Sequence[str] = (), most_columns: int = 2_000) -> DataFrame:
    """One row for each (grp, run): grp, run, file_no (the last file with this run), then a column for each path, cast.

    A table can have only so many columns: the ``most_columns`` fields of most files get one; if there are more,
    the others stand with their values in the map ``more_fields``.
    """
    wide = schema.filter(~F.col("path").isin(list(leave_out))) if leave_out else schema
    known = sorted((r["path"], r["kind"]) for r in wide.orderBy(F.desc("n_files"), "path").limit(most_columns + 1).collect())
    more = len(known) > most_columns
    if more:
        known = sorted((r["path"], r["kind"]) for r in wide.orderBy(F.desc("n_files"), "path").limit(most_columns).collect())
    named = column_names([p for p, _ in known])
    entries = F.collect_list(F.struct("path", "type", "value"))  # a field of the schema once each
    runs = rows.groupBy("grp", "run").agg(F.max("file_no").alias("file_no"), entries.alias("fields"))
    wide_rows = runs.mapInArrow(_spread(known), ", ".join(["grp string, run string, file_no int", *[f"v{i} string" for i in range(len(known))]]))
    out = wide_rows.select("grp", "run", "file_no", *[_cast(F.col(f"v{i}"), kind).alias(named[p]) for i, (p, kind) in enumerate(known)])
    if not more:
        return out
    rest = rows.filter(~F.col("path").isin([*named, *leave_out])).groupBy("grp", "run").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("more_fields"))
    return out.join(rest, ["grp", "run"], "left")
