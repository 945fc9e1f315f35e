"""Deeply nested records into flat, linked tables by adjacency-table shredding.

``adjacency`` turns every record into node rows (node, parent, label, ordinal, kind, scalar).
``entity`` joins the object nodes of one label with their scalar children and pivots those into columns.

Defined results:

* A null or missing field makes no node. A null element of an array keeps its ordinal as a node of kind
  ``null``; an empty array is a node without children; a null array is no node.
* Rows equal in every column are one record: they share the record hash and all node ids. Rows that have
  the key in common but differ elsewhere remain separate records.
* Null key values are kept; nodes join on them null-safely.
* Columns of the input may bear any name, also those of the node table: key values travel in one struct.
* An empty table gives empty tables of the same columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmill.runtime import cut, quoted

_SEP = "/"
_NODES = "array<struct<node:string,parent:string,label:string,ordinal:int,kind:string,scalar:string>>"


def _node(node: Column, parent: Column, label: str, ordinal: Column, kind: Column, scalar: Column) -> Column:
    return F.struct(
        node.alias("node"),
        parent.alias("parent"),
        F.lit(label).alias("label"),
        ordinal.cast("int").alias("ordinal"),
        kind.alias("kind"),
        scalar.alias("scalar"),
    )


def _wanted(label: str, fields: Sequence[str] | None) -> bool:
    """Whether a label lies on, above or below one of the wanted labels."""
    if fields is None:
        return True
    return any(f == label or f.startswith((label + ".", label + "[")) or label.startswith((f + ".", f + "[")) for f in fields)


def _walk(
    kind: T.DataType, value: Column, node: Column, parent: Column, label: str, ordinal: Column, in_list: bool, fields: Sequence[str] | None
) -> Column:
    """An array of node structs for one value and all that is below it."""
    no = F.lit(None).cast("string")
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return _walk(T.ArrayType(entry), F.map_entries(value), node, parent, label, ordinal, in_list, fields)
    if isinstance(kind, T.StructType):
        own = F.array(_node(node, parent, label, ordinal, F.lit("object"), no))
        parts = [own]
        for f in kind.fields:
            below = f"{label}.{f.name}"
            if _wanted(below, fields):
                parts.append(
                    _walk(f.dataType, value.getField(f.name), F.concat(node, F.lit(_SEP + f.name)), node, below, F.lit(None), False, fields)
                )
        full = F.concat(*parts)
    elif isinstance(kind, T.ArrayType):
        below = f"{label}[]"
        items = F.transform(
            value,
            lambda x, i: _walk(
                kind.elementType, x, F.concat(node, F.lit(_SEP), (i + 1).cast("string")), node, below, i + 1, True, fields
            ),
        )
        full = F.concat(F.array(_node(node, parent, label, ordinal, F.lit("array"), no)), F.flatten(items))
    else:
        text = F.base64(value) if isinstance(kind, T.BinaryType) else value.cast("string")
        full = F.array(_node(node, parent, label, ordinal, F.lit("scalar"), text))
    absent = F.array(_node(node, parent, label, ordinal, F.lit("null"), no)) if in_list else F.array().cast(_NODES)
    return F.when(value.isNull(), absent).otherwise(full)


def adjacency(df: DataFrame, key: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """The node table of nested records.

    Columns: ``key`` (a struct of the key columns), ``record`` (hash of the whole row, so that exact copies
    are one record), ``node``, ``parent`` (paths with ordinals), ``label`` (the path without ordinals, list
    elements marked ``[]``), ``ordinal`` (place in the parent's list, from 1), ``kind`` (object, array, scalar,
    null) and ``scalar`` (as text). ``fields`` restricts the walk to some labels; the others are not read into
    nodes. One pass without a shuffle.
    """
    schema = df.schema
    row = F.to_json(F.struct(*[quoted(f.name).alias(f"c{i}") for i, f in enumerate(schema.fields)]), {"ignoreNullFields": "false"})
    root = F.lit("")
    parts = [F.array(_node(root, F.lit(None).cast("string"), "", F.lit(None), F.lit("object"), F.lit(None).cast("string")))]
    for f in schema.fields:
        if f.name not in key and _wanted(f.name, fields):
            parts.append(_walk(f.dataType, quoted(f.name), F.lit(f.name), root, f.name, F.lit(None), False, fields))
    # Hashed below the explode: one select would put the hash above it, to be computed for every node.
    records = df.select(F.struct(*[quoted(k).alias(k) for k in key]).alias("key"), F.xxhash64(row).alias("record"), F.concat(*parts).alias("nodes"))
    return records.select("key", "record", F.explode("nodes").alias("n")).select("key", "record", "n.*")


def _type_at(schema: T.StructType, label: str) -> T.DataType:
    at: T.DataType = schema
    for part in filter(None, label.split(".")):
        name, lists = part.replace("[]", ""), part.count("[]")
        at = at[name].dataType  # type: ignore[index]
        for _ in range(lists):
            if isinstance(at, T.MapType):
                at = T.StructType([T.StructField("key", at.keyType), T.StructField("value", at.valueType)])
            else:
                at = at.elementType  # type: ignore[attr-defined]
    return at


def _is_scalar(kind: T.DataType) -> bool:
    return not isinstance(kind, T.StructType | T.ArrayType | T.MapType)


def entity(nodes: DataFrame, schema: T.StructType, key: Sequence[str], label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The flat table of one label.

    ``label`` is ``''`` for the records themselves, ``'chunks[]'`` for the elements of a list. Columns: the key,
    ``record_id``, ``node_id``, ``parent_id`` (the node that holds it, '' for the record), ``pos`` (place in the
    list, from 1, null outside lists), then the scalar children with their own types; for a list of scalars
    ``value``. Scalar children named like one of these, or like a key column, get the label as prefix.

    Object nodes are joined with their scalar children, which are pivoted before: both sides shuffle on the
    same (key, record, node), and exact copies of a record fold there.
    """
    kind = _type_at(schema, label)
    at = ["key", "record", "node"]
    taken = {*key, "record_id", "node_id", "parent_id", "pos"}
    named = lambda name: f"{label.replace('[]', '').replace('.', '_') or 'record'}_{name}" if name in taken else name
    if isinstance(kind, T.StructType):
        objects = nodes.filter((F.col("label") == label) & (F.col("kind") == "object")).groupBy(*at).agg(
            F.first("parent").alias("parent"), F.first("ordinal").alias("ordinal")
        )
        names = [f for f in kind.fields if _is_scalar(f.dataType) and (columns is None or f.name in columns) and not (label == "" and f.name in key)]
        prefix = f"{label}." if label else ""
        children = nodes.filter(F.col("label").isin([prefix + f.name for f in names]) & (F.col("kind") == "scalar"))
        pivot = children.groupBy("key", "record", F.col("parent").alias("node")).agg(
            F.lit(1).alias("has"), *[F.max(F.when(F.col("label") == prefix + f.name, F.col("scalar"))).alias(f"s{i}") for i, f in enumerate(names)]
        )
        joined = objects.join(pivot, [objects[c].eqNullSafe(pivot[c]) for c in at], "left").select(
            *[objects[c] for c in (*at, "parent", "ordinal")], *[pivot[f"s{i}"] for i in range(len(names))]
        )
        values = [_typed(F.col(f"s{i}"), f.dataType).alias(named(f.name)) for i, f in enumerate(names)]
    else:
        joined = nodes.filter((F.col("label") == label) & F.col("kind").isin("scalar", "null")).groupBy(*at).agg(
            F.first("parent").alias("parent"), F.first("ordinal").alias("ordinal"), F.max("scalar").alias("scalar")
        )
        values = [_typed(F.col("scalar"), kind).alias(named("value"))]
    return joined.select(
        *[F.col("key").getField(k).alias(k) for k in key],
        F.col("record").alias("record_id"),
        F.col("node").alias("node_id"),
        F.col("parent").alias("parent_id"),
        F.col("ordinal").alias("pos"),
        *values,
    )


def _typed(text: Column, kind: T.DataType) -> Column:
    return F.unbase64(text) if isinstance(kind, T.BinaryType) else text.cast(kind)


def shred(df: DataFrame, key: Sequence[str], labels: Sequence[str]) -> dict[str, DataFrame]:
    """The flat tables of several labels, by label. The records are walked once, for the labels that any of them needs."""
    fields = []
    for label in labels:
        kind = _type_at(df.schema, label)
        prefix = f"{label}." if label else ""
        scalars = [prefix + f.name for f in kind.fields if _is_scalar(f.dataType)] if isinstance(kind, T.StructType) else []
        fields += scalars or [label]
    nodes = cut(adjacency(df, key, fields))
    return {label: entity(nodes, df.schema, key, label) for label in labels}
