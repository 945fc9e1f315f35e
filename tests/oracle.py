"""Runs a query and its SQL on the same tables and compares rows, order aside."""

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


def connect(folder=DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(spark, query, sql, folder=DATA):
    df = query(spark, str(folder))
    names = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    rel = connect(folder).sql(sql)
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == names
    want = Counter(repr(tuple(plain(r[at[c]]) for c in names)) for r in rel.fetchall())
    assert got == want, (list((got - want).elements())[:3], list((want - got).elements())[:3])
