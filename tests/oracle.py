"""Comparison of a query with its SQL, as sets of rows."""

from __future__ import annotations

import math
from typing import Any

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value: Any) -> Any:
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark: Any, query: Any, sql: str, d: str) -> list[str]:
    df = query(spark, d)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    con.execute("set timezone='UTC'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    expected, got = rows_of(names, want.fetchall()), rows_of(df.columns, df.collect())
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if len(expected) != len(got):
        out.append(f"{len(got)} rows, not {len(expected)}")
    out += [f"{g} != {e}" for g, e in zip(got, expected, strict=False) if g != e][:3]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(names, [str(t) for t in con.sql(sql).types], strict=True))
    out += [f"{c}: {k} != {types[c]}" for c, k in df.dtypes if c in types and kinds.get(k, types[c]) != types[c]]
    return out
