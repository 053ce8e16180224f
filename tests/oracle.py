"""Side-by-side comparison of a query with its SQL on the same tables."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _kind(type_name: str) -> str:
    name = type_name.lower()
    if name.startswith("decimal"):
        return "decimal"
    return {
        "long": "bigint", "integer": "int", "short": "smallint", "str": "string", "varchar": "string",
        "boolean": "bool", "timestamp_ntz": "timestamp", "float64": "double",
    }.get(name, name)


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 12) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs: column names, types, row count, values. Empty when the results agree."""
    relation = con.sql(sql)
    out = []
    ours = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    theirs = {n: _kind(str(t)) for n, t in zip(relation.columns, relation.types)}
    theirs = {n: {"integer": "int"}.get(t, t) for n, t in theirs.items()}
    if set(ours) != set(theirs):
        return [f"columns {sorted(ours)} against {sorted(theirs)}"]
    out += [f"type of {n}: {ours[n]} against {theirs[n]}" for n in ours if ours[n] != theirs[n]]
    a = _rows(df.columns, df.collect())
    b = _rows(relation.columns, relation.fetchall())
    if len(a) != len(b):
        out.append(f"{len(a)} rows against {len(b)}")
    unequal = [(x, y) for x, y in zip(a, b) if x != y]
    if unequal:
        out.append(f"{len(unequal)} unequal rows, first: {unequal[0]}")
    return out
