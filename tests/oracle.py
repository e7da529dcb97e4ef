"""Compare a query with its SQL: row count, column names, kinds of types, and values."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int",
    "hugeint": "huge", "double": "double", "float": "float", "string": "text", "varchar": "text",
    "timestamp_ntz": "timestamp", "timestamp": "timestamp", "date": "date", "boolean": "bool",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _kind(name: str) -> str:
    return KINDS.get(name.lower().split("(")[0], name.lower())


def _key(row) -> tuple:
    return tuple((v is None, "" if v is None else str(v) if not isinstance(v, float)
                  else f"{v:.9g}") for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def compare(df, con, sql: str) -> list[str]:
    """What differs, as messages; empty when all is equal."""
    problems = []
    relation = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return [f"columns {names} vs {sorted(relation.columns)}"]
    types = dict(zip(relation.columns, map(str, relation.types)))
    for name in names:
        ours, theirs = _kind(df.schema[name].dataType.simpleString()), _kind(types[name])
        if ours != theirs:
            problems.append(f"type of {name}: {df.schema[name].dataType.simpleString()} vs "
                            f"{types[name]}")
    ours = [tuple(r[n] for n in names) for r in df.select(*(f"`{n}`" for n in names)).collect()]
    order = [relation.columns.index(n) for n in names]
    theirs = [tuple(r[i] for i in order) for r in relation.fetchall()]
    if len(ours) != len(theirs):
        return [*problems, f"rows {len(ours)} vs {len(theirs)}"]
    ours.sort(key=_key)
    theirs.sort(key=_key)
    bad = [(a, b) for a, b in zip(ours, theirs) if not all(map(_same, a, b))]
    if bad:
        problems.append(f"{len(bad)} of {len(ours)} rows differ, e.g. {bad[0]}")
    if not ours:
        problems.append("no rows")
    return problems
