"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "FLOAT": "float", "HUGEINT": "huge"}


def differences(spark, sf_dir: str, entry) -> str | None:
    """None when Spark and the SQL agree on columns, types and rows; else what differs."""
    got = entry.run(spark, sf_dir)
    rel = connect(sf_dir).sql(entry.sql)
    want_cols, want_types = rel.columns, {c: KINDS.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    got_types = {f.name: f.dataType.simpleString() for f in got.schema}
    if sorted(got.columns) != sorted(want_cols):
        return f"columns {sorted(got.columns)} vs {sorted(want_cols)}"
    a, b = rows_of(got.columns, got.collect()), rows_of(want_cols, rel.fetchall())
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {sorted(got.columns)}, e.g. {bad[0]}"
    off = {c: (got_types[c], want_types[c]) for c in got_types if got_types[c] != want_types[c]}
    return f"types {off}" if off else None
