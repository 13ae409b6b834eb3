"""Run one registered query and its SQL on the same tables and compare the results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.9g}"
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, sf_dir: str, fn, sql: str) -> list[str]:
    got = fn(spark, sf_dir)
    got_rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    want_rows = rows_of(names, want.fetchall())
    out = []
    if sorted(names) != sorted(got.columns):
        out.append(f"columns {sorted(got.columns)} != {sorted(names)}")
    if len(got_rows) != len(want_rows):
        out.append(f"rows {len(got_rows)} != {len(want_rows)}")
    bad = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
    if bad and not out or bad:
        out.append(f"{len(bad)} rows differ, first: {str(bad[0][0])[:600]} != {str(bad[0][1])[:600]}")
    return out
