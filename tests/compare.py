"""Order-insensitive comparison of a Spark result with its DuckDB oracle."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def canon(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else float(f"{v:.12g}")
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    cur = con.execute(sql)
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns differ: spark only {set(got_cols) - set(want_cols)}, oracle only {set(want_cols) - set(got_cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows, oracle {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            bad = [(c, a, b) for c, a, b in zip(got_cols, g, w) if a != b]
            return f"values differ: {bad[:5]}"
    return None
