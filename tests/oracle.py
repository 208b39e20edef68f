"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def spark_rows(df):
    t = df.toArrow()
    return rows_of(df.columns, list(zip(*[t[c].to_pylist() for c in df.columns])) if t.num_rows else [])


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return rows_of(names, cur.fetchall())


def difference(spark, con, sf_dir, fn, sql) -> str | None:
    """None when equal, else a short account of the first difference."""
    cols_a, a = spark_rows(fn(spark, sf_dir))
    cols_b, b = duck_rows(con, sql)
    if cols_a != cols_b:
        return f"columns {cols_a} != {cols_b}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{str(x)[:300]} != {str(y)[:300]}"
    return None


def default_sf() -> str:
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
