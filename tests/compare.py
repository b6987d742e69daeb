"""Compare a registered query with its SQL on DuckDB, value by value."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (f"{v:.9g}" if v != int(v) else str(int(v))) if math.isfinite(v) else str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, norm(x)) for k, x in v.asDict().items())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted([tuple(norm(r[n]) for n in names) for r in df.collect()], key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted([tuple(norm(r[i]) for i in at) for r in cur.fetchall()], key=repr)


def difference(spark, sf_dir, name, query, sql, con=None):
    """None if equal, else a short text."""
    con = con or connect(sf_dir)
    a_names, a = spark_rows(query(spark, sf_dir))
    b_names, b = duck_rows(con, sql)
    if a_names != b_names:
        return f"{name}: columns {a_names} / {b_names}"
    if len(a) != len(b):
        sample = [list(set(map(repr, p)) - set(map(repr, q)))[:2] for p, q in ((a, b), (b, a))]
        return f"{name}: rows {len(a)} / {len(b)}: {sample}"
    for p, q in zip(a, b):
        if p != q:
            return f"{name}: {a_names}\n  spark {p}\n  duck  {q}"
    return None
