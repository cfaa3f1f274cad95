"""Side-by-side comparison of a query with its DuckDB twin."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    """Values as both engines give them, floats to nine digits."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if names, types and rows agree, else what differs."""
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    kinds = dict(zip([d[0] for d in result.description], [str(d[1]) for d in result.description], strict=True))
    want_names, want = rows([d[0] for d in result.description], result.fetchall())
    if names != want_names:
        return f"columns {names} and {want_names}"
    if got != want:
        here, there = set(got), set(want)
        extra, missing = [r for r in got if r not in there][:3], [r for r in want if r not in here][:3]
        return f"{len(got)} and {len(want)} rows; only here: {extra}; only there: {missing}"
    spark_kinds = {"bigint": {"BIGINT", "NUMBER"}, "int": {"INTEGER", "NUMBER"}, "double": {"DOUBLE", "NUMBER"}, "string": {"VARCHAR", "STRING"}, "boolean": {"BOOLEAN", "bool"}}
    odd = {n: (k, kinds[n]) for n, k in df.dtypes if k in spark_kinds and kinds[n] not in spark_kinds[k] and kinds[n].isupper()}
    return f"types {odd}" if odd else None
