"""Comparison of a Spark result with its SQL twin in DuckDB: columns, row counts and values."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.6g}"
    return str(value)


def difference(df, con, sql):
    """None, or what differs."""
    got, result = df.collect(), con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    a = sorted(tuple(canon(r[c]) for c in order) for r in got)
    b = sorted(tuple(canon(r[names.index(c)]) for c in order) for r in result.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y), None)
