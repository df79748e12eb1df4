"""Compares a query's rows with those of its DuckDB SQL, as the row count, the columns and an order-free set of values."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    return str(v)


def differences(spark, name, query, sql, sf_dir):
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        got = db.execute(sql)
        names = [d[0] for d in got.description]
        expected = Counter(tuple(cell(v) for _, v in sorted(zip(names, row))) for row in got.fetchall())
    df = query(spark, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    columns = sorted(df.columns)
    found = Counter(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if found != expected:
        return f"{name}: {sum(found.values())} and {sum(expected.values())} rows; only here {list((found - expected).items())[:3]}, only there {list((expected - found).items())[:3]}"
    return ""
