"""Every query against DuckDB on the same tables."""

import math
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    kind = type(x).__name__
    if "bool" in kind:
        return bool(x)
    if "Timestamp" in kind or kind == "date":
        return str(x)[:10]
    return float(x) if "float" in kind else int(x) if "int" in kind else x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=lambda r: tuple(str(round(x, 3) if isinstance(x, float) else x) for x in r))


def close(a, b):
    return a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= 2e-5 * max(1, abs(a))


@pytest.mark.parametrize("name", NAMES)
def test_agrees(spark, con, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert list(got.columns)
    sql = entry.oracle_sql().get(name)
    if sql:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        assert all(close(x, y) for p, q in zip(a, b) for x, y in zip(p, q))
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() == len([1 for r in entry.entry(spark).collect() if r["n"] >= 30])
