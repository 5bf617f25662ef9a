"""Every query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidewatch.plans.registry import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(values):
    return sorted((tuple(map(plain, r)) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


def close(a, b):
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= 2e-5 * max(1.0, abs(a)))


@pytest.mark.parametrize("key", [k for k, q in QUERIES.items() if q.sql])
def test_query(spark, tiny, duck, key):
    df = QUERIES[key].run(spark, tiny)
    cols = sorted(df.columns)
    result = duck.execute(QUERIES[key].sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = rows([[r[names.index(c)] for c in cols] for r in result.fetchall()])
    got = rows([[r[c] for c in cols] for r in df.collect()])
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("key", [k for k, q in QUERIES.items() if not q.sql])
def test_rows_only(spark, tiny, key):
    assert QUERIES[key].run(spark, tiny).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bootstrap_holds_the_mean(spark, tiny):
    for r in QUERIES["bootstrap_ci"].run(spark, tiny).collect():
        assert r["low"] <= r["high"] and (r["n"] < 10 or r["low"] - 1e-6 <= r["mean"] <= r["high"] + 1e-6)


def test_folds_predict(spark, tiny):
    assert all(abs(r["r"]) <= 1 for r in QUERIES["ridge_oof"].run(spark, tiny).collect())
