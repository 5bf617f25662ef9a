"""Ranks, positions and quantiles over ranges against the same on whole groups."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewatch.operators import ranges as R


@pytest.fixture(scope="module")
def rows(spark):
    """A group with a third of all rows, a value with a third of its group, nulls in key and value, a group of one."""
    rng = random.Random(4)
    data = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 7}", i, rng.choice([None, 5.0, 5.0, rng.gauss(0, 9), float(rng.randrange(4))]), f"w{rng.randrange(300)}") for i in range(4000)]
    return spark.createDataFrame([*data, ("one", -1, 2.5, "z"), ("none", -2, None, "z")], "k string, i int, v double, s string").repartition(5).cache()


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_value_ranks(rows, parts):
    got = {(r["k"], r["v"]): (r["n"], r["below"]) for r in R.value_ranks(rows, ["k"], "v", parts).collect()}
    d = rows.toPandas()
    for k, own in d.groupby("k", dropna=False):
        k = None if pd.isna(k) else k
        values = sorted(own["v"], key=lambda v: (not pd.isna(v), v))
        for v in set(None if pd.isna(v) else v for v in values):
            same = [i for i, x in enumerate(values) if (pd.isna(x) and v is None) or x == v]
            assert got[k, v] == (len(same), same[0])


def test_average_rank_equals_the_window(rows):
    w = W.partitionBy("k")
    plain = rows.withColumn("want", F.rank().over(w.orderBy("v")) + (F.count(F.lit(1)).over(W.partitionBy("k", "v")) - 1) / 2.0)
    both = R.with_average_rank(plain, ["k"], "v", "got")
    assert both.where("got = want").count() == rows.count()


@pytest.mark.parametrize("order", [["v", "i"], [("v", True), "i"], ["s", "i"], [("i", True)]])
def test_positions(rows, order):
    by = [(c, False) if isinstance(c, str) else c for c in order]
    sort = [F.desc_nulls_first(c) if d else F.asc_nulls_first(c) for c, d in by]
    plain = rows.withColumn("want", F.row_number().over(W.partitionBy("k").orderBy(*sort)) - 1)
    assert R.with_position(plain, ["k"], order, "got", 16).where("got = want").count() == rows.count()
    whole = rows.withColumn("want", F.row_number().over(W.orderBy(*sort)) - 1)
    assert R.with_position(whole, [], order, "got", 16).where("got = want").count() == rows.count()


def test_dense_ranks(rows, spark):
    got = [tuple(r) for r in R.dense_ranks(rows, "s", "id", 3).orderBy("id").collect()]
    names = sorted({r["s"] for r in rows.collect()})
    assert got == [(s, i + 3) for i, s in enumerate(names)]
    pairs = spark.createDataFrame([(("b", 1),), (("a", 2),), (("a", 1),), (("a", 2),), (None,)], "key struct<x:string,y:int>")
    assert [tuple(r["key"]) for r in R.dense_ranks(pairs, "key", "id").orderBy("id").collect()] == [("a", 1), ("a", 2), ("b", 1)]


@pytest.mark.parametrize("parts", [1, 9, 64])
def test_exact_quantiles(rows, parts):
    at = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {r["k"]: r["quantiles"] for r in R.exact_quantiles(rows, ["k"], "v", at, parts=parts).collect()}
    d = rows.toPandas()
    assert "none" not in got
    for k, own in d.groupby("k", dropna=False):
        values = own["v"].dropna()
        if len(values):
            assert np.allclose(got[None if pd.isna(k) else k], np.quantile(values, at), atol=1e-12)
    whole = R.exact_quantiles(rows, [], "v", at).collect()
    assert np.allclose(whole[0]["quantiles"], np.quantile(d["v"].dropna(), at))
    assert R.exact_quantiles(rows.limit(0), ["k"], "v", at).count() == 0
    assert R.with_position(rows.limit(0), [], ["v"], "p").count() == 0


def test_no_window_holds_a_hot_group(rows):
    """Ranges of the hot group, as counted, are small; those with more rows hold one value."""
    cut = R.with_range(rows, "i").groupBy("k", "__b").count().where("k = 'hot'").collect()
    assert len(cut) > 60 and max(r["count"] for r in cut) < 100
    same = R.with_range(rows.where("v IS NOT NULL"), "v").groupBy("__b").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("d")).where("n > 300").collect()
    assert same and all(r["d"] == 1 for r in same)
