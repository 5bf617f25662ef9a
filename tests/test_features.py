"""Joins of training tables that fail, and feature vectors by layout, on literal cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scores as S
from tidewatch.functions.specs import FeatureSpec, resolve_backend
from tidewatch.operators import features as X


def test_strict_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, x string")
    right = [(1, 10.0), (2, 20.0), (3, 1.0), (3, 2.0)]
    make = lambda r: spark.createDataFrame(r, "k int, y double")
    assert sorted(map(tuple, X.strict_join(left, make(right), ["k"], "rating").collect())) == [(1, "a", 10.0), (2, "b", 20.0), (2, "c", 20.0)]
    with pytest.raises(Exception, match="no rating for 2"):
        X.strict_join(left, make(right[:1]), ["k"], "rating").collect()
    with pytest.raises(Exception, match="several rating for 1"):
        X.strict_join(left, make([*right, (1, 11.0)]), ["k"], "rating").collect()
    with pytest.raises(Exception, match="no rating for null"):
        X.strict_join(spark.createDataFrame([(None, "a")], "k int, x string"), make([(None, 1.0)]), ["k"], "rating").collect()
    assert X.strict_join(left.limit(0), make(right), ["k"], "rating").count() == 0


def test_first_match(spark):
    left = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 1, "c"), (4, 0, "d")], "k int, o int, v string")
    assert sorted((r["k"], r["v"]) for r in X.first_match_join(left, right, ["k"], ["o"]).collect()) == [(1, "a"), (2, "c"), (2, "c")]


def test_feature_matrix(spark):
    """Two regions of two vertices, three frames, a window of three."""
    values = {0: [1.0, 3.0, -2.0, 0.0], 1: [5.0, 7.0, 4.0, 4.0], 2: [0.0, 0.0, 1.0, -1.0]}
    df = spark.createDataFrame([("s", t, i // 2, v) for t, row in values.items() for i, v in enumerate(row)], "s string, t int, region int, v double")
    spec = FeatureSpec("x", ("mean", "std", "max_abs"), "real", 2, 3)
    extra = spark.createDataFrame([("s", 1, [8.0, 9.0])], "s string, t int, sub array<double>")
    got = {r["t"]: r["features"] for r in X.feature_matrix(df, ["s"], "t", "region", "v", spec, extra).collect()}
    around = {0: [0, 1], 1: [0, 1, 2], 2: [1, 2]}
    for t, frames in around.items():
        want = []
        for region in (0, 1):
            xs = [values[f][i] for f in frames for i in (2 * region, 2 * region + 1)]
            mean = sum(xs) / len(xs)
            want += [mean, math.sqrt(sum((x - mean) ** 2 for x in xs) / len(xs)), max(map(abs, xs))]
        assert got[t] == pytest.approx([*want, *([8.0, 9.0] if t == 1 else [0.0, 0.0])])
    alone = X.feature_matrix(df, ["s"], "t", "region", "v", FeatureSpec("y", ("sum",)))
    assert {r["t"]: r["features"] for r in alone.collect()} == {0: [4.0, -2.0], 1: [12.0, 8.0], 2: [0.0, 0.0]}
    assert {tuple(r["features"]) for r in X.feature_matrix(df, ["s"], "t", "region", "v", FeatureSpec("z", (), "real", 2), extra).collect()} == {(8.0, 9.0), (0.0, 0.0)}
    with pytest.raises(ValueError, match="median"):
        X.feature_matrix(df, ["s"], "t", "region", "v", FeatureSpec("m", ("median",)))
    with pytest.raises(Exception, match="2 values"):
        X.feature_matrix(df, ["s"], "t", "region", "v", spec, extra.withColumn("sub", F.array(F.lit(1.0)))).collect()


def test_visibility_and_backends(spark):
    df = spark.createDataFrame([(None,), (0.4,), (3.0,), (-1.0,)], "r double")
    assert [r["v"] for r in df.select(S.visibility(F.col("r")).alias("v")).collect()] == [1.0, 0.4, 1.0, 0.0]
    assert resolve_backend(environ={}) == "deepgaze_msdb" and resolve_backend(" Modal ", {}) == "modal"
    assert resolve_backend(None, {"PIPELINE_HEATMAP_BACKEND": "uniform"}) == "uniform"
    with pytest.raises(ValueError, match="unknown backend"):
        resolve_backend("other", {})
