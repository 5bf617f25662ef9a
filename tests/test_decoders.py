"""Models as tables, and what runs when something is missing."""

from __future__ import annotations

import math

import pytest

from tidewatch.operators import decoders as D


@pytest.fixture(scope="module")
def model(spark):
    """z = (x - mean) / scale with a scale of 0; two components; classes happy (place 1) and calm (place 0)."""
    features = spark.createDataFrame([(0, 1.0, 2.0), (1, 0.0, 0.0), (2, 5.0, 10.0)], "pos int, mean double, scale double")
    projection = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0), (1, 2, 2.0)], "component int, pos int, loading double")
    weights = spark.createDataFrame([("happy", 0, 0.5), ("happy", 1, 1.0), ("calm", 1, -1.0)], "class string, pos int, weight double")
    classes = spark.createDataFrame([("happy", 1, 0.25), ("calm", 0, 0.5), ("flat", 2, 0.125)], "class string, place int, intercept double")
    return D.LinearModel(features, weights, classes, projection)


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(0, [3.0, 1.0, 10.0]), (1, [1.0, 0.0, 5.0]), (2, [1.0, math.nan, 5.0]), (3, [1.0, None, 5.0]), (4, None), (5, [1.0, 2.0]), (6, [math.inf, 0.0, 0.0])], "t int, v array<double>")


def test_steps_multiply(frames, model):
    got = {r["t"]: r for r in D.apply_linear(frames, "v", model).collect()}
    # z = (1, 1, 0.5): components 0 and 1; calm 0.5 - 1, happy 0.25 + 0.5 * 0 + 1 * 1
    assert got[0]["names"] == ["calm", "happy", "flat"]
    assert [round(s, 12) for s in got[0]["scores"]] == [-0.5, 1.25, 0.125] and got[0]["probabilities"] == [0.0, 1.0, 0.125]
    assert [round(s, 12) for s in got[1]["scores"]] == [0.5, 0.25, 0.125]
    assert all(got[t]["scores"] is None and got[t]["probabilities"] is None for t in (2, 3, 4, 5, 6))
    logistic = D.LinearModel(model.features, model.weights, model.classes, model.projection, "sigmoid")
    assert abs(D.apply_linear(frames, "v", logistic).where("t = 0").first()["probabilities"][1] - 1 / (1 + math.exp(-1.25))) < 1e-12


def test_models_are_stored_and_read(spark, frames, model, tmp_path):
    folder = str(tmp_path / "model")
    assert D.read_model(spark, folder) is None
    for name in ("features", "weights", "classes"):
        getattr(model, name).write.parquet(f"{folder}/{name}")
    plain = D.read_model(spark, folder)
    assert plain.projection is None
    assert [round(s, 9) for s in D.apply_linear(frames, "v", plain).where("t = 0").first()["scores"]] == [-0.5, 1.75, 0.125]
    model.projection.write.parquet(f"{folder}/projection")
    assert D.read_model(spark, folder).projection is not None


def test_modes(spark, frames, model):
    templates = spark.createDataFrame([("b", [0.0, 0.0, 2.0]), ("a", [1.0, 0.0, 0.0]), ("none", [0.0, 0.0, 0.0])], "class string, vec array<double>")
    run = lambda *a, **k: D.track_by_mode(frames, "v", *a, **k).where("t = 0").first()
    assert [run("decoder", model, templates)[c] for c in ("mode", "reason")] == ["decoder", "asked"]
    assert [run(" DECODER ", model, templates, ["sub"])[c] for c in ("asked", "mode", "reason")] == ["decoder", "template", "missing sub"]
    assert [run("decoder", None, templates)[c] for c in ("mode", "reason")] == ["template", "no model"]
    assert run("other", model, templates)["reason"] == "unknown mode other" and run("", model, templates)["mode"] == "template"
    assert D.track_by_mode(frames, "v", "template", model) is None and D.track_by_mode(frames, "v", "decoder", model) is not None
    row = run("template", None, templates)
    assert row["names"] == ["a", "b", "none"] and abs(row["scores"][1] - 10 / math.sqrt(110)) < 1e-6 and row["scores"][2] == 0
    assert D.track_by_mode(frames, "v", "template", None, templates).where("t = 2").first()["scores"] is None
