"""Fitted linear models as tables, applied to frames; and the choice between a model and templates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S

#: Weights of a model, more of which are an error: they go to every task.
MOST_WEIGHTS = 1 << 24


@dataclass(frozen=True)
class LinearModel:
    """Steps of a fitted pipeline, as tables.

    features: pos (from 0), mean, scale. projection: component, pos, loading; none where classes weigh the features themselves.
    weights: class, pos (a component's number behind a projection), weight; what is not there is 0. classes: class, place,
    intercept. link: identity or sigmoid.
    """

    features: DataFrame
    weights: DataFrame
    classes: DataFrame
    projection: DataFrame | None = None
    link: str = "identity"

    def gathered(self) -> DataFrame:
        """One row: width, and m, an array of (class, intercept, w) in the order of places, for features as they are.

        The steps are multiplied as tables: a class' weight of a feature is the sum over components, over the feature's scale;
        means go into intercepts. A scale of 0 is 1.
        """
        weights = self.weights.select("class", "pos", "weight")
        if self.projection is not None:
            by = self.projection.select(F.col("component").alias("__c"), F.col("pos").alias("__p"), "loading")
            weights = weights.join(by, F.col("pos") == F.col("__c")).groupBy("class", F.col("__p").alias("pos")).agg(F.sum(F.col("weight") * F.col("loading")).alias("weight"))
        scale = F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))
        own = weights.join(self.features, "pos").select("class", "pos", (F.col("weight") / scale).alias("w"), (F.col("weight") / scale * F.col("mean")).alias("shift"))
        lists = own.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("pos", "w"))).alias("ws"), F.sum("shift").alias("shift"))
        width = self.features.agg((F.max("pos") + 1).cast("int").alias("width"))
        full = self.classes.join(lists, "class", "left").join(F.broadcast(width))  # one row
        dense = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("ws", i), F.lit(0.0)))
        row = F.struct("place", "class", (F.col("intercept") - F.coalesce("shift", F.lit(0.0))).alias("intercept"), dense.alias("w"))
        many = F.count(F.lit(1)) * F.max("width") > MOST_WEIGHTS
        checked = F.when(many, F.raise_error(F.lit("the model has too many weights")).cast("int")).otherwise(F.max("width"))
        return full.agg(checked.alias("width"), F.array_sort(F.collect_list(row)).alias("m"))


def finite(vec: Column) -> Column:
    """No component is null, NaN or infinite; false for null."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def apply_linear(df: DataFrame, vec: str, model: LinearModel) -> DataFrame:
    """df with names, scores and probabilities, arrays in the order of classes.

    Probabilities are scores within 0 to 1, or their sigmoid. Rows with a component that is no number, or another width than
    the model's, have null scores and probabilities.
    """
    j = df.join(F.broadcast(model.gathered()))  # one row, its size is checked
    whole = finite(F.col(vec)) & (F.size(vec) == F.col("width"))
    scores = F.when(whole, F.transform("m", lambda c: c["intercept"] + S.dot(F.col(vec).cast("array<double>"), c["w"])))
    out = j.withColumns({"names": F.transform("m", lambda c: c["class"]), "scores": scores})
    turned = F.transform("scores", lambda s: S.sigmoid(s) if model.link == "sigmoid" else S.clip(s, 0, 1))
    return out.withColumn("probabilities", turned).drop("m", "width")


def apply_templates(df: DataFrame, vec: str, templates: DataFrame) -> DataFrame:
    """df with names and scores, the cosines with each template, 0 for an all-zero one; probabilities are null. templates: class, vec, a few rows."""
    table = templates.agg(F.array_sort(F.collect_list(F.struct("class", F.col("vec").cast("array<double>").alias("v")))).alias("__t"))
    own = F.col(vec).cast("array<double>")
    j = df.join(F.broadcast(table)).withColumn("__n", S.norm(own) + 1e-8)  # one row
    cosine = F.transform("__t", lambda t: S.clip(F.coalesce(S.dot(own, t["v"]) / F.col("__n") / F.nullif(S.norm(t["v"]), F.lit(0.0)), F.lit(0.0)), -1, 1))
    out = j.withColumns({"names": F.transform("__t", lambda t: t["class"]), "scores": F.when(finite(own), cosine)})
    return out.withColumn("probabilities", F.lit(None).cast("array<double>")).drop("__t", "__n")


def read_model(spark: SparkSession, folder: str, link: str = "identity") -> LinearModel | None:
    """The model whose tables are in a folder: features, weights, classes and, if there, projection; none where one is missing."""
    def table(name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{folder.rstrip('/')}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    features, weights, classes = (table(n) for n in ("features", "weights", "classes"))
    if features is None or weights is None or classes is None:
        return None
    return LinearModel(features, weights, classes, table("projection"), link)


def track_by_mode(df: DataFrame, vec: str, mode: str, model: LinearModel | None = None, templates: DataFrame | None = None, needs: Sequence[str] = ()) -> DataFrame | None:
    """The track by a decoder or by templates, with mode, asked and reason in every row; none where neither can be had.

    A decoder that is asked for gives way to templates where a column it needs is not in df, or where it has no model; the
    reason says which. What is asked for is trimmed and in any case; an unknown mode is as templates.
    """
    asked = (mode or "template").strip().lower()
    missing = [c for c in needs if c not in df.columns]
    used, reason = "template", "asked"
    if asked == "decoder":
        if missing:
            reason = f"missing {', '.join(missing)}"
        elif model is None:
            reason = "no model"
        else:
            used = "decoder"
    elif asked != "template":
        reason = f"unknown mode {asked}"
    if used == "template" and templates is None:
        return None
    track = apply_linear(df, vec, model) if used == "decoder" else apply_templates(df, vec, templates)
    return track.withColumns({"asked": F.lit(asked), "mode": F.lit(used), "reason": F.lit(reason)})
