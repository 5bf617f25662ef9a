"""Ridge regression with whole groups left out and the penalty chosen inside.

All of it is done on groups' moments: a training set is the total less what is left out. For each group the rest is split into
folds of whole groups, penalties are compared on them, all penalties from one eigendecomposition, and the chosen one is
fitted on the rest. Errors, and the correlation of predictions, follow from moments too; rows are read once, and again
only where their predictions are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import centred, correlation, group_moments, hash_fold, square, summed


def coefficients(moments: np.ndarray, k: int, alphas: Sequence[float]) -> np.ndarray:
    """Penalties x (1 + k) x targets: intercepts and slopes, for standardised features, on the features' own scale.

    A feature that does not vary has no slope.
    """
    n, mean = moments[0, 0], moments[0, 1:] / moments[0, 0]
    about = centred(moments)
    spread = np.sqrt(np.maximum(np.diag(about)[:k], 0) / n)
    flat = spread <= 1e-12 * np.maximum(1, np.abs(mean[:k]))
    scale = np.where(flat, 1, spread)
    inner = np.where(flat[:, None] | flat[None, :], 0, about[:k, :k] / np.outer(scale, scale))
    values, vectors = np.linalg.eigh(inner)
    along = vectors.T @ np.where(flat[:, None], 0, about[:k, k:] / scale[:, None])
    out = np.zeros((len(alphas), 1 + k, along.shape[1]))
    for i, alpha in enumerate(alphas):
        weight = np.maximum(values, 0) + alpha
        out[i, 1:] = vectors @ (along / np.where(weight > 0, weight, np.inf)[:, None]) / scale[:, None]
        out[i, 0] = mean[k:] - mean[:k] @ out[i, 1:]
    return out


def squared_errors(moments: np.ndarray, k: int, fitted: np.ndarray) -> np.ndarray:
    """Penalties x targets: the sum of squared errors on rows with these moments."""
    inside, with_y = moments[: k + 1, : k + 1], moments[: k + 1, k + 1 :]
    quadratic = np.einsum("apt,pq,aqt->at", fitted, inside, fitted)
    return np.diag(moments)[k + 1 :] - 2 * np.einsum("apt,pt->at", fitted, with_y) + quadratic


def _solve(k: int, targets: Sequence[str], alphas: Sequence[float], folds: dict[int, list[float]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = {f: square(m) for f, m in folds.items()}
        total = sum(part.values())
        for frame in frames:
            rows = []
            for group, fold, m in zip(frame["g"], frame["fold"], frame["m"], strict=True):
                own = square(m)
                rest = total - own
                if rest[0, 0] < 2:
                    continue
                errors, judged = np.zeros((len(alphas), len(targets))), False
                for f, other in part.items():
                    held = other - own if f == fold else other
                    if held[0, 0] > 0 and rest[0, 0] - held[0, 0] >= 2:
                        errors += squared_errors(held, k, coefficients(rest - held, k, alphas))
                        judged = True
                fitted = coefficients(rest, k, alphas)
                best = np.argmin(errors, axis=0) if judged else np.zeros(len(targets), int)
                for t, name in enumerate(targets):
                    w = fitted[best[t], :, t]
                    with_y = own[: k + 1, k + 1 + t]
                    sums = (own[0, 0], own[0, k + 1 + t], w @ own[0, : k + 1], own[k + 1 + t, k + 1 + t], w @ own[: k + 1, : k + 1] @ w, w @ with_y)
                    rows.append((group, name, float(alphas[best[t]]), w.tolist(), *map(float, sums)))
            yield pd.DataFrame(rows, columns=["g", "target", "alpha", "weights", "n", "sy", "sp", "syy", "spp", "syp"])

    return run


def leave_group_out(df: DataFrame, group: str, features: Sequence[str], targets: Sequence[str], alphas: Sequence[float], folds: int = 5) -> DataFrame:
    """group, target, alpha, weights (intercept first), and sums of the group's rows: n, sy, sp, syy, spp, syp (p: predicted).

    The model of a group is fitted on all others; its penalty has the smallest squared error over folds of those others, the
    first of equal ones. Groups are in folds by hash, so with few groups some folds may be empty. The folds' moments,
    folds x (features + targets)² numbers, are sent to the tasks; groups may be any number. A group alone has no model.
    Where the reference semantics choose by leaving out single rows, groups are left out here: rows of one group are alike, and
    errors on them would favour too small a penalty.
    """
    kind = df.schema[group].dataType.simpleString()
    own = group_moments(df, group, features, targets).withColumn("fold", hash_fold(F.col(group), folds)).withColumnRenamed(group, "g")
    whole = {r["fold"]: list(r["m"]) for r in summed(own, ["fold"]).collect()}
    schema = f"g {kind}, target string, alpha double, weights array<double>, n double, sy double, sp double, syy double, spp double, syp double"
    return own.mapInPandas(_solve(len(features), list(targets), list(alphas), whole), schema).withColumnRenamed("g", group)


def out_of_fold(df: DataFrame, models: DataFrame, group: str, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """df's columns, target, y and predicted: every row under the model of its group, once a target."""
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    long = df.withColumn("__x", x).withColumn("__t", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets])))
    own = models.select(F.col(group).alias("__g"), F.col("target").alias("__target"), F.col("weights").alias("__w"))
    met = long.join(own, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__t.target") == F.col("__target")), "left")
    predicted = F.aggregate(F.zip_with("__x", "__w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return met.select(*df.columns, F.col("__t.target").alias("target"), F.col("__t.y").alias("y"), predicted.alias("predicted"))


def ridge_report(models: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """target, n, groups, r, mse and mean_log_alpha of the predictions of groups left out; r is 0 where y does not vary."""
    names = ["n", "sy", "sp", "syy", "spp", "syp"]
    sums = models.groupBy("target", *by).agg(*[F.sum(c).alias(c) for c in names], F.count(F.lit(1)).alias("groups"), F.avg(F.log10("alpha")).alias("mean_log_alpha"))
    r = F.coalesce(correlation(*[F.col(c) for c in names]), F.lit(0.0))
    mse = (F.col("syy") - 2 * F.col("syp") + F.col("spp")) / F.col("n")
    return sums.select("target", *by, F.col("n").cast("long").alias("n"), "groups", r.alias("r"), mse.alias("mse"), "mean_log_alpha")
