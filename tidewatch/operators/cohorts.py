"""Cohorts, calibration and small models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from .moments import poisson_weights


def assign_clusters(df: DataFrame, rules: Mapping[str, Mapping[str, str]], subject: str, least: int = 20) -> DataFrame:
    """subject, cluster, n, suppressed: one row for each rule (all its equalities) that a subject meets.

    Rules become one array of labels a row, so the table is read once; clusters below `least` are suppressed.
    """
    holds = [F.when(_all([F.col(c) == v for c, v in where.items()]), F.lit(name)) for name, where in rules.items()]
    member = df.select(subject, F.explode(F.array_compact(F.array(*holds))).alias("cluster"))
    n = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return member.join(F.broadcast(n), "cluster").withColumn("suppressed", F.col("n") < least)  # a row a rule


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def one_factor_r2(df: DataFrame, factor: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of y's variance between the levels of a factor: from sums alone, in two aggregations."""
    level = df.groupBy(*keys, factor).agg(F.count(y).alias("__n"), F.sum(y).alias("__s"), F.sum(F.col(y) * F.col(y)).alias("__q"))
    n, s, q = F.sum("__n"), F.sum("__s"), F.sum("__q")
    between = F.sum(F.col("__s") * F.col("__s") / F.col("__n")) - s * s / n
    return level.groupBy(*keys).agg(n.alias("n"), (between / F.nullif(q - s * s / n, F.lit(0.0))).alias("r2"))


def confusion(df: DataFrame, y: str, predicted: str) -> DataFrame:
    return df.groupBy(y, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 of each class, from a confusion table."""
    c = confusion(df, y, predicted)
    truth = c.groupBy(F.col(y).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(y) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    said = c.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("said"))
    j = truth.join(said, "label", "left")
    precision = F.coalesce(F.col("hit") / F.nullif(F.col("said"), F.lit(0)), F.lit(0.0))
    recall = F.col("hit") / F.col("support")
    return j.select("label", "support", precision.alias("precision"), recall.alias("recall"), F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """A 0/1 column for each level but the first."""
    return df.select("*", *[(F.col(column) == v).cast("int").alias(f"is_{v.lower()}") for v in levels[1:]])


def dealt_out(df: DataFrame, row: str) -> DataFrame:
    """df in as many parts as shuffles have. A count that is named is kept: by size alone rows that are yet to be multiplied go to few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), row)


#: Of a batch so many names and groups, and so many replicates, are worked on at once.
_NAMES, _GROUPS, _REPLICATES = 8, 64, 2048


def _resampled(keys: Sequence[str], replicates: int) -> Callable:
    """Of a batch's rows, by group, the sums of weights and of weighted values, a number a replicate; a sum without values is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch[k].dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for k in keys]
            _, group = np.unique(np.stack(codes, axis=1), axis=0, return_inverse=True) if codes else (None, np.zeros(batch.num_rows, int))
            order = np.argsort(group.ravel(), kind="stable")
            batch, group = batch.take(pa.array(order)), group.ravel()[order]
            names, seen = batch["__name"].to_pylist(), batch["__v"].is_valid().to_numpy(zero_copy_only=False)
            values = np.where(seen, batch["__v"].fill_null(0.0).to_numpy(), 0.0)
            firsts = np.flatnonzero(np.diff(group, prepend=-1))
            for g in range(0, len(firsts), _GROUPS):
                own = firsts[g : g + _GROUPS]
                end = firsts[g + _GROUPS] if g + _GROUPS < len(firsts) else batch.num_rows
                n, s, some = (np.zeros((len(own), replicates), t) for t in (np.int64, np.float64, np.int64))
                for low in range(0, replicates, _REPLICATES):
                    part = slice(low, min(low + _REPLICATES, replicates))
                    for i in range(own[0], end, _NAMES):
                        rows = slice(i, min(i + _NAMES, end))
                        w = poisson_weights(names[rows], range(part.start, part.stop)).astype(np.int64)
                        v = np.where(w > 0, w * values[rows, None], 0.0)
                        starts = np.flatnonzero(np.diff(group[rows], prepend=-1))
                        at = group[rows][starts] - group[own[0]]
                        for sums, x in ((n, w), (s, v), (some, w * seen[rows, None])):
                            sums[at, part] += np.add.reduceat(x, starts, axis=0)
                ends = pa.array(np.arange(len(own) + 1) * replicates, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(s.ravel(), mask=some.ravel() == 0), pa.array(n.ravel()))]
                yield pa.RecordBatch.from_arrays([*[batch[k].take(pa.array(own)) for k in keys], *lists], names=[*keys, "__s", "__n"])

    return run


def bootstrap_mean(df: DataFrame, keys: Sequence[str], row: str, value: str, replicates: int, alpha: float = 0.05) -> DataFrame:
    """mean and the percentile interval of its bootstrap, by group.

    Each row gets a Poisson(1) weight in each replicate from a hash (`moments.with_weight`), so a replicate is one weighted
    sum and no group is gathered: tasks sum up a batch of rows in all replicates, Spark adds these sums. Rows are
    dealt out before, so that every core has its share however few files there are. keys: no nested columns.
    """
    name = F.coalesce(F.concat(F.col(row).cast("string"), F.lit(":")), F.lit("")).cast("binary")
    rows = dealt_out(df.select(*keys, F.col(row).alias("__row"), name.alias("__name"), F.col(value).cast("double").alias("__v")), "__row").drop("__row")
    schema = StructType([*rows.select(*keys).schema.fields, *StructType.fromDDL("__s array<double>, __n array<bigint>").fields])
    parts = rows.mapInArrow(_resampled(list(keys), replicates), schema).select(*keys, F.posexplode(F.arrays_zip("__s", "__n")).alias("__r", "__x"))
    means = parts.groupBy(*keys, "__r").agg(F.sum("__x.__s").alias("__s"), F.sum("__x.__n").alias("__n")).where("__n > 0").withColumn("__m", F.col("__s") / F.col("__n"))
    bounds = means.groupBy(*keys).agg(F.percentile("__m", F.lit(alpha / 2)).alias("low"), F.percentile("__m", F.lit(1 - alpha / 2)).alias("high"), F.count(F.lit(1)).alias("replicates"))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).join(bounds, list(keys))


def permutation_p(df: DataFrame, row: str, x: str, y: str, permutations: int, site: str | None = None) -> DataFrame:
    """r of x and y, and the share of permutations of y (within sites, where one is named) at or above it: (hits + 1) / (permutations + 1).

    A permutation is the order of rows by a hash of its number and the row: places in that order meet the places in the order
    of rows, which are numbered once. Nothing is gathered: a window holds a site's rows of one permutation, and the join is by
    sorting, as the size before explode would have Spark broadcast all permutations through the driver.
    """
    own = F.col(site) if site else F.lit(0)
    place = lambda *by: F.row_number().over(W.partitionBy(*by[0]).orderBy(*by[1:]))
    rows = df.select(F.col(row).alias("__row"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), own.alias("__site"))
    here = rows.select("__site", "__x", place(["__site"], "__row").alias("__k"))
    many = dealt_out(rows, "__row").withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    by = F.when(F.col("__p") > 0, F.md5(F.concat_ws(":", "__p", "__row").cast("binary")))
    there = many.select("__site", "__p", "__y", place(["__site", "__p"], by, "__row").alias("__k"))
    r = there.hint("merge").join(here, ["__site", "__k"]).groupBy("__p").agg(F.corr("__x", "__y").alias("r"))
    first = r.where("__p = 0").select(F.col("r").alias("__r"))
    hits = F.sum(F.when(F.col("r") >= F.col("__r") - 1e-9, 1).otherwise(0))
    return r.where("__p > 0").join(F.broadcast(first)).groupBy(F.col("__r").alias("r")).agg(((hits + 1) / (permutations + 1)).alias("p"))


def ridge_group_folds(df: DataFrame, group: str, features: Sequence[str], target: str, alpha: float, folds: int) -> DataFrame:
    """Out-of-fold predictions of ridge regression, groups kept whole: group, fold, target, predicted.

    Each fold's normal equations come from sums by fold (a few numbers), so rows are never gathered; prediction is a
    projection.
    """
    fold = F.pmod(F.crc32(F.col(group).cast("string").cast("binary")), F.lit(folds)).cast("int")
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    d = df.select(group, fold.alias("fold"), F.col(target).cast("double").alias("target"), F.array(*cols).alias("__x"))
    k = len(cols)
    sums = [F.sum(F.col("__x")[i] * F.col("__x")[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(F.col("__x")[i] * F.col("target")).alias(f"b{i}") for i in range(k)]
    rows = {r["fold"]: r for r in d.groupBy("fold").agg(*sums).collect()}
    gram = {f: np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float) for f, r in rows.items()}
    rhs = {f: np.array([r[f"b{i}"] for i in range(k)], float) for f, r in rows.items()}
    penalty = alpha * np.diag([0.0] + [1.0] * (k - 1))
    prediction = F.lit(None).cast("double")
    for f in rows:
        others = [g for g in rows if g != f]
        if others:
            w = np.linalg.lstsq(sum(gram[g] for g in others) + penalty, sum(rhs[g] for g in others), rcond=None)[0]
            line = sum((F.col("__x")[i] * float(w[i]) for i in range(k)), F.lit(0.0))
            prediction = F.when(F.col("fold") == f, line).otherwise(prediction)
    return d.select(group, "fold", "target", prediction.alias("predicted"))


def logistic_by_gradient(df: DataFrame, features: Sequence[str], label: str, rate: float = 0.05, rounds: int = 25) -> list[float]:
    """Weights (bias first) of a logistic model by full-batch gradient descent; each round is one aggregation."""
    w = [0.0] * (len(features) + 1)
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    data = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], F.col(label).cast("double").alias("y")).cache()
    for _ in range(rounds):
        z = sum((F.col(f"x{i}") * w[i] for i in range(len(w))), F.lit(0.0))
        err = 1 / (1 + F.exp(-z)) - F.col("y")
        g = data.agg(*[F.avg(err * F.col(f"x{i}")) for i in range(len(w))]).first()
        w = [a - rate * float(b or 0.0) for a, b in zip(w, g, strict=True)]
    data.unpersist()
    return w
