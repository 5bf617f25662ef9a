"""Grouped statistics, norms and ranks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ranges import exact_quantiles, null_safe, value_ranks

#: Reducers by name; a new one is registered by assignment.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "mean_abs": lambda c: F.avg(F.abs(c)),
    "max_abs": lambda c: F.max(F.abs(c)),
    "median": F.median,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
}


def parse_reducers(names: str | Sequence[str]) -> tuple[str, ...]:
    """Names, comma-separated or in a sequence, each known and once."""
    found = tuple(dict.fromkeys(n.strip() for n in (names.split(",") if isinstance(names, str) else names) if n.strip()))
    if not found or (unknown := [n for n in found if n not in REDUCERS]):
        raise ValueError(f"unknown reducers: {unknown if found else names!r}")
    return found


def reduce_groups(df: DataFrame, keys: Sequence[str], value: str, reducers: str | Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[REDUCERS[r](F.col(value)).alias(r) for r in parse_reducers(reducers)])


def mean_of_means(df: DataFrame, keys: Sequence[str], inner: str, outer: str, value: str, reducer: str = "mean") -> DataFrame:
    """Unweighted mean over inner groups, by keys and outer: two aggregations, never one."""
    parts = df.groupBy(*keys, outer, inner).agg(REDUCERS[reducer](F.col(value)).alias("__v"))
    return parts.groupBy(*keys, outer).agg(F.avg("__v").alias(value))


def norm_table(df: DataFrame, keys: Sequence[str], value: str, floor: float = 1e-8, quantiles: bool = True) -> DataFrame:
    """mean, std (population, floored; floor for a single row), n_samples and, if asked for, exact q05, q50 and q95.

    A group may have any number of rows: quantiles are read off ranges of values.
    """
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(floor)).alias("std"), F.count(value).alias("n_samples"))
    if not quantiles:
        return out
    met = null_safe(out, exact_quantiles(df, keys, value, (0.05, 0.5, 0.95), "__q"), keys, "left")
    return met.select(*keys, "mean", "std", "n_samples", *[F.col("__q")[i].alias(n) for i, n in enumerate(("q05", "q50", "q95"))])


def z_against(df: DataFrame, norms: DataFrame, key: str, value: str, floor: float = 1e-8, name: str = "z") -> DataFrame:
    """(value - mean) / max(std, floor) by the norm of the row's key; a key without a norm fails the job."""
    n = norms.select(key, F.col("mean").alias("__m"), F.col("std").alias("__s"))
    joined = df.join(n, key, "left")
    missing = F.when(F.col("__m").isNull(), F.raise_error(F.concat(F.lit(f"no norm for {key} "), F.col(key).cast("string"))).cast("double"))
    return joined.withColumn(name, F.coalesce(missing, (F.col(value) - F.col("__m")) / F.greatest("__s", F.lit(floor)))).drop("__m", "__s")


def session_z(df: DataFrame, keys: Sequence[str], value: str, least: float = 1e-7, eps: float = 1e-8, valid: Column | None = None, name: str = "z") -> DataFrame:
    """z within the keys; where valid is given, mean and deviation are those of valid rows but all rows get a z."""
    w = W.partitionBy(*keys)
    x = F.col(value) if valid is None else F.when(valid, F.col(value))
    mean, std = F.avg(x).over(w), F.stddev_pop(x).over(w)
    return df.withColumn(name, F.when(std < least, F.lit(0.0)).otherwise((F.col(value) - mean) / (std + eps)))


def robust_stats(df: DataFrame, keys: Sequence[str], value: str, floor: float = 1e-6) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation, floored; groups may have any number of rows."""
    med = exact_quantiles(df, keys, value, (0.5,), "__q").select(*keys, F.col("__q")[0].alias("median"))
    away = df.join(med, list(keys)).select(*keys, "median", F.abs(F.col(value) - F.col("median")).alias("__d"))
    mad = exact_quantiles(away, [*keys, "median"], "__d", (0.5,), "__q")
    return mad.select(*keys, "median", F.greatest(1.4826 * F.col("__q")[0], F.lit(floor)).alias("scale"))


def percentile_rank(keys: Sequence[str], value: str) -> Column:
    """100 times the share of the group's rows at or below the row."""
    return 100 * F.cume_dist().over(W.partitionBy(*keys).orderBy(value))


def ecdf_against(df: DataFrame, reference: DataFrame, keys: Sequence[str], value: str, name: str = "ecdf") -> DataFrame:
    """Share of the group's reference values at or below each value: one union and one window, no pairs."""
    both = df.withColumn("__ref", F.lit(0)).unionByName(reference.select(*keys, value).withColumn("__ref", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*keys)
    below = F.sum("__ref").over(w.orderBy(value).rangeBetween(W.unboundedPreceding, 0))
    return both.withColumn(name, below / F.nullif(F.sum("__ref").over(w), F.lit(0))).where("__ref = 0").drop("__ref")


def guarded_corr(x: str, y: str, least: int = 2, eps: float = 1e-8, flat: float | None = 0.0) -> Column:
    """Pearson's r; null below `least` rows, `flat` where a side hardly varies."""
    thin = F.count(F.lit(1)) < least
    still = (F.stddev_pop(x) < eps) | (F.stddev_pop(y) < eps)
    return F.when(thin, F.lit(None).cast("double")).when(still, F.lit(flat).cast("double")).otherwise(F.corr(x, y))


def auc(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums, per group: on the counts of values, ties averaged."""
    positive = F.col(label).cast("double")
    values = value_ranks(df, keys, score, sums={"__pos": F.sum(positive), "__neg": F.sum(1.0 - positive)})
    pos, neg = F.sum("__pos"), F.sum("__neg")
    ranks = F.sum(F.col("__pos") * (F.col("below") + (F.col("n") + 1) / 2.0))
    return values.groupBy(*keys).agg(pos.alias("n_pos"), neg.alias("n_neg"), ((ranks - pos * (pos + 1) / 2) / (F.nullif(pos, F.lit(0.0)) * F.nullif(neg, F.lit(0.0)))).alias("auc"))
