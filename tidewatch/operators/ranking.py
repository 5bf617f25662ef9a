"""Top rows, ranks and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as S
from .ranges import exact_quantiles, with_position


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str) -> DataFrame:
    """The first k rows of each group, numbered from 1; Spark prunes each partition to k rows before the shuffle."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, n).where(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))


def global_rank(df: DataFrame, order: Sequence[str | tuple[str, bool]], name: str) -> DataFrame:
    """Ranks over all rows, from 1; (column, True) for descending, nulls first. No task sorts all of them."""
    return with_position(df, [], order, name).withColumn(name, F.col(name) + 1)


def rank_sections(df: DataFrame, keys: Sequence[str], section: str, mean: str) -> DataFrame:
    """Rank by descending mean, a 0 to 100 score by min-max (flat: 50), and labels of the first and last of several."""
    w = W.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.desc(F.round(mean, 9)), section)).cast("long")
    n = F.count(F.lit(1)).over(w)
    out = df.withColumns({"rank": rank, "__n": n, "score": S.clip_score(S.minmax(F.col(mean), F.min(mean).over(w), F.max(mean).over(w), 100, 50))})
    label = F.when((F.col("__n") > 1) & (F.col("rank") == 1), "strongest").when((F.col("__n") > 1) & (F.col("rank") == F.col("__n")), "weakest")
    return out.withColumn("label", label).drop("__n")


def sample_sections(df: DataFrame, keys: Sequence[str], section: str, t: str, value: str, per_section: int, total: int) -> DataFrame:
    """First, peak and last time of each section, distinct; at most `total` a group, in section order."""
    g = df.groupBy(*keys, section).agg(F.min(t).alias("f"), F.max(t).alias("l"), F.max_by(t, F.struct(F.col(value), (-F.col(t)).alias("n"))).alias("p"))
    rows = g.select(*keys, section, F.explode(F.slice(F.array_distinct(F.array("f", "p", "l")), 1, per_section)).alias(t))
    return top_k(rows, keys, [F.asc(section), F.asc(t)], total, "__k").drop("__k")


def quartile_heads(df: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The first n rows of each quartile: bin, pick."""
    cuts = exact_quantiles(df, [], value, (0.25, 0.5, 0.75), "__q")
    j = df.join(F.broadcast(cuts))  # a single row
    bin_ = F.size(F.filter("__q", lambda q: F.col(value) > q))
    return top_k(j.withColumn("bin", bin_), ["bin"], [F.asc(order)], n, "pick").drop("__q")


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page, with the number of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))
