"""Operators on ordered rows of sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def frame_no(keys: Sequence[str], *order: str) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long") - 1


def novelty(frames: DataFrame, keys: Sequence[str], t: str, vec: str, name: str = "novelty") -> DataFrame:
    """Euclidean length of the change from the frame before; the first is 0. vec: arrays of one length."""
    before = F.lag(vec).over(W.partitionBy(*keys).orderBy(t))
    change = F.sqrt(F.aggregate(F.zip_with(F.col(vec), F.col("__b"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, d: a + d))
    return frames.withColumn("__b", before).withColumn(name, F.when(F.col("__b").isNull(), F.lit(0.0)).otherwise(change)).drop("__b")


def islands(df: DataFrame, keys: Sequence[str], t: str, mask: Column) -> DataFrame:
    """df's rows where the mask holds, with run: a number that each maximal run of consecutive rows shares."""
    seen = df.withColumn("__p", F.row_number().over(W.partitionBy(*keys).orderBy(t)))
    return seen.where(mask).withColumn("run", F.col("__p") - F.row_number().over(W.partitionBy(*keys).orderBy(t))).drop("__p")


def threshold_runs(df: DataFrame, keys: Sequence[str], t: str, value: str, above: float, min_frames: int) -> DataFrame:
    """Runs of value > above of at least min_frames frames: start, end (inclusive), frames, excess."""
    found = islands(df, keys, t, F.col(value) > above).groupBy(*keys, "run").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.count(F.lit(1)).alias("n_frames"), F.sum(F.col(value) - above).alias("excess"))
    return found.where(F.col("n_frames") >= max(1, min_frames)).drop("run")


def rolling_corr(x: str, y: str, keys: Sequence[str], t: str, size: int, eps: float = 1e-8) -> Column:
    """Over the row and the size - 1 before; null until the window is full, 0 where a side hardly varies."""
    w = W.partitionBy(*keys).orderBy(t).rowsBetween(1 - size, 0)
    still = (F.stddev_pop(x).over(w) < eps) | (F.stddev_pop(y).over(w) < eps)
    return F.when(F.count(F.lit(1)).over(w) >= size, F.when(still, F.lit(0.0)).otherwise(F.corr(x, y).over(w)))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str, order: str, take: Sequence[str]) -> DataFrame:
    """Each left row with columns of the right row nearest in time; on ties the one that comes first in `order`.

    One union, sorted once by key and time: the last right row at or before and the first at or after are candidates.
    Of right rows at one time only the first is a candidate.
    """
    r = right.withColumn("__n", F.row_number().over(W.partitionBy(*keys, right_t).orderBy(order))).where("__n = 1")
    kept = [c for c in left.columns if c not in keys]
    side = r.select(*keys, F.col(right_t).cast("double").alias("__t"), F.struct(F.col(right_t).cast("double").alias("t"), F.col(order).alias("o"), *take).alias("__r"))
    both = left.withColumn("__t", F.col(left_t).cast("double")).withColumn("__l", F.lit(True)).unionByName(side, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("__t")
    prev = F.last("__r", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0))
    nxt = F.first("__r", ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing))
    both = both.withColumns({"__prev": prev, "__next": nxt}).where("__l")
    back, ahead = F.col("__t") - F.col("__prev.t"), F.col("__next.t") - F.col("__t")
    pick = F.when(F.col("__prev").isNull(), F.col("__next")).when(F.col("__next").isNull() | (back < ahead), F.col("__prev")).when(ahead < back, F.col("__next")).otherwise(F.when(F.col("__prev.o") <= F.col("__next.o"), F.col("__prev")).otherwise(F.col("__next")))
    return both.withColumn("__pick", pick).select(*keys, *kept, *[F.col(f"__pick.{c}").alias(c) for c in take])


def interpolate(grid: DataFrame, series: DataFrame, keys: Sequence[str], t: str, value: str, extrapolate: bool = False) -> DataFrame:
    """value at the grid's times, linear between neighbours; outside, the edge value, or the edge segment's line."""
    w = W.partitionBy(*keys).orderBy(t)
    points = series.select(*keys, F.col(t).cast("double").alias(t), F.col(value).cast("double").alias(value))
    points = points.withColumns({"__p": F.lag(F.struct(t, value)).over(w), "__n": F.lead(F.struct(t, value)).over(w)})
    points = points.select(*keys, t, F.struct(t, value, "__p", "__n").alias("__pt"))
    both = grid.select(*keys, F.col(t).cast("double").alias(t)).withColumn("__g", F.lit(True)).unionByName(points, allowMissingColumns=True)
    both = both.withColumns({"__a": F.last("__pt", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0)), "__b": F.first("__pt", ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing))}).where("__g")
    at = F.col(t)
    line = lambda x, y: F.when(x[t] == y[t], x[value]).otherwise(x[value] + (at - x[t]) * (y[value] - x[value]) / (y[t] - x[t]))
    a, b = F.col("__a"), F.col("__b")
    before = F.coalesce(line(b, b["__n"]), b[value]) if extrapolate else b[value]
    after = F.coalesce(line(a["__p"], a), a[value]) if extrapolate else a[value]
    return both.select(*keys, t, F.when(a.isNull(), before).when(b.isNull(), after).otherwise(line(a, b)).alias(value))


def forward_fill(df: DataFrame, keys: Sequence[str], t: str, frames: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each time of frames; columns hold their last value so far."""
    w = W.partitionBy(*keys).orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    return frames.join(df, [*keys, t], "left").select(*keys, t, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns])


def cooldown(times: Column, gap: int) -> Column:
    """Of ascending times those accepted when each must be `gap` past the last accepted one: a fold over the array."""
    kind = F.array().cast("array<bigint>")
    return F.aggregate(times, kind, lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(t))).otherwise(acc))


def sliding(df: DataFrame, keys: Sequence[str], t: str, size: int, stride: int, collect: Sequence[str]) -> DataFrame:
    """Windows of `size` rows at consecutive times, every stride-th of them, with the collected columns as arrays."""
    w = W.partitionBy(*keys).orderBy(t)
    frame = w.rowsBetween(1 - size, 0)
    out = df.withColumns({"t_start": F.lag(t, size - 1).over(w), **{f"{c}_window": F.collect_list(c).over(frame) for c in collect}})
    out = out.where(F.col(t) - F.col("t_start") == size - 1)
    return out.withColumn("__i", F.row_number().over(w) - 1).where(F.col("__i") % stride == 0).drop("__i")


def edge_mask(t: Column, n: Column, tr_seconds: float, skip: int = 1, tail_seconds: float = 5.0, long_seconds: float = 8.0) -> Column:
    """Frames away from the edges: not the first and last `skip`, and not the tail of long sessions; all if none is left."""
    tail = F.when(n * tr_seconds > long_seconds, F.greatest(F.lit(skip), F.ceil(F.lit(tail_seconds / tr_seconds)).cast("int"))).otherwise(F.lit(skip))
    return F.when(n - tail <= skip, F.lit(True)).otherwise((t >= skip) & (t < n - tail))
