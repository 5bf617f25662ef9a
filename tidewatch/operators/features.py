"""Training tables: joins that lose nothing in silence, and feature vectors by a named layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.specs import FeatureSpec


def strict_join(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """left with right's other columns, where each row has exactly one match; the job fails on a key without one, and on one with several.

    A null key has none. Keys of right that no row of left has may occur as often as they like.
    """
    rest = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest)).alias("__r"))
    named = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    fails = lambda why: F.raise_error(F.concat(F.lit(f"{why} {what} for "), named)).cast("boolean")
    fine = F.when(F.col("__n").isNull(), fails("no")).when(F.col("__n") > 1, fails("several")).otherwise(F.lit(True))
    return left.join(once, list(keys), "left").where(fine).select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in rest])


def first_match_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """left's rows that have a match, with the first one's columns by order; rows without one go."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return left.join(right.withColumn("__k", place).where("__k = 1").drop("__k"), list(keys))


#: Reducers whose values over a window follow from sums and extremes by frame: number, sum, sum of squares, of sizes, largest size, largest, least.
_WINDOWED = {
    "mean": lambda n, s, q, a, m, high, low: s / n,
    "std": lambda n, s, q, a, m, high, low: F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))),
    "mean_abs": lambda n, s, q, a, m, high, low: a / n,
    "max_abs": lambda n, s, q, a, m, high, low: m,
    "max": lambda n, s, q, a, m, high, low: high,
    "min": lambda n, s, q, a, m, high, low: low,
    "sum": lambda n, s, q, a, m, high, low: s,
}


def feature_matrix(df: DataFrame, keys: Sequence[str], t: str, region: str, value: str, spec: FeatureSpec, extra: DataFrame | None = None, vec: str = "sub") -> DataFrame:
    """keys, t, features: of each frame every region's reducers, in the layout's order, then the extra block.

    df: a row a frame, region and vertex. With a window of several frames a reducer takes all values of the region in the frames around, fewer
    at the ends; frames are summed before windows are taken. extra: keys, t and an array of the layout's length; where it is
    missing, that block is 0. Every frame must have every region; a layout without reducers has the extra block alone.
    """
    unknown = [r for r in spec.reducers if r not in _WINDOWED]
    if unknown:
        raise ValueError(f"reducers without windows: {unknown}")
    x = F.col(value).cast("double")
    sums = {"__n": F.count(x), "__s": F.sum(x), "__q": F.sum(x * x), "__a": F.sum(F.abs(x)), "__m": F.max(F.abs(x)), "__high": F.max(x), "__low": F.min(x)}
    frames = df.groupBy(*keys, t, region).agg(*[c.alias(name) for name, c in sums.items()])
    half = spec.window // 2
    w = W.partitionBy(*keys, region).orderBy(t).rowsBetween(-half, half)
    merge = {"__m": F.max, "__high": F.max, "__low": F.min}
    parts = [merge.get(name, F.sum)(name).over(w) if half else F.col(name) for name in sums]
    own = F.array(*[_WINDOWED[r](*parts) for r in spec.reducers]) if spec.reducers else F.array().cast("array<double>")
    rows = frames.select(*keys, t, region, own.alias("__f"))
    blocks = rows.groupBy(*keys, t).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(region, "__f"))), lambda r: r["__f"])).alias("__f"))
    none = F.array_repeat(F.lit(0.0), spec.n_subcortical)
    if extra is None:
        return blocks.select(*keys, t, F.concat("__f", none).alias("features"))
    joined = blocks.join(extra.select(*keys, t, F.col(vec).cast("array<double>").alias("__e")), [*keys, t], "left")
    wrong = F.raise_error(F.lit(f"the extra block must have {spec.n_subcortical} values")).cast("array<double>")
    block = F.when(F.col("__e").isNull(), none).when(F.size("__e") != spec.n_subcortical, wrong).otherwise(F.col("__e"))
    return joined.select(*keys, t, F.concat("__f", block).alias("features"))


def inspect_frames(frames: DataFrame, keys: Sequence[str], t: str, vec: str, timestep: int, top: int) -> DataFrame:
    """keys, n_t, n_v, low, high, t, rank, vertex, value: of each session its shape, extremes, and the largest values of one frame.

    The frame is the timestep, or the nearest there is; of equal values the later vertex comes first.
    """
    low, high = F.array_min(vec), F.array_max(vec)
    shape = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_t"), F.max(F.size(vec)).cast("long").alias("n_v"), F.min(low).alias("low"), F.max(high).alias("high"), F.min(F.struct(F.abs(F.col(t) - timestep).alias("d"), F.col(t).alias("t"), F.col(vec).alias("v"))).alias("__f"))
    pairs = F.slice(F.sort_array(F.transform("__f.v", lambda x, i: F.struct(x.alias("value"), i.alias("vertex"))), asc=False), 1, top)
    rows = shape.select(*keys, "n_t", "n_v", "low", "high", F.col("__f.t").alias(t), F.posexplode(pairs).alias("rank", "__p"))
    return rows.select(*keys, "n_t", "n_v", "low", "high", t, (F.col("rank") + 1).alias("rank"), F.col("__p.vertex").alias("vertex"), F.col("__p.value").alias("value"))
