"""Engagement and activation tracks, and scores over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as S
from .stats import robust_stats

MIN_BASELINE = 30


def activation_track(frames: DataFrame, baseline: DataFrame | None, keys: Sequence[str], t: str, vec: str, high: float = 1.0, low: float = -1.0) -> DataFrame:
    """Mean absolute activation, its z by the baseline (30 frames at least) or else the session, and labels."""
    raw = (F.aggregate(vec, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size(vec)).alias("raw")
    w = W.partitionBy(*keys)
    out = frames.select(*keys, t, raw)
    own = (F.col("raw") - F.avg("raw").over(w)) / (F.stddev_pop("raw").over(w) + 1e-8)
    if baseline is None:
        out = out.withColumns({"z": own, "from_baseline": F.lit(False)})
    else:
        base = baseline.select(raw).agg(F.count(F.lit(1)).alias("__n"), F.avg("raw").alias("__m"), F.stddev_pop("raw").alias("__s"))
        out = out.join(F.broadcast(base))  # a single row
        enough = F.col("__n") >= MIN_BASELINE
        out = out.withColumns({"z": F.when(enough, (F.col("raw") - F.col("__m")) / (F.col("__s") + 1e-8)).otherwise(own), "from_baseline": enough}).drop("__n", "__m", "__s")
    return out.withColumn("label", S.threshold_label(F.col("z"), high, low, "high_attention", "low_attention"))


def engagement_track(activation: DataFrame, baseline: DataFrame, keys: Sequence[str], t: str, vertex: str, network: str, value: str, up: object, down: object, high: float = 1.5, low: float = -1.5) -> DataFrame:
    """Robust z of each vertex by the baseline, mean over the `up` network less that over `down`; labels are strict.

    Vertices without a baseline give no score.
    """
    base = robust_stats(baseline, [vertex], value)
    z = activation.where(F.col(network).isin(up, down)).join(base, vertex, "left").withColumn("__z", (F.col(value) - F.col("median")) / F.col("scale"))
    of = lambda n: F.avg(F.when(F.col(network) == n, F.col("__z")))
    out = z.groupBy(*keys, t).agg((of(up) - of(down)).alias("score"))
    return out.withColumn("label", S.threshold_label(F.col("score"), high, low, "engaging", "boring"))


def focus_windows(df: DataFrame, keys: Sequence[str], t: str, value: str, half: int) -> DataFrame:
    """Centres of the best and the worst centred mean of each session, the first on ties."""
    smooth = df.withColumn("__s", F.avg(value).over(W.partitionBy(*keys).orderBy(t).rowsBetween(-half, half)))
    pick = smooth.groupBy(*keys).agg(F.min(F.struct((-F.round("__s", 9)).alias("k"), F.col(t).alias("center"), F.col("__s").alias("mean"))).alias("best"), F.min(F.struct(F.round("__s", 9).alias("k"), F.col(t).alias("center"), F.col("__s").alias("mean"))).alias("worst"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("focus"), F.col(f"{n}.center").alias("center"), F.col(f"{n}.mean").alias("mean")) for n in ("best", "worst")]))
    return pick.select(*keys, rows.alias("x")).select(*keys, "x.*")


def session_metrics(df: DataFrame, keys: Sequence[str], t: str, display: str, novelty_z: str) -> DataFrame:
    """Opening, sustain, transition, stability and density over a session's valid frames."""
    w = W.partitionBy(*keys)
    x = df.withColumns({"__i": F.row_number().over(w.orderBy(t)) - 1, "__m": F.count(F.lit(1)).over(w)})
    quarter, third = F.greatest(F.lit(1), F.floor(F.col("__m") / 4)), F.floor(F.col("__m") / 3)
    mean = lambda rule: F.avg(F.when(rule, F.col(display))) + 1e-6
    i, m, d = F.col("__i"), F.max("__m"), F.avg(display)
    return x.groupBy(*keys).agg(
        (mean(i < quarter) / mean(i >= quarter)).alias("opening"),
        F.when(m >= 3, mean(i >= F.col("__m") - third) / mean(i < third)).alias("sustain"),
        F.when(m >= 3, F.avg(F.when(F.col(novelty_z) > 0.6, 1.0).otherwise(0.0))).alias("transition"),
        F.when((m >= 2) & (d > 1e-8), 1 / (1 + F.stddev_pop(display) / (d + 1e-8))).alias("stability"),
        (d / (F.percentile(display, F.lit(0.9)) + 1e-8)).alias("density"),
    )


def source_fallback(df: DataFrame, keys: Sequence[str], sources: Sequence[tuple[str, str]], last: str) -> DataFrame:
    """value and source: the first source without gaps in the session, else the first one with 0 in its gaps."""
    w = W.partitionBy(*keys)
    value, source = F.coalesce(F.col(sources[0][1]), F.lit(0.0)), F.lit(last)
    for name, column in reversed(sources):
        whole = F.count(column).over(w) == F.count(F.lit(1)).over(w)
        value, source = F.when(whole, F.col(column)).otherwise(value), F.when(whole, F.lit(name)).otherwise(source)
    return df.withColumns({"value": value, "source": source})
