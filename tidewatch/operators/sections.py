"""Sections of pages: assignment, reports, attribution, advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.boxes import overlap_area


def assign_sections(snapshots: DataFrame, landmarks: DataFrame, key: str, view: Sequence[str], box: Sequence[str], order: str, doc_height: float) -> DataFrame:
    """Each snapshot with the landmark that fills most of its viewport, the first on ties, else its third of the page.

    Viewports and boxes of a key meet once, however many snapshots and landmarks have them: of equal boxes only the first can win.
    """
    area = overlap_area(tuple(map(F.col, view)), tuple(map(F.col, box)))
    views = snapshots.select(key, *view).distinct()
    boxes = landmarks.groupBy(key, *box).agg(F.min(F.struct(F.col(order).alias("o"), F.col("dom_id").alias("d"))).alias("__first"))
    hits = views.join(boxes, key).withColumn("__a", area).where("__a > 0")
    best = hits.groupBy(*views.columns).agg(F.min(F.struct((-F.col("__a")).alias("a"), "__first")).alias("__m"))
    out = snapshots.join(best.select(*views.columns, F.col("__m.__first.d").alias("__d")), views.columns, "left").select(*snapshots.columns, "__d")
    middle = F.col(view[1]) + F.col(view[3]) / 2
    band = F.when(middle < doc_height / 3, "top").when(middle < 2 * doc_height / 3, "middle").otherwise("bottom")
    return out.withColumns({"section": F.coalesce("__d", band), "source": F.when(F.col("__d").isNotNull(), "landmark").otherwise("scroll_band")}).drop("__d")


def section_report(df: DataFrame, keys: Sequence[str], t: str, score: str, high: float, low: float) -> DataFrame:
    """Frames, mean, median, shares above and below the thresholds, and the time of the peak (the first on ties)."""
    s = F.col(score)
    share = lambda rule: F.avg(F.when(rule, 1.0).otherwise(0.0))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("dwell"), F.avg(s).alias("mean"), F.median(s).alias("median"), share(s > high).alias("pct_engaging"), share(s < low).alias("pct_boring"), F.max_by(t, F.struct(s, -F.col(t))).alias("peak_t"))


def rollup_elements(samples: DataFrame, keys: Sequence[str], element: str, density: str, text: str, source: str, k: int) -> DataFrame:
    """Mean density, count, first text in order and commonest source of each element, the k densest of each group."""
    by = samples.groupBy(*keys, element, source).agg(F.sum(density).alias("__s"), F.count(F.lit(1)).alias("__n"), F.min(text).alias("__t"))
    g = by.groupBy(*keys, element).agg((F.sum("__s") / F.sum("__n")).alias("mean_density"), F.sum("__n").alias("n"), F.min("__t").alias("text"), F.min(F.struct((-F.col("__n")).alias("n"), F.col(source).alias("v"))).alias("__m"))
    g = g.withColumn("source", F.col("__m.v")).drop("__m")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.round("mean_density", 9)), element))
    return g.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def attribute(samples: DataFrame, keys: Sequence[str], element: str, t: str, weight: Column, max_frames: int) -> DataFrame:
    """attention (0 to 100 of the group's best mean weight), n and confidence over at most max_frames strided frames."""
    w = W.partitionBy(*keys)
    frames = samples.select(*keys, t).distinct().withColumns({"__i": F.row_number().over(w.orderBy(t)) - 1, "__n": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1), F.ceil(F.col("__n") / max_frames))
    kept = samples.join(frames.where(F.col("__i") % step == 0).select(*keys, t), [*keys, t])
    g = kept.groupBy(*keys, element).agg(F.avg(weight).alias("mean"), F.count(F.lit(1)).alias("n"))
    return g.withColumns({"confidence": F.least(F.lit(1.0), F.col("n") / 10), "attention": F.coalesce(100 * F.col("mean") / F.nullif(F.max("mean").over(w), F.lit(0.0)), F.lit(0.0))})


def combine(attention: Column, click: Column, attention_weight: float = 0.68) -> Column:
    return attention_weight * attention + (1 - attention_weight) * click


def mismatch_flags(attention: Column, click: Column) -> Column:
    return F.array_compact(F.array(F.when((attention >= 70) & (click < 40), "high_saliency_low_clickability"), F.when((click >= 70) & (attention < 45), "cta_low_saliency")))


def advice(mean: Column, pct_boring: Column, pct_engaging: Column, dwell: Column) -> Column:
    """Short codes of what to try, in order; 'monitor' where nothing speaks for a change."""
    rules = F.array_compact(F.array(
        F.when((pct_boring > 0.4) & (dwell < 8), "shorten_or_raise_cta").when(pct_boring > 0.35, "stronger_hook"),
        F.when((pct_engaging < 0.15) & (mean > 0), "raise_contrast"),
        F.when((mean > 1.5) & (dwell >= 10), "repeat_layout"),
    ))
    return F.when(F.size(rules) == 0, F.array(F.lit("monitor"))).otherwise(rules)
