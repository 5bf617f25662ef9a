"""Click exports whose headers drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Headers by field, lower case without spaces and underscores; the first that is there counts.
ALIASES = {
    "selector": ("selector", "element", "cssselector", "elementselector"),
    "text": ("text", "elementtext", "label"),
    "clicks": ("clicks", "totalclicks", "clickcount"),
    "sessions": ("sessions", "totalsessions", "sessioncount", "visitors"),
    "url": ("url", "page", "pageurl"),
}


def _plain(header: str) -> str:
    return "".join(c for c in header.lower() if c.isalnum())


def _pick(df: DataFrame, field: str) -> Column | None:
    found = {_plain(c): c for c in reversed(df.columns)}
    for alias in ALIASES[field]:
        if alias in found:
            return F.col(f"`{found[alias]}`")
    return None


def _number(c: Column | None) -> Column:
    return F.lit(None).cast("double") if c is None else F.regexp_replace(c.cast("string"), r"[,\s]", "").try_cast("double")


def normalize_clicks(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """keep, selector, text and url where given, clicks (0 if malformed), rate (clicks a session, 1 at most, null
    without sessions), norm (0 to 100 of the most clicks). Rows with neither clicks nor rate go.
    """
    clicks, sessions = F.coalesce(_number(_pick(df, "clicks")), F.lit(0.0)), _number(_pick(df, "sessions"))
    texts = [c.alias(f) for f in ("selector", "text", "url") if (c := _pick(df, f)) is not None]
    rows = df.select(*keep, *texts, clicks.cast("long").alias("clicks"), F.when(sessions > 0, F.least(F.lit(1.0), clicks / sessions)).alias("rate"))
    rows = rows.where("clicks > 0 OR rate IS NOT NULL")
    top = rows.agg(F.max("clicks").alias("__top"))
    return rows.join(F.broadcast(top)).withColumn("norm", F.coalesce(100.0 * F.col("clicks") / F.nullif(F.col("__top"), F.lit(0)), F.lit(0.0))).drop("__top")


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export, most clicked first."""
    raw = spark.read.option("header", True).csv(path)
    return normalize_clicks(raw).orderBy(F.desc("clicks"), F.desc_nulls_last("rate"))
