"""Windows and duplicates on event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, width: str, keys: Sequence[str], value: str, watermark: str | None = None) -> DataFrame:
    """start, keys, n, total by tumbling window. On a stream give a watermark: later rows are dropped and state is freed."""
    if watermark:
        df = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    g = df.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, keys: Sequence[str], watermark: str | None = None) -> DataFrame:
    """start, end, keys, n of runs of events with no gap that long."""
    if watermark:
        df = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    g = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_of_key(df: DataFrame, ts: str, keys: Sequence[str], watermark: str) -> DataFrame:
    """The first event of each key within the watermark: state is bounded by it."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def replay(spark: object, path: str, schema: object, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, some files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
