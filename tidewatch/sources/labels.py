"""Label series over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UNITS = {"milliseconds": 1e3, "microseconds": 1e6, "seconds": 1.0}


def label_series(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """keep, t_sec and the labels: numbers within 0..1, 0 where missing or malformed. The unit of time stands in the header."""
    for column in df.columns:
        for unit, scale in _UNITS.items():
            if column.lower().startswith("timestamp") and f"({unit})" in column.lower():
                value = lambda n: F.coalesce(F.nanvl(F.col(f"`{n}`").try_cast("double"), F.lit(0.0)), F.lit(0.0))
                return df.select(*keep, (F.col(f"`{column}`").try_cast("double") / scale).alias("t_sec"), *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), value(n))).alias(n) for n in names])
    raise ValueError("no timestamp column with a unit")


def read_label_series(spark: SparkSession, path: str, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return label_series(spark.read.option("header", True).csv(path), names, keep)
