"""How long elements were visible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scores import visibility


def visible_ms(df: DataFrame, keys: Sequence[str], element: str, ts: str, ratio: Column, ties: Sequence[str] = ()) -> DataFrame:
    """Milliseconds times visible ratio (0 to 1, 1 where it is null) between one transition and the next of the session, by element."""
    w = W.partitionBy(*keys).orderBy(ts, *ties)
    micros = F.timestamp_diff("MICROSECOND", F.col(ts), F.lead(ts).over(w))
    rows = df.withColumn("__ms", F.coalesce(micros, F.lit(0)) / 1000.0 * visibility(ratio))
    return rows.groupBy(*keys, element).agg(F.sum("__ms").alias("visible_ms"))
