"""Registration of queries, and stand-ins for sessions among the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import frame_no
from ..session import ship


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None) -> Callable:
    """Register a function of a Tables under its name."""

    def wrap(f: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = Query(run, sql)
        return f

    return wrap


@dataclass(frozen=True)
class Tables:
    """Tables by attribute, and the stand-ins: frames and activation from embeddings, traces from events."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def frames(self) -> DataFrame:
        """session_id, t_idx, vec."""
        e = self.embeddings
        return e.select(F.col("label").cast("long").alias("session_id"), frame_no(["label"], "vec_id").alias("t_idx"), F.col("embedding").cast("array<double>").alias("vec"))

    def activation(self) -> DataFrame:
        """session_id, t_idx, vertex, parcel, network, value: eight vertices a parcel, two parcels a network."""
        rows = self.frames().select("session_id", "t_idx", F.posexplode("vec").alias("vertex", "value"))
        return rows.select("session_id", "t_idx", F.col("vertex").cast("long").alias("vertex"), F.floor(F.col("vertex") / 8).alias("parcel"), F.floor(F.col("vertex") / 16).alias("network"), "value")

    def traces(self) -> DataFrame:
        """session_id, t_idx, channel, value, ts, event_id."""
        return self.events.select(F.col("user_id").alias("session_id"), frame_no(["user_id"], "ts", "event_id").alias("t_idx"), F.col("event_type").alias("channel"), "value", "ts", "event_id")


#: The same in SQL: put after WITH.
FR = "fr AS (SELECT CAST(label AS BIGINT) AS session_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t_idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
ACT = FR + ", act AS (SELECT session_id, t_idx, CAST(i AS BIGINT) AS vertex, CAST(i // 8 AS BIGINT) AS parcel, CAST(i // 16 AS BIGINT) AS network, v AS value FROM (SELECT session_id, t_idx, unnest(range(len(vec))) AS i, unnest(vec) AS v FROM fr))"
EV = "ev AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t_idx, event_type AS channel, value, ts, event_id FROM events)"
