"""Writers: Parquet tables by session, logs, a registry of norms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import upsert


def replace_sessions(df: DataFrame, path: str, by: Sequence[str] = ("session_id",)) -> None:
    """Write df's sessions in place of what the table had for them; other sessions stay."""
    df.repartition(*by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def clear_sessions(spark: SparkSession, path: str, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """The table without the rows of the given keys; write it elsewhere, or read it instead of the table."""
    return spark.read.parquet(path).join(keys.select(*by), list(by), "left_anti")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def merge_table(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with new rows in place of those of the same keys; a column that one side lacks is null there."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema.fields if f.name not in old.columns]
    return upsert(old.select("*", *missing), new.select(*[F.col(f"`{c}`") if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in [*old.columns, *[f.name for f in new.schema.fields if f.name not in old.columns]]]), keys)


def register_norm(registry: DataFrame, norm_id: str, roi_path: str, network_path: str, meta: str = "{}") -> DataFrame:
    row = registry.sparkSession.createDataFrame([(norm_id, roi_path, network_path, meta)], "norm_id string, roi_path string, network_path string, meta string")
    return merge_table(registry, row, ["norm_id"])


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first path that the cluster's file systems hold, else the first of all."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    return candidates[0]
