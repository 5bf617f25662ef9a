"""Activation matrices in NumPy archives."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def read_matrices(spark: SparkSession, paths: str | Sequence[str], key: str = "preds", width: int | None = None) -> DataFrame:
    """path, t_idx, vec: a row a frame of each archive. An array that isn't two-dimensional, or not `width` wide, fails.

    Archives are read whole, one a task at a time; store frames as Parquet for repeated use.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    preds = np.asarray(archive[key], np.float32)
                if preds.ndim != 2 or (width is not None and preds.shape[1] != width):
                    raise ValueError(f"{path}: {key} has shape {preds.shape}")
                for start in range(0, len(preds), 256):
                    part = preds[start : start + 256]
                    yield pd.DataFrame({"path": path, "t_idx": np.arange(start, start + len(part)), "vec": list(part)})

    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return files.select("path", "content").mapInPandas(run, "path string, t_idx long, vec array<float>")


def stack_frames(frames: DataFrame, max_frames: int | None = None) -> DataFrame:
    """Frames of all archives, in order of path and time, as one baseline; at most max_frames."""
    out = frames.orderBy("path", "t_idx")
    return out.limit(max_frames) if max_frames else out


def to_long(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, t_idx, vertex_index, value."""
    rows = frames.select(*keys, "t_idx", F.posexplode("vec").alias("vertex_index", "value"))
    return rows.withColumn("value", F.col("value").cast("double"))


def classify_frames(frames: DataFrame, expected: DataFrame, key: str, width: int) -> DataFrame:
    """key and status of each expected archive: missing, stale (another width), invalid (not finite), ok."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    seen = frames.groupBy(key).agg(F.max((F.size("vec") != width).cast("int")).alias("w"), F.max(bad.cast("int")).alias("b"))
    j = expected.select(key).join(seen, key, "left")
    return j.select(key, F.when(F.col("w").isNull(), "missing").when(F.col("w") == 1, "stale").when(F.col("b") == 1, "invalid").otherwise("ok").alias("status"))


def frame_numbers(frames: DataFrame, path: str = "path") -> DataFrame:
    """Gapless numbers by archive, for frames that were filtered."""
    return frames.withColumn("t_idx", F.row_number().over(W.partitionBy(path).orderBy("t_idx")).cast("long") - 1)
