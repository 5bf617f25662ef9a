"""Long and wide, arrays and maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def zip_rows(df: DataFrame, keys: Sequence[str], t: str, arrays: Sequence[str]) -> DataFrame:
    """Parallel arrays as rows; t: the place, from 0. Shorter arrays give nulls."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias(t, "__z"))
    return rows.select(*keys, F.col(t).cast("long").alias(t), *[F.col(f"__z.{a}").alias(a) for a in arrays])


def pivot_map(df: DataFrame, keys: Sequence[str], name: str, value: str, columns: Mapping[str, str], default: float) -> DataFrame:
    """The largest value of each channel in a column of its own name, default where it is absent; others are dropped."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col(name) == k, F.col(value))), F.lit(default)).alias(c) for k, c in columns.items()])


def json_rows(df: DataFrame, keys: Sequence[str], column: str, name: str, value: str) -> DataFrame:
    return df.select(*keys, F.explode(F.from_json(column, "map<string,string>")).alias(name, value))


def merge_maps(old: Column, new: Column) -> Column:
    """Keys of both; the new map wins."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(F.coalesce(kept, F.map_filter(new, lambda k, v: F.lit(False))), new)


def frame_summary(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    total = lambda f: F.aggregate(vec, F.lit(0.0), lambda a, x: a + f(x)) / F.size(vec)
    return df.select(*keys, total(lambda x: x).alias("mean"), F.array_min(vec).alias("low"), F.array_max(vec).alias("high"), total(F.abs).alias("mean_abs"))


def alignment(n: Column, expected: Column, tolerance: int) -> Column:
    """exact, tolerated, clamped (too many) or invalid (too few)."""
    return F.when(n == expected, "exact").when(F.abs(n - expected) <= tolerance, "tolerated").when(n > expected, "clamped").otherwise("invalid")
