"""Ranks, positions and exact quantiles of groups of any size.

Values are cut into ranges at approximate quantiles of the whole column; a value that is a bound itself, as hot ones are, has
a range of its own. Counts of ranges, a few numbers a group, give each range its offset; only what lies within one range is
sorted together. Results are exact whatever the bounds: these decide only how evenly the work is spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Bounds between ranges.
PARTS = 64


def _number(column: Column, kind: T.DataType) -> tuple[Column, bool]:
    """A number that grows with the value, and whether different values have different ones.

    Texts by their first six bytes, structs by their first field, times by microseconds.
    """
    if isinstance(kind, T.StructType):
        first = kind.fields[0]
        return _number(column[first.name], first.dataType)[0], False
    if isinstance(kind, (T.StringType, T.BinaryType)):
        start = F.rpad(F.hex(F.substring(column.cast("binary"), 1, 6)), 12, "0")
        return F.conv(start, 16, 10).cast("long"), False
    if isinstance(kind, T.DateType):
        return F.unix_date(column), True
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")), True
    return (column.cast("int") if isinstance(kind, T.BooleanType) else column), True


def with_range(df: DataFrame, value: str, name: str = "__b", parts: int = PARTS, descending: bool = False) -> DataFrame:
    """df with the number of each value's range, nulls in the first: even between two bounds, odd on a bound."""
    x, _ = _number(F.col(value), df.schema[value].dataType)
    x = -x if descending else x
    at = F.array(*[F.lit((i + 1) / (parts + 1)) for i in range(parts)])
    bounds = df.select(x.alias("__x")).agg(F.array_distinct(F.coalesce(F.percentile_approx("__x", at, F.lit(10_000)), F.array())).alias("__bounds"))
    number = F.coalesce(2 * F.size(F.filter("__bounds", lambda b: b < x)) + F.array_contains("__bounds", x).cast("int"), F.lit(-1))
    return df.join(F.broadcast(bounds)).withColumn(name, number).drop("__bounds")  # one row


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joined on keys, nulls equal; the right side's keys go."""
    renamed = right.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(keys)})
    if not keys:
        return left.join(F.broadcast(renamed))  # keys are missing only where the right side is one row
    on = [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, on, how).drop(*[f"__r{i}" for i in range(len(keys))])


def _offsets(df: DataFrame, keys: Sequence[str], ranges: Sequence[str], n: Column) -> DataFrame:
    """keys, ranges, __count of a range, __before of all earlier ones and __total of the group."""
    counts = df.groupBy(*keys, *ranges).agg(n.alias("__count"))
    group = W.partitionBy(*[F.col(k) for k in keys])
    before = F.sum("__count").over(group.orderBy(*ranges).rowsBetween(W.unboundedPreceding, -1))
    return counts.select(*keys, *ranges, "__count", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__count").over(group).alias("__total"))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, parts: int = PARTS, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """keys, value, n and below: each different value of a group with its rows and the rows of smaller ones; null is the smallest.

    sums are further aggregates of a value's rows, by name.
    """
    more = [c.alias(name) for name, c in (sums or {}).items()]
    counts = with_range(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), *more), value, parts=parts)
    offsets = _offsets(counts, keys, ["__b"], F.sum("__n")).select(*keys, "__b", "__before")
    inside = W.partitionBy(*keys, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.withColumn("__below", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    met = null_safe(ranked, offsets, [*keys, "__b"])
    return met.select(*keys, value, F.col("__n").alias("n"), (F.col("__below") + F.col("__before")).alias("below"), *(sums or ()))


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """df with ranks from 1, ties averaged."""
    ranks = value_ranks(df, keys, value).select(*keys, value, (F.col("below") + (F.col("n") + 1) / 2.0).alias(name))
    return null_safe(df, ranks, [*keys, value])


def dense_ranks(df: DataFrame, value: str, name: str, start: int = 0) -> DataFrame:
    """value and its number among the different values, in their order; null has none."""
    found = df.select(value).where(F.col(value).isNotNull()).distinct()
    return value_ranks(found, [], value).select(value, (F.col("below") + start).cast("long").alias(name))


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str | tuple[str, bool]], name: str, parts: int = PARTS) -> DataFrame:
    """df with each row's place in its group, from 0, in the order of columns, (column, True) for descending; nulls come first.

    Ties of the first column that are many are cut into ranges by the second. Rows equal in all columns of the order are
    numbered in any order.
    """
    by = [(c, False) if isinstance(c, str) else c for c in order]
    (first, down), ranges = by[0], ["__b"]
    out = with_range(df, first, "__b", parts, down)
    injective = _number(F.col(first), df.schema[first].dataType)[1]
    if len(by) > 1 and injective:
        out = with_range(out, by[1][0], "__b2", parts, by[1][1]).withColumn("__b2", F.when(F.col("__b") % 2 == 1, F.col("__b2")).otherwise(0))
        ranges.append("__b2")
    offsets = _offsets(out, keys, ranges, F.count(F.lit(1))).select(*keys, *ranges, "__before")
    sort = [F.desc_nulls_first(c) if d else F.asc_nulls_first(c) for c, d in by]
    inside = F.row_number().over(W.partitionBy(*keys, *ranges).orderBy(*sort)) - 1
    met = null_safe(out.withColumn("__inside", inside), offsets, [*keys, *ranges])
    return met.select(*df.columns, (F.col("__inside") + F.col("__before")).cast("long").alias(name))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], name: str = "quantiles", parts: int = PARTS) -> DataFrame:
    """keys and an array of the quantiles of value, interpolated linearly between rows; nulls are left out.

    Two passes: ranges are counted, then only the ranges that hold a wanted rank are read, their equal values counted first.
    A group without values has no row.
    """
    rows = with_range(df.where(F.col(value).isNotNull()).select(*keys, value), value, parts=parts)
    offsets = _offsets(rows, keys, ["__b"], F.count(F.lit(1)))
    place = [F.lit(float(q)) * (F.col("__total") - 1) for q in at]
    low, high = [F.floor(p) for p in place], [F.ceil(p) for p in place]
    holds = lambda r, begin, n: (r >= begin) & (r < begin + n)
    wanted = F.lit(False)
    for r in (*low, *high):
        wanted = wanted | holds(r, F.col("__before"), F.col("__count"))
    needed = null_safe(rows, offsets.where(wanted).drop("__count"), [*keys, "__b"])
    counts = needed.groupBy(*keys, "__b", "__before", "__total", value).agg(F.count(F.lit(1)).alias("__n"))
    inside = W.partitionBy(*keys, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("__begin", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    pick = lambda r: F.max(F.when(holds(r, F.col("__begin"), F.col("__n")), F.col(value).cast("double")))
    found = placed.groupBy(*keys, "__total").agg(*[pick(r).alias(f"__{side}{i}") for side, of in (("l", low), ("h", high)) for i, r in enumerate(of)])
    between = [F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * (p - F.floor(p)) for i, p in enumerate(place)]
    return found.select(*keys, F.array(*between).alias(name))
