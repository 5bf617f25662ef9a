"""Splits of rows by whole groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import with_position


def _forbidden(places: list[tuple[int, int]], groups: int, held: int, both: bool) -> list[tuple[int, int]]:
    """Window starts, from and up to, at which a class is missing outside of the window or, with both, inside.

    places: blocks of a class' places in order, first and last. A window of `held` places from s on is the side held out; places go
    around. Between neighbours p and q of a class, all of it is inside from p + groups - held + 1 to q, and none from p + 1 to q - held.
    """
    out = []
    for (_, p), (q, _) in zip(places, [*places[1:], (places[0][0] + groups, 0)], strict=True):
        out.append((p + groups - held + 1, q))
        if both:
            out.append((p + 1, q - held))
    return [(a % groups, b - a) for a, b in out if a <= b]


def _first_start(forbidden: list[tuple[int, int]], groups: int) -> int | None:
    """The smallest start that no interval (start, length - 1, going around) holds."""
    flat = sorted((a, min(a + n, groups - 1)) for a, n in forbidden) + sorted((0, a + n - groups) for a, n in forbidden if a + n >= groups)
    start = 0
    for a, b in sorted(flat):
        if a > start:
            break
        start = max(start, b + 1)
    return start if start < groups else None


def split_groups(df: DataFrame, group: str, label: str, fraction: float, both: bool = False, seed: int = 42, name: str = "held_out") -> DataFrame:
    """df with a flag: whole groups held out, about `fraction` of them, so that every class remains in the rest.

    Groups stand in the order of md5(seed:group). A window of round(fraction * groups) of them, one at least and all but one at most,
    is held out: the first that leaves every class outside, and with both has every class inside as well. Where no window does, the
    first one is taken; with both, the first that leaves every class outside, or else nothing is held out. A single
    group is not held out. Rows without a label count for no class; a null group is a group.

    The same rows give the same split on any partitioning. Groups are never gathered: a class' places reach the driver as blocks
    half as long as a gap that could matter, 4 / min(fraction, 1 - fraction) a class at most.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__g").cast("string"), F.lit("")))
    names = df.select(F.col(group).alias("__g")).distinct().withColumn("__h", F.md5(key.cast("binary")))
    placed = with_position(names, [], ["__h", "__g"], "__place")
    groups = placed.count()
    held = min(max(1, int(fraction * groups + 0.5)), groups - 1)
    if groups < 2:
        return df.withColumn(name, F.lit(False))
    block = max(1, min(held, groups - held) // 2)
    classes = df.where(F.col(label).isNotNull()).select(F.col(group).alias("__g"), F.col(label).alias("__c")).distinct()
    on = F.col("__g").eqNullSafe(F.col("__o"))
    spans = classes.join(placed.select(F.col("__g").alias("__o"), "__place"), on).groupBy("__c", F.floor(F.col("__place") / block).alias("__k"))
    places: dict[object, list[tuple[int, int]]] = {}
    for r in sorted(spans.agg(F.min("__place").alias("a"), F.max("__place").alias("b")).collect(), key=lambda r: r["a"]):
        places.setdefault(r["__c"], []).append((r["a"], r["b"]))
    start = _first_start([x for p in places.values() for x in _forbidden(p, groups, held, both)], groups)
    if start is None and both:
        start = _first_start([x for p in places.values() for x in _forbidden(p, groups, held, False)], groups)
        if start is None:
            return df.withColumn(name, F.lit(False))
    inside = F.pmod(F.col("__place") - (start or 0), F.lit(groups)) < held
    flags = placed.select(F.col("__g").alias("__o"), inside.alias(name))
    return df.join(flags, F.col(group).eqNullSafe(F.col("__o"))).drop("__o")
