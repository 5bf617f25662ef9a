"""What a table must be before anything is trained on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import with_position


def _row_number(columns: Sequence[str]) -> Column:
    """60 bits of the row's md5: values as text, in the given order, nulls apart from every text."""
    escaped = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    text = F.concat_ws("|", *[F.coalesce(escaped(c), F.lit("\\0")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def checksum(columns: Sequence[str]) -> tuple[Column, Column]:
    """Aggregates of a table that no order changes: sum and exclusive or of its rows' numbers.

    Both add up over parts of a table. A changed or lost row changes both, a doubled one too: what one of them might hide, as
    the other row of a pair does in the exclusive or, the other shows.
    """
    number = _row_number(columns)
    return F.coalesce(F.sum(number.cast("decimal(38,0)")).cast("string"), F.lit("0")), F.coalesce(F.bit_xor(number), F.lit(0).cast("long"))


@dataclass(frozen=True)
class Contract:
    """What must hold. types: columns by their simple types. constants: columns with one value. enums: values allowed.
    ranges: least and most. widths: length of arrays. finite: arrays or numbers without null, NaN or infinite values. unique: keys. rows and
    checksum (sum, xor over `summed`): of the whole table.
    """

    types: Mapping[str, str] = field(default_factory=dict)
    required: Sequence[str] = ()
    constants: Mapping[str, object] = field(default_factory=dict)
    enums: Mapping[str, Sequence[object]] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    widths: Mapping[str, int] = field(default_factory=dict)
    finite: Sequence[str] = ()
    unique: Sequence[str] = ()
    rows: int | None = None
    summed: Sequence[str] = ()
    checksum: tuple[str, int] | None = None


def _breaks(df: DataFrame, c: Contract) -> dict[str, Column]:
    """By rule, whether a row breaks it."""
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    array = lambda n: df.schema[n].dataType.typeName() == "array"
    rules = {f"required {n}": F.col(n).isNull() for n in c.required}
    rules |= {f"constant {n}": ~F.col(n).eqNullSafe(F.lit(v)) for n, v in c.constants.items()}
    rules |= {f"enum {n}": F.col(n).isNotNull() & ~F.col(n).isin(list(v)) for n, v in c.enums.items()}
    rules |= {f"range {n}": ~F.col(n).between(*v) for n, v in c.ranges.items()}
    rules |= {f"width {n}": ~F.coalesce(F.size(n), F.lit(-1)).eqNullSafe(F.lit(v)) for n, v in c.widths.items()}
    rules |= {f"finite {n}": ~F.coalesce(F.forall(n, number) if array(n) else number(F.col(n)), F.lit(False)) for n in c.finite}
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def check(df: DataFrame, c: Contract) -> DataFrame:
    """rule, expected, found, ok: a row a rule. Rows that break a rule are counted, all rules in one aggregation; keys in another.

    A missing column, or one of another type, breaks its type, and rules that need it count as broken by all rows.
    """
    kinds = dict(df.dtypes)
    found_types = [(f"type {n}", t, kinds.get(n, "missing"), kinds.get(n) == t) for n, t in c.types.items()]
    lacking = sorted({n for group in (c.required, c.constants, c.enums, c.ranges, c.widths, c.finite, c.unique, c.summed) for n in group} - set(kinds))
    have = lambda group: {n: v for n, v in group.items() if n in kinds} if isinstance(group, Mapping) else [n for n in group if n in kinds]
    whole = not [n for n in c.summed if n not in kinds]
    able = Contract(c.types, have(c.required), have(c.constants), have(c.enums), have(c.ranges), have(c.widths), have(c.finite), have(c.unique), c.rows, c.summed, c.checksum)
    rules = _breaks(df, able)
    added, xored = checksum(able.summed) if able.summed and whole else (F.lit(None).cast("string"), F.lit(None).cast("long"))
    counts = df.agg(F.count(F.lit(1)).alias("n"), added.alias("added"), xored.alias("xored"), *[F.count(F.when(v, 1)).alias(f"b{i}") for i, v in enumerate(rules.values())])
    line = lambda rule, want, got, ok: F.struct(F.lit(rule).alias("rule"), want.cast("string").alias("expected"), got.cast("string").alias("found"), ok.alias("ok"))
    lines = [line(r, F.lit(0), F.col(f"b{i}"), F.col(f"b{i}") == 0) for i, r in enumerate(rules)]
    lines += [line(r, F.lit(want), F.lit(got), F.lit(ok)) for r, want, got, ok in found_types]
    lines += [line(f"column {n}", F.lit("there"), F.lit("missing"), F.lit(False)) for n in lacking]
    if c.rows is not None:
        lines.append(line("rows", F.lit(c.rows), F.col("n"), F.col("n") == c.rows))
    if c.summed and whole:
        mark = F.concat_ws(":", "added", F.col("xored").cast("string"))
        expected = F.lit(f"{c.checksum[0]}:{c.checksum[1]}") if c.checksum else mark
        lines.append(line("checksum", expected, mark, mark == expected))
    if able.unique and len(able.unique) == len(c.unique):
        doubled = df.groupBy(*c.unique).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("doubled"))
        counts = counts.join(F.broadcast(doubled))  # one row each
        lines.append(line(f"unique {', '.join(c.unique)}", F.lit(0), F.col("doubled"), F.col("doubled") == 0))
    return counts.select(F.explode(F.array(*lines)).alias("x")).select("x.*") if lines else df.sparkSession.createDataFrame([], "rule string, expected string, found string, ok boolean")


def enforce(df: DataFrame, c: Contract) -> DataFrame:
    """df, after its contract was checked: a ValueError names each rule that does not hold."""
    broken = check(df, c).where("NOT ok OR ok IS NULL").orderBy("rule").collect()  # a row a rule
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: expected {r['expected']}, found {r['found']}" for r in broken))
    return df


def stratified_subsample(df: DataFrame, label: str, key: Sequence[str], most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows, from each class in proportion to its size, one at least; rows without a label go.

    A class gives round(most * share) rows, the first by md5(seed:key); if that is too many in all, the first `most` of them by the same
    order stay. Tables of at most `most` rows stay whole. Classes of any size: no task sorts one.
    """
    name = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).cast("binary"))
    rows = df.where(F.col(label).isNotNull()).withColumn("__h", F.conv(F.substring(name, 1, 15), 16, 10).cast("long"))
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    shares = sizes.join(F.broadcast(sizes.agg(F.sum("__n").alias("__all"))))  # one row
    quota = F.greatest(F.lit(1), F.bround(most * F.col("__n") / F.col("__all")).cast("long"))
    quotas = shares.select(F.col(label).alias("__l"), F.when(F.col("__all") <= most, F.col("__n")).otherwise(F.least("__n", quota)).alias("__q"), "__all")
    placed = with_position(rows, [label], ["__h", *key], "__p").join(quotas, F.col(label) == F.col("__l")).where("__p < __q").drop("__p", "__l", "__q")
    kept = with_position(placed, [], ["__h", *key], "__p").where((F.col("__p") < most) | (F.col("__all") <= most))
    return kept.select(*df.columns)
