"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only in local mode, where it is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{sc.applicationId}"


#: Spark's setting by which the shuffle files of a query go when it has ended, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, lineage cut, safe from lost executors.

    The tables of one application share a folder named after its id, which may go when it has ended. The shuffle files of
    the write go with it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidewatch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote: for tables from which nothing is computed any more, as what was is written itself."""
    for table in tables:
        place = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.tidewatch_path)
        place.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows: what is made of a text may be as large as the text, and a worker has little memory.

    After the last, memory that is free goes back to the system: workers wait for their next task beside others.
    """
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
    batch = None  # noqa: F841
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_scan(df: DataFrame, values: str, name: str, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """df with the states of a fold over an array, before each element: start, step(start, first), and so on.

    States are gathered in blocks of about the root of their number, as a growing array is copied at each element. The
    parts are columns of their own: deeply nested lambdas are slow to analyse.
    """
    none = F.slice(F.array(start), 1, 0)
    n = F.size(values)
    block = lambda k: F.slice(values, k * F.col("__width") + 1, F.col("__width"))

    def gather(over: Column, first: Column, move: Callable[[Column, Column], Column]) -> Column:
        grow = lambda a, x: F.struct(move(a["s"], x).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out"))
        return F.aggregate(over, F.struct(first.alias("s"), none.alias("out")), grow, lambda a: a["out"])

    df = df.withColumn("__width", F.greatest(F.lit(16), F.ceil(F.sqrt(n)).cast("int")))
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / F.col("__width")).cast("int") - 1))
    df = df.withColumn("__heads", gather(numbers, start, lambda s, k: F.aggregate(block(k), s, step)))
    return df.withColumn(name, F.flatten(F.transform("__heads", lambda s, k: gather(block(k), s, step)))).drop("__width", "__heads")


#: Code points of a block from which pieces of a text are taken, a power of two.
_BLOCK_BITS = 14


def pieces_of(text: Column, spans: Column) -> Column:
    """The parts of a text between code points start and end of each span; the text is walked block by block, not span by span."""
    width = 1 << _BLOCK_BITS
    last = F.greatest(F.lit(0), F.shiftright(F.length(text) - 1, _BLOCK_BITS))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * width + 1, F.lit(width)))

    def piece(b: Column, s: Column) -> Column:
        start, end = s["start"].cast("int"), s["end"].cast("int")
        i, j = F.shiftright(start, _BLOCK_BITS), F.shiftright(end, _BLOCK_BITS)
        head, tail = start - i * width, end - j * width
        between = F.array_join(F.slice(b, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        over = F.concat(F.substr(F.get(b, i), head + 1, F.lit(width)), between, F.coalesce(F.substr(F.get(b, j), F.lit(1), tail), F.lit("")))
        return F.when(i == j, F.substr(F.get(b, i), head + 1, tail - head)).otherwise(over)

    return let(blocks, lambda b: F.transform(spans, lambda s: piece(b, s)))


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def bucket(column: Column, modulus: int) -> Column:
    """crc32 of a value as text, mod modulus; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def rank_rows(df: DataFrame, group: Sequence[str], name: str, spread: int = 64, by: Column | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in an order that only the rows' values decide.

    Rows are spread over `spread` hash buckets a group, so no task sees a whole group; equal rows are
    counted before they are shuffled and expanded after they have their numbers. The offsets table has
    spread rows a group: callers group by a bounded number of values. by: the bucket, 0 to spread - 1, in whose
    order the rows go; a hash of the row where none is given.
    """
    cols = df.columns
    parts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", (F.pmod(F.xxhash64(*cols), F.lit(spread)) if by is None else by).cast("int"))
    inside = W.partitionBy(*group, "__b").orderBy(*[F.col(c) for c in cols])
    parts = parts.withColumn("__to", F.sum("__n").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    sums = parts.groupBy(*group, "__b").agg(F.sum("__n").alias("__sum"))
    before = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__b").alias("__ob"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__off"))
    on = F.col("__b") == F.col("__ob")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    start = F.col("__off") + F.col("__to") - F.col("__n")
    chunk = 10_000
    ranked = parts.join(F.broadcast(offsets), on).withColumn("__start", start)
    ranked = ranked.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("__n") - 1) / chunk).cast("long"))))
    ranked = ranked.withColumn(name, F.explode(F.sequence(F.col("__start") + F.col("__c") * chunk, F.col("__start") + F.least(F.col("__n"), (F.col("__c") + 1) * chunk) - 1)))
    return ranked.select(*cols, name)


#: A key with this share of the rows, or more, is joined by broadcast: there are no more such keys than this.
HOT_SHARE = 10_000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined on key with keyed, which holds each key once and in n how many rows have it; n goes.

    Keys with one in HOT_SHARE of the rows that keyed counts are HOT_SHARE at most, so they are broadcast and their rows stay
    where they are; all others meet in a shuffle. Both should be cheap to read again.
    """
    total = int(keyed.agg(F.sum(n)).first()[0] or 0)
    hot = F.col(n) * HOT_SHARE >= total
    few = F.broadcast(keyed.where(hot).drop(n).limit(HOT_SHARE))
    here = rows.join(few, key)
    rest = rows.join(few.select(key), key, "left_anti").join(keyed.where(~hot).drop(n), key)
    return here.unionByName(rest)
