"""SimHash near-duplicates, linked by multi-index hashing.

Fingerprints of 64 bits are cut into two segments. By the pigeonhole principle two fingerprints at 2 or fewer differing
bits agree in the low segment, or differ in one bit at most of the high one; so each fingerprint looks up the
radius-1 ball of its high segment and its low segment itself in a table of segments, and complete distances are
verified. Crowded segments are not paired: their fingerprints go through balls of the complete fingerprint instead,
which is as exact: two fingerprints are at 2 or fewer bits if and only if balls of radius 1 around them meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, materialize
from .components import components

RADIUS = 2
SEGMENT_BITS = 32
#: Fingerprints of a segment's value up to which they are paired.
CROWDED = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: set where over half of the shingles' XXH64 have them; 0 without words. text: UTF-8."""
    words = text.translate(_LOWER).split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)) if n > 0 else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(n, 1))
    return fingerprint_of(hashes)


def fingerprint_of(hashes: np.ndarray) -> int:
    """64 bits: set where over half of the unsigned hashes have them; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((simhash(x or b"") for x in batch["__text"].to_pylist()), np.uint64, batch.num_rows)
        keep = [batch[c] for c in batch.schema.names if c != "__text"]
        names = [c for c in batch.schema.names if c != "__text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(found.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), fp (the fingerprint as a signed long) of every row."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("__text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, th bigint, fp bigint")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def mih_links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links that connect what distances of 2 or fewer bits connect. fps: one column fp, distinct longs.

    A pair that differs in the looked-up bit is found from the side that has it 0, so half a ball is enough.
    """
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    segments = lambda values: F.explode(F.array(*[F.struct(F.lit(s).alias("s"), v.alias("v")) for s, v in enumerate(values)]))
    table = fps.select("fp", segments([low, high]).alias("k")).select("fp", "k.s", "k.v")
    sizes = table.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n"))
    light = table.join(sizes.where(F.col("n").between(1, crowded)), ["s", "v"]).select("s", "v", F.col("fp").alias("b"))
    crowds = sizes.where(F.col("n") > crowded).select("s", "v", F.lit(None).cast("long").alias("b"))
    flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda i: F.when(F.expr("0L") == F.getbit(high, i), high.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))), lambda x: x.isNotNull())
    ball = F.concat(F.array(F.struct(F.lit(0).alias("s"), low.alias("v")), F.struct(F.lit(1).alias("s"), high.alias("v"))), F.transform(flips, lambda v: F.struct(F.lit(1).alias("s"), v.alias("v"))))
    probes = fps.select(F.col("fp").alias("a"), F.explode(ball).alias("k")).select("a", "k.s", "k.v")
    found = materialize(probes.join(light.union(crowds), ["s", "v"]).where(F.col("b").isNull() | ((F.col("a") != F.col("b")) & (_distance("a", "b") <= RADIUS))).select("a", "b"), "probes")
    paired = found.where(F.col("b").isNotNull())
    # Fingerprints that looked into a crowd: their balls of radius 1 meet where they are linked. At most 65 share a point.
    points = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    crowd = found.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    met = crowd.select("fp", F.explode(points).alias("p")).groupBy("p").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return paired.union(met.select(F.explode("all").alias("a"), "b").where("a <> b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp, component_id (the least doc_id reachable), group (the least fingerprint reachable) of every row.

    Texts without words have fingerprint 0 and are linked like any other; null texts have none. Repeated rows share a
    component. Only doc_id and text are read.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    roots = materialize(components(mih_links(classes.select("fp"))), "roots")
    linked = classes.join(roots, F.col("fp") == F.col("node")).select("fp", "first", "root")
    least = linked.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least"))
    named = linked.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "least")
    named = classes.join(named, F.col("fp") == F.col("f"), "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"), F.coalesce("root", "fp").alias("group"))
    return join_hot(rows, materialize(named, "named"), "fp", "n")


def hex_fingerprint(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, all its columns: the one with the least doc_id."""
    return keep_least(docs, near_duplicates(docs))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of each group with the least doc_id; found: doc_id, th and group of docs' rows.

    Among rows with that doc_id the least text hash decides, among equal rows any one stays.
    """
    kept = found.groupBy("group").agg(F.min(F.struct("doc_id", "th")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.th").alias("__th"))
    here = docs.withColumn("__own", F.xxhash64("text"))
    here = here.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th")), "left_semi")
    return here.dropDuplicates(["doc_id", "__own"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")
