"""Documents whose sets of word shingles have a Jaccard similarity from a threshold on, found exactly.

Fingerprints of 64 bits differ in about ten at a similarity of 0.8, too many for balls of segments. So multi-index hashing
(`simhash.mih_links`) only finds the closest pairs here, which are most of the links in large groups, and prefix filtering
finds the rest.

Two sets with similarity t or more share one of the first n - ceil(t * n) + 1 hashes of each (its prefix), in any order
that holds for all sets. Here common hashes come last, so that prefixes rarely meet in a passage that many texts have;
which ones count as common is found on a sample, as it changes the work but not the result. Sets that share none are never compared, and pairs that do are verified on all their shingles. What counts is who is connected:
first each member of a prefix hash meets one leader of it, then all members that are not connected yet meet. A pair is
compared if its prefixes have so many hashes in common that both sets can: what lies behind the prefix of one of the two
is all that can be added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize, slices
from .components import components
from .simhash import fingerprint_of, keep_least, mih_links

SHINGLE = 5
SIMILARITY = 0.8
#: Rounds in which members of a prefix hash meet only its leader; the result is the same without them.
STAR_ROUNDS = 1
#: Of so many sets one is read for common hashes; those that over COMMON of them have are common, MOST at most.
SAMPLE = 32
COMMON = 4
MOST = 100_000
#: Against rounding: products with the threshold may be this much off.
_SLACK = 1e-9
#: Of shingles' hashes: the polynomial's odd base, whose powers differ in their low bits, and an odd factor that spreads high bits.
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C13), np.uint64(0xBF58476D1CE4E5B9)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles as signed longs, ascending; a text with fewer words is one shingle.

    Each word is hashed once (XXH64); a shingle's hash is a polynomial of those of its words, mixed.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(max(1, len(words) - shingle + 1), np.uint64)
    for i in range(min(shingle, len(words))):
        out = (out + hashes[i : i + len(out)]) * _BASE
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique((out ^ (out >> np.uint64(29))).view(np.int64))


def among(g: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of some hashes are common; common: ascending. They are looked up, so that a set costs hardly more where many are common."""
    if not len(common):
        return np.zeros(len(g), bool)
    return common[np.minimum(np.searchsorted(common, g), len(common) - 1)] == g


def _sets(shingle: int):
    """sid (a hash of the set) and grams of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(x or b"", shingle) for x in batch["text"].to_pylist()]
            ids = np.fromiter(map(_sid, found), np.uint64, len(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found, pa.list_(pa.int64()))], names=["sid", "grams"])

    return run


def _sid(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes())


def _prefixes(shared: object, shingle: int, similarity: float):
    """Of each text the hash of its set, its fingerprint, the set's size and its prefix: common hashes come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in slices(batches):
            ids, prints, sizes, out = [], [], [], []
            for text in batch["text"].to_pylist():
                g = shingle_set(text or b"", shingle)
                last = among(g, common)
                ids.append(_sid(g))
                prints.append(fingerprint_of(g.view(np.uint64)))
                sizes.append(len(g))
                out.append(np.concatenate((g[~last], g[last]))[: len(g) - math.ceil(len(g) * similarity - _SLACK) + 1] if len(g) else g)
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, prints)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], *longs, pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "th", "sid", "fp", "size", "prefix"])

    return run


def _fits(similarity: float, a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be so similar."""
    return F.least(a, b) >= F.greatest(a, b) * similarity - _SLACK


def _named(key: Column) -> Column:
    """An id as text that no null equals: ids that are null meet, too."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))


def _verified(pairs: DataFrame, chosen: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar enough, by the sets of their texts: only those in a pair are made. chosen: sid and a row
    that has its text; sets that are not there are in no such pair."""
    pairs = materialize(pairs.select("a", "b").distinct(), "candidates")
    asked = pairs.select(F.col("a").alias("sid")).union(pairs.select("b"))
    wanted = chosen.join(asked, "sid", "left_semi").select("__k", "th")
    # One row a set: repeated rows are dropped where the join has brought them, by its own keys, which are never null.
    found = texts.withColumn("__k", _named(F.col("doc_id"))).join(wanted, ["__k", "th"], "left_semi").dropDuplicates(["__k", "th"]).select("text")
    sets = materialize(found.mapInArrow(_sets(shingle), "sid bigint, grams array<bigint>"), "sets")
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs"))
    left = materialize(counts.join(sets, F.col("a") == F.col("sid")).select("a", "pairs", F.col("grams").alias("left")), "left-sets")
    right = pairs.join(sets, F.col("b") == F.col("sid")).select("a", "b", F.col("grams").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - both
    similar = materialize(join_hot(right, left, "a", "pairs").where(both >= union * similarity - _SLACK).select("a", "b"), "similar")
    discard(pairs, sets, left)
    return similar


def _close(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sids whose fingerprints are at most two bits apart: within a fingerprint, and between two, by their least sids."""
    sids = materialize(rows.where("size > 0").groupBy("fp", "sid").agg(F.count(F.lit(1)).alias("n")).drop("n"), "prints")
    classes = materialize(sids.groupBy("fp").agg(F.min("sid").alias("least"), F.count(F.lit(1)).alias("n")), "print-classes")
    links = mih_links(classes.select("fp"))
    least = classes.select(F.col("fp").alias("f"), "least")
    across = links.join(least, F.col("a") == F.col("f")).select("b", F.col("least").alias("x")).join(least, F.col("b") == F.col("f")).select(F.col("x").alias("a"), F.col("least").alias("b"))
    several = sids.join(classes.where("n > 1").select("fp", "least"), "fp").where("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    return across.union(several)


def _behind(size: Column, similarity: float) -> Column:
    """Hashes of a set behind its prefix."""
    return F.ceil(size * similarity - _SLACK) - 1


def _needed(both: Column, similarity: float) -> Column:
    """Hashes that two sets must share, by the sum of their sizes."""
    return F.ceil(both * (similarity / (1 + similarity)) - _SLACK)


def similar_roots(rows: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root): the least sid that each connected set reaches. rows: what _prefixes gives; texts: doc_id, th and text of the same rows."""
    once = rows.where("size > 0").groupBy("sid").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    ordered = materialize(once, "ordered")
    prefix = ordered.select("sid", "size", F.explode("prefix").alias("key"))
    shared = materialize(prefix.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    keys = materialize(join_hot(prefix, shared, "key", "n"), "prefixes")
    discard(ordered, shared)
    # Sets that share too few hashes of their prefixes with all others together are similar to none. Of the rest those in a pair are read.
    least = _needed(F.col("size") + F.ceil(F.col("size") * similarity - _SLACK), similarity)
    most = F.floor(F.col("size") / similarity + _SLACK)
    able_sids = keys.groupBy("sid").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size")).where(F.col("c") >= least - _behind(most, similarity)).select("sid")
    chosen = rows.groupBy("sid").agg(F.min(F.struct("doc_id", "th")).alias("k")).join(able_sids, "sid")  # a row a set, before rows of one set meet
    chosen = materialize(chosen.select("sid", _named(F.col("k.doc_id")).alias("__k"), F.col("k.th").alias("th")), "chosen")
    verified = lambda pairs: _verified(pairs, chosen, texts, shingle, similarity)
    links = verified(_close(rows))
    nodes = None

    def connect() -> DataFrame:
        nonlocal nodes
        old, roots = nodes, materialize(components(links), "roots")
        named = keys.join(roots, F.col("sid") == F.col("node"), "left").select("key", "sid", "size", F.coalesce("root", "sid").alias("root"))
        # A hash whose members are all connected has nothing left to tell.
        open_ = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "n")
        left = materialize(open_, "open")
        nodes = materialize(join_hot(named, left, "key", "n"), "members")
        discard(left, roots, *[old] * (old is not None))

    def able(met: DataFrame) -> DataFrame:
        """Of pairs, one row a hash in both prefixes, those that can be similar enough: the hashes of the prefix that ends first
        and lie in the other set lie in its prefix, so beyond these only what is behind a prefix can be shared."""
        need = _needed(F.col("m") + F.col("n"), similarity)
        counted = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("m").alias("m"), F.first("n").alias("n"))
        return counted.where(_fits(similarity, F.col("m"), F.col("n")) & (F.col("c") >= need - _behind(F.greatest("m", "n"), similarity)))

    connect()
    for r in range(STAR_ROUNDS):
        lead = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("sid", F.lit(r)).alias("h"), "sid", "size", "root")).alias("l"))
        leaders = materialize(lead, "leaders")
        met = join_hot(nodes, leaders, "key", "n").where(F.col("root") != F.col("l.root"))
        found = verified(able(met.select(F.col("l.sid").alias("a"), F.col("sid").alias("b"), F.col("l.size").alias("m"), F.col("size").alias("n"))))
        links = links.union(found)
        discard(leaders)
        connect()
    one, two = (nodes.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("sid", "size", "root")]) for i in (1, 2))
    met = one.join(two, "key").where((F.col("sid1") < F.col("sid2")) & (F.col("root1") != F.col("root2")) & _fits(similarity, F.col("size1"), F.col("size2")))
    found = verified(able(met.select(F.col("sid1").alias("a"), F.col("sid2").alias("b"), F.col("size1").alias("m"), F.col("size2").alias("n"))))
    discard(keys, nodes, chosen)
    return materialize(components(links.union(found)), "roots")


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, th (a hash of the text), group (equal where similar pairs connect) of every row.

    Texts without words, null ones among them, are one group; an empty table gives no rows; a very long text is one set, in one
    row. Only doc_id and text are read. Sets, prefixes and links are written to the shared folder when this is called.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    some = texts.where(F.pmod(F.xxhash64("th"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sets(shingle), "sid bigint, grams array<bigint>")
    some = some.select(F.explode("grams").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    common = np.sort(some.where(F.col("n") > COMMON).orderBy(F.desc("n"), "key").limit(MOST).select("key").toArrow()["key"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(common)
    rows = materialize(texts.mapInArrow(_prefixes(shared, shingle, similarity), f"doc_id {kind}, th bigint, sid bigint, fp bigint, size int, prefix array<bigint>"), "prefixes-of-rows")
    classes = rows.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    roots = similar_roots(rows, texts, shingle, similarity)
    named = classes.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "n", F.coalesce("root", "sid").alias("group"))
    named = materialize(named, "named")
    groups = materialize(join_hot(rows.select("doc_id", "th", "sid"), named, "sid", "n").select("doc_id", "th", "group"), "groups")
    discard(rows, named, roots)
    return groups


def keep_one_similar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of similar ones, all its columns: the one with the least doc_id."""
    return keep_least(docs, similar_groups(docs, shingle, similarity))
