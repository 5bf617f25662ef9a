"""Periodic runs of words: where a text says the same stretch over and over, whatever the length of the stretch.

Every run of period p that is at least two periods long covers a point jp of the grid of multiples of p together with its
successor (j+1)p, so the longest common extensions of these pairs, forward and backward, find all runs: n ln n pairs a text
in all. An extension is the minimum of neighbours' common prefixes between two ranks of a suffix array, from a table of
minima over powers of two; backward ones come from the array of the reversed words. Texts are independent: Spark
partitions them, and a task works on a few hundred thousand words at a time, with arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, words_of


@dataclass(frozen=True)
class RunConfig:
    #: Words of the shortest run; a run also has at least two periods.
    min_words: int = 12
    #: Words after which the texts gathered are worked on; a longer text is worked on alone, with about 300 bytes a word.
    unit_words: int = 200_000
    #: Grid pairs looked at together.
    block_pairs: int = 1 << 21


def _suffixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's rank, and of each rank the common prefix with the rank before. The last symbol must occur once.

    Ranks double in depth; a rank is the number of smaller suffixes as far as told apart, so only groups still equal are
    sorted again. Two suffixes' common prefix is read off the depths, largest first.
    """
    n = len(symbols)
    _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    depths, active, h = [rank.astype(np.int32)], np.flatnonzero(counts[inverse] > 1), 1
    while len(active):
        keys = rank[active] * (n + 1) + rank[active + h]
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
        old = sorted_keys // (n + 1)
        place = np.arange(len(keys))
        first = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        begin = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[active[order]] = old + begin - first
        size = np.diff(np.r_[np.flatnonzero(new), len(keys)])
        active = np.sort(active[order][np.repeat(size, size) > 1])
        depths.append(rank.astype(np.int32))
        h *= 2
    by_rank = np.empty(n, np.int64)
    by_rank[rank] = np.arange(n)
    a, b, common = by_rank[:-1].copy(), by_rank[1:].copy(), np.zeros(n - 1, np.int64)
    for k in range(len(depths) - 1, -1, -1):
        step = np.where(depths[k][a] == depths[k][b], 1 << k, 0)
        a, b, common = a + step, b + step, common + step
    return rank, np.r_[0, common].astype(np.int32)


def _extensions(symbols: np.ndarray, longest: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The longest common extension of pairs of different positions that lie in one text of at most so many words."""
    rank, common = _suffixes(symbols)
    minima = [common]
    for k in range(max(longest, 1).bit_length()):
        last, width = minima[-1], 1 << k
        if width >= len(common):
            break
        minima.append(np.r_[np.minimum(last[:-width], last[width:]), last[-width:]])
    table = np.stack(minima)

    def extend(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = rank[i], rank[j]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(table[k, low], table[k, high - (1 << k) + 1]).astype(np.int64)

    return extend


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _grid(starts: np.ndarray, lengths: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs jp and (j+1)p of all texts and periods, as positions and periods, about so many at a time."""
    halves = lengths // 2
    periods = _ranges(halves) + 1
    base = np.repeat(starts, halves)
    counts = (np.repeat(lengths, halves) - 1) // periods
    ends = np.cumsum(counts)
    a = 0
    while a < len(periods):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - counts[a] + block, "right")))
        p = np.repeat(periods[a:b], counts[a:b])
        yield np.repeat(base[a:b], counts[a:b]) + _ranges(counts[a:b]) * p, p
        a = b


def find_runs(words: np.ndarray, lengths: np.ndarray, cfg: RunConfig) -> np.ndarray:
    """Runs of texts whose words are numbers, one text after the other: rows of text, start, length, period, in this order.

    Words are told apart within a text only. Pairs whose words around the grid point can't hold a run are left out by a
    hash of a quarter of the shortest run, before and behind; texts in which no such hash occurs twice by the same rule.
    """
    some = max(1, -(-cfg.min_words // 4))
    none = np.zeros((0, 4), np.int64)
    texts = np.flatnonzero(lengths >= max(cfg.min_words, 2))
    starts = np.cumsum(lengths) - lengths
    if not len(texts):
        return none
    mixed = np.zeros(len(words) + some, np.uint64)
    for k in range(some):  # a polynomial of the next words; those behind a text's end only let a pair through
        mixed[: len(words)] += np.roll(words, -k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 ** (k + 1) % (1 << 64))
    mixed ^= mixed >> np.uint64(29)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    both = mixed[: len(words)] * np.uint64(0xBF58476D1CE4E5B9) + owner.astype(np.uint64)
    inside = np.arange(len(words)) + some <= (starts + lengths)[owner]
    order = np.argsort(both[inside])
    same = np.flatnonzero(both[inside][order][1:] == both[inside][order][:-1])
    texts = np.intersect1d(texts, owner[np.flatnonzero(inside)[order[same]]])
    if not len(texts):
        return none
    # the words of these texts, a separator of its own behind each
    begin, size = starts[texts], lengths[texts]
    at = np.cumsum(size + 1) - size - 1
    places = np.repeat(at, size) + _ranges(size)
    symbols = np.empty(int(size.sum()) + len(texts), np.int64)
    symbols[places] = words[np.repeat(begin, size) + _ranges(size)] + np.repeat(np.arange(len(texts)), size) * (int(words.max()) + 1)
    symbols[at + size] = int(words.max() + 1) * len(texts) + np.arange(len(texts))
    grams = np.full(len(symbols) + some, 1, np.uint64)
    grams[places] = mixed[np.repeat(begin, size) + _ranges(size)]
    total = len(symbols)
    forward = backward = None
    found = []
    for i, p in _grid(at, size, cfg.block_pairs):
        keep = (grams[i] == grams[i + p]) | (grams[np.maximum(i - some, 0)] == grams[np.maximum(i + p - some, 0)])
        i, p = i[keep], p[keep]
        if not len(i):
            continue
        if forward is None:
            forward = _extensions(symbols, int(size.max()))
            backward = _extensions(np.r_[symbols[::-1][1:], symbols.max() + 1], int(size.max()))
        right = forward(i, i + p)
        left = np.zeros(len(i), np.int64)
        behind = np.flatnonzero(np.isin(i, at, invert=True))
        left[behind] = backward(total - 1 - i[behind], total - 1 - i[behind] - p[behind])
        run = left + right >= np.maximum(p, cfg.min_words - p)
        i, p, left, right = i[run], p[run], left[run], right[run]
        rows = np.stack([i - left, p + left + right, p], axis=1)
        found.append(np.unique(rows, axis=0) if len(rows) else rows)
    rows = np.concatenate(found) if found else none[:, 1:]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # multiples of the smallest period describe the same stretch
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]] if len(rows) else rows
    of = np.searchsorted(at, rows[:, 0], "right") - 1
    runs = np.column_stack([texts[of], rows[:, 0] - at[of], rows[:, 1], rows[:, 2]])
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _find(cfg: RunConfig) -> Callable:
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def flush(ids: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        runs = find_runs(words, lengths, cfg)
        starts, ends = np.cumsum(lengths) - lengths, np.cumsum(lengths)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, starts[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
        np.add.at(change, starts[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
        kept = np.cumsum(change[:-1]) == 0
        cut = np.bincount(runs[:, 0], minlength=len(texts)) > 0
        collapsed = [b" ".join(t if not c else [w for w, k in zip(t, kept[a:b].tolist(), strict=True) if k]) for t, c, a, b in zip(texts, cut, starts, ends, strict=True)]
        offsets = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(kind))
        lists = pa.ListArray.from_arrays(pa.array(offsets), values)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(lengths), lists, pa.array(collapsed, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                texts.append((text.as_py() or b"").split())
                ids.append(batch["doc_id"].slice(i, 1))
                size += len(texts[-1])
                if size >= cfg.unit_words:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield flush(ids, texts)

    return run


def periodic_runs(docs: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words; by start, then period) and collapsed of every row of docs.

    A run is a stretch of words with smallest period q, of at least min_words and 2q words, that neither neighbour
    extends. collapsed has the words that no run holds behind its first q, with one space between. Words are compared byte
    by byte. A null or empty text has no word and no run; equal rows come out once each; an empty table gives no rows; very
    long texts are taken whole, in n log n; other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_find(cfg), schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def looped(doc_id: Column, text: Column) -> Column:
    """The text with a loop from word a on, where h = crc32(doc_id) is divisible by ten: a and the period come from h.

    A null doc_id counts as the empty text.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def loop(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        return let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), lambda x: F.array_join(F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "))

    return F.when((h % 10 == 0) & F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), let(words_of(text), loop)).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return runs.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
