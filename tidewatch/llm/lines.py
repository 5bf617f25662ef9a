"""Repeated passages, found by winnowing over hashes of lines.

A text is cut into lines, and long lines at sentence ends. A gram is the shortest run of lines from one line on that
has enough words; of every window of grams the least hash is a fingerprint. Any shared run of `run_words` words holds
a fingerprint that is shared, too. Around shared fingerprints all runs that hold them are compared (the extension both
ways), and of equal runs all but the first, by doc_id and place, are deleted.

Compared are the shortest runs from each line on, and the shortest runs up to each line (tails). Every line of a longest
common run with enough words lies in one of those two kinds that is common, too: in the run from it on, where that ends
in time, else in the run up to the end. So the whole of every common run goes, and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_hot, let, materialize, slices

#: A line ends after a line feed, or after a sentence end and white space.
_UNIT = re.compile(r"[^\n.!?]*(?:[.!?]+(?![\s.!?])[^\n.!?]*)*(?:[.!?]+[^\S\n]*\n?|\n|$)")


@dataclass(frozen=True)
class LineConfig:
    #: Words of a run from which on it is deleted where it is repeated.
    run_words: int = 32
    #: Words of a gram; windows of grams span the rest of a run.
    gram_words: int = 16


#: Code points that are worked on at once; a longer text is worked on alone.
_BLOCK = 2_000_000


def cut_lines(text: str) -> list[str]:
    """The lines of a text; joined they are the text."""
    return [x for x in _UNIT.findall(text) if x]


def _spans(sums: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """For each line the end of the shortest run from it on with least words; -1 where its text ends before.

    sums: words before each line and after the last, over many texts; last: by line, the end of its text.
    """
    ends = np.searchsorted(sums, sums[:-1] + least, "left")
    return np.where(ends <= last, ends, -1)


def _tails(sums: np.ndarray, first: np.ndarray, least: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First lines and ends of the shortest runs up to each line with least words that are not among the runs in ends."""
    stops = np.flatnonzero(sums[1:] - sums[first] >= least) + 1
    starts = np.searchsorted(sums, sums[stops] - least, "right") - 1
    new = ends[starts] != stops
    return starts[new], stops[new]


class _Powers:
    """Powers of an odd base and of its inverse mod 2^64, as many as the longest text so far needs."""

    base = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            row = lambda b: np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, b, np.uint64))), dtype=np.uint64)
            self.up, self.down = row(np.uint64(self.base)), row(np.uint64(pow(self.base, -1, 1 << 64)))


def _hash_spans(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray, within: np.ndarray, powers: _Powers) -> np.ndarray:
    """A 64-bit hash of each run of lines: a polynomial of their hashes, mixed.

    With prefix sums S of hash * base^i, the run i..j has S[j] - S[i] = base^i * value; the odd base has an inverse. Powers go
    by the line's number in its text (within), and what stands before the text is in both sums.
    """
    value = (sums[stops] - sums[starts]) * powers.down[within[starts]]
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    return value


def _window_minima(grams: np.ndarray, ends: np.ndarray, runs: np.ndarray, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Lines whose gram is the least, the last on ties, of some run's grams: of those that lie within the run. And how many
    each text has. Lines of many texts, each from one of the bounds to the next."""
    chosen: list[int] = []
    counts = []
    stops, hashes, spans = ends.tolist(), grams.tolist(), runs.tolist()
    for begin, end in zip(bounds, bounds[1:], strict=False):
        before = len(chosen)
        last = -1
        queue: list[int] = []  # increasing hashes, sliding over the lines
        head, nxt = 0, begin
        for i in range(begin, end):
            run = spans[i]
            if run < 0:
                break
            while nxt < end and 0 <= stops[nxt] <= run:
                while len(queue) > head and hashes[queue[-1]] >= hashes[nxt]:
                    queue.pop()
                queue.append(nxt)
                nxt += 1
            while queue[head] < i:
                head += 1
            if queue[head] != last:
                last = queue[head]
                chosen.append(last)
        counts.append(len(chosen) - before)
    return np.array(chosen, np.int64), np.array(counts, np.int64)


def _lists(values, sizes: np.ndarray) -> pa.ListArray:
    """Values in lists of so many, one after another."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values, pa.int64()))


def _analyse(cfg: LineConfig):
    powers = _Powers()

    def outlines(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        lines = [cut_lines(t) for t in texts]
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        flat = list(chain.from_iterable(lines))
        words_in, hashed = [], []
        for x in flat:
            own = x.split()
            words_in.append(len(own))
            hashed.append(xxhash.xxh64_intdigest(" ".join(own)))
        hashes = np.array(hashed, np.uint64)
        words = np.concatenate(([0], np.cumsum(np.array(words_in, np.int64))))
        chars = np.concatenate(([0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))))
        # Lines of all texts are numbered through.
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        first, last = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
        within = np.arange(len(flat)) - first
        powers.reach(int(sizes.max(initial=0)) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * powers.up[within], dtype=np.uint64)))
        runs, ends = _spans(words, last, cfg.run_words), _spans(words, last, cfg.gram_words)
        grams = np.zeros(len(flat), np.uint64)
        held = np.flatnonzero(ends >= 0)
        grams[held] = _hash_spans(sums, held, ends[held], within, powers)
        chosen, each = _window_minima(grams, ends, runs, bounds.tolist())
        # Runs from one line on: from a text's first line to the last that has a whole run.
        at = np.flatnonzero(runs >= 0)
        whole = runs[at]
        before = np.searchsorted(at, bounds)
        n = np.diff(before)
        # Runs that hold a fingerprint: from the first that reaches its gram's end to the one at its line.
        text = np.repeat(np.arange(len(lines)), each)
        spots = chosen - bounds[text]
        lows = np.minimum(np.searchsorted(whole, ends[chosen], "left") - before[text], spots)
        prints, places, several = [], [], []
        found, where, stop = grams[chosen].view(np.int64).tolist(), ((lows << 32) | spots).tolist(), 0
        for k in each.tolist():
            by: dict[int, list[int]] = {}
            for g, i in zip(found[stop : stop + k], where[stop : stop + k], strict=True):
                by.setdefault(g, []).append(i)
            stop += k
            prints += by
            places += by.values()
            several.append(len(by))
        start = chars[bounds]
        begins, tails = _tails(words, first, cfg.run_words, runs)
        tails_before = np.searchsorted(begins, bounds)
        asked = np.arange(int(n.sum()) + len(n)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
        tail_from = np.searchsorted(begins, np.repeat(bounds[:-1], n + 1) + asked) - np.repeat(tails_before[:-1], n + 1)
        m = np.diff(tails_before)
        arrays = [
            _lists(prints, np.array(several)),
            _lists(_lists(list(chain.from_iterable(places)), np.fromiter(map(len, places), np.int64, len(places))), np.array(several)),
            _lists(_hash_spans(sums, at, whole, within, powers).view(np.int64), n),
            _lists(chars[at] - np.repeat(start[:-1], n), n),
            _lists(chars[whole] - np.repeat(start[:-1], n), n),
            _lists(tail_from, n + 1),
            _lists(_hash_spans(sums, begins, tails, within, powers).view(np.int64), m),
            _lists(chars[tails] - np.repeat(start[:-1], m), m),
        ]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], *arrays], names=["doc_id", "th", "prints", "at", "keys", "starts", "stops", "tail_from", "tail_keys", "tail_stops"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            stop = 0
            while stop < len(texts):
                start, room = stop, _BLOCK
                while stop < len(texts) and (stop == start or len(texts[stop]) <= room):
                    room -= len(texts[stop])
                    stop += 1
                yield outlines(batch.slice(start, stop - start), texts[start:stop])

    return run


def analyse(docs: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """Per row: fingerprints (hashes; in `at` the lines of each, and above 32 bits the first run that holds it), and all runs (key, start and stop in code points) by first line; those up to a line (keys and stops) with the place of each first line's in tail_from."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = "at array<array<bigint>>, " + ", ".join(f"{c} array<bigint>" for c in ("keys", "starts", "stops", "tail_from", "tail_keys", "tail_stops"))
    longs = f"prints array<bigint>, {longs}"
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_analyse(cfg), f"doc_id {kind}, th bigint, {longs}")


def repeated_spans(docs: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """doc_id, th (hash of the text) and the spans of code points to delete, merged, of each text that has any.

    A run is repeated if the same lines, white space aside, stood at an earlier place: in a smaller doc_id (a null id
    is the least; texts of one doc_id go by hash), or before it in its own text. Equal rows count as one.
    """
    rows = materialize(analyse(docs, cfg).withColumn("row", F.monotonically_increasing_id()), "lines")
    # A text's occurrences of one fingerprint stay together, so that junk that repeats itself is one row.
    prints = rows.select("doc_id", "th", "row", F.explode(F.arrays_zip("prints", "at")).alias("p")).select("doc_id", "th", "row", F.col("p.prints").alias("g"), F.col("p.at").alias("at"))
    # Least and greatest numbers by themselves are aggregated by hash, structs of them by sorting.
    places = [F.min("doc_id").alias("one"), F.max("doc_id").alias("two"), F.count("doc_id").alias("named"), F.min("th").alias("low"), F.max("th").alias("high")]
    shared = prints.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *places, F.max(F.size("at")).alias("own")).where("own > 1 OR one <> two OR low <> high OR named NOT IN (0, n)").select("g", "n")
    shared = materialize(shared, "shared")
    hits = join_hot(prints, shared, "g", "n").groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("hit"), F.min("row").alias("row"))
    # Of equal rows, which have the same fingerprints, one goes on.
    touched = rows.drop("prints", "at").join(hits.select("row", "hit"), "row")
    # Extension: every run that holds a fingerprint begins at its line or before; the first stands in the upper half.
    line = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    near = F.array_distinct(F.flatten(F.transform("hit", lambda h: F.sequence(F.shiftright(h, 32), F.greatest(F.shiftright(h, 32), F.least(line(h), F.size("keys").cast("long") - 1))))))
    tails = lambda i: F.arrays_zip(*[F.slice(c, F.get("tail_from", i) + 1, F.get("tail_from", i + 1) - F.get("tail_from", i)).alias(a) for c, a in (("tail_keys", "key"), ("tail_stops", "stop"))])
    run = lambda i: F.struct(*[F.get(c, i).alias(a) for c, a in (("keys", "key"), ("starts", "start"), ("stops", "stop"))], tails(i).alias("tails"))
    runs = materialize(touched.select("doc_id", "th", F.explode(F.transform(near, lambda i: run(i.cast("int")))).alias("run")).select("doc_id", "th", "run.*"), "runs")
    discard(rows, shared)
    again, later = _later(runs)
    # A common run up to a line holds the run from its first line on, which is common, too.
    ends = materialize(again.select("doc_id", "th", "start", F.explode("tails").alias("t")).select("doc_id", "th", "t.key", "start", "t.stop"), "tails")
    again_ends, later_ends = _later(ends)
    spans = later.union(later_ends).groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s"))
    spans = materialize(spans.select("doc_id", "th", _merged(F.col("s")).alias("spans")), "spans")
    discard(again, again_ends)
    return spans


def _later(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs whose key another run has, and of them doc_id, th, start and stop of all but the first of each key. The table of runs goes."""
    first = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "start")).alias("first")).where("n > 1")
    first = materialize(first, "first")
    again = materialize(join_hot(runs, first, "key", "n"), "again")
    discard(runs, first)
    return again, again.where(~F.struct("doc_id", "th", "start").eqNullSafe(F.col("first"))).select("doc_id", "th", "start", "stop")


def _merged(spans: Column) -> Column:
    """Overlapping spans as one; the spans are sorted."""
    kind = "array<struct<start:bigint,stop:bigint>>"
    start = F.struct(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.array().cast(kind).alias("out"))
    closed = lambda x: F.when(x["a"] < 0, x["out"]).otherwise(F.concat(x["out"], F.array(F.struct(x["a"].alias("start"), x["b"].alias("stop")))))
    step = lambda x, s: F.when((x["a"] >= 0) & (s["start"] <= x["b"]), F.struct(x["a"].alias("a"), F.greatest(x["b"], s["stop"]).alias("b"), x["out"].alias("out"))).otherwise(F.struct(s["start"].alias("a"), s["stop"].alias("b"), closed(x).alias("out")))
    return F.aggregate(spans, start, step, closed)


def dedup_lines(docs: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """docs with repeated runs cut out of their texts, and two columns: __removed (code points) and __spans (their number).

    Texts that nothing is cut from, null and empty ones among them, stay as they are; n_chars follows the text. The
    texts are read twice and shuffled once, to meet their spans.
    """
    cuts = repeated_spans(docs, cfg).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__cut"))
    rows = docs.withColumn("__own", F.xxhash64("text"))
    rows = rows.join(cuts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th")), "left")
    text = F.col("text")

    def kept(spans: Column) -> Column:
        end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["stop"])
        parts = F.transform(spans, lambda s, i: F.substr(text, (end(i) + 1).cast("int"), (s["start"] - end(i)).cast("int")))
        return F.concat(F.array_join(parts, ""), F.substr(text, (F.element_at(spans, -1)["stop"] + 1).cast("int"), F.length(text)))

    cut = F.when(F.col("__cut").isNotNull(), let(F.col("__cut"), kept)).otherwise(text)
    out = rows.withColumns({"text": cut, "__spans": F.coalesce(F.size("__cut"), F.lit(0)), "__removed": F.coalesce(F.aggregate("__cut", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]), F.lit(0).cast("long"))})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "__spans", "__removed")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("__spans").cast("long").alias("n_spans"), F.col("__removed").alias("removed_chars"), F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
