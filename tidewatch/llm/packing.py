"""Packing into fixed windows by cutting-stock column generation.

Texts are tokenized and cut at multiples of the window; what is left over is packed by patterns over the histogram of
lengths. A linear program over patterns is solved by column generation (a knapsack by dynamic programming prices
columns), the patterns are rounded, and documents, ranked within their length, fill the patterns' places.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, rank_rows, slices


@dataclass(frozen=True)
class PackingConfig:
    window: int = 2048
    #: Lengths are counted in grains in the program. Lengths below grain * grain go in bundles of `grain` equal ones, which fill
    #: whole grains; all others are rounded up, so padding stays below a grain a piece of at least that length.
    grain: int = 8
    end_id: int = 1
    #: A tokenizers file; by default the public byte-level BPE where it is installed.
    tokenizer: str | None = None
    #: Columns that are priced at most; the program is feasible after each.
    max_columns: int = 4000
    #: Pricing ends where no column gains more than this: the program is then that share above its optimum at most.
    tolerance: float = 1e-3


# Characters on which the texts' cut into words is known, of them letters and numbers: fixed values, as a test holds.
_LETTERS, _NUMBERS = r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u024F", r"0-9\xB2\xB3\xB9\xBC-\xBE"
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7E\xA1-\u024F\u2010-\u2027\u20AC]")
#: The pattern by which byte-level BPE cuts a text into words, a fixed value of the public vocabulary, on those characters.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str | None, Callable[[list[str]], list[np.ndarray]]] = {}


class _Words(dict):
    """Word to its ids' bytes; emptied at 300,000 words. Long words are the tokenizer's own work, and not kept."""

    def __init__(self, tokenizer: object):
        super().__init__()
        self.tokenizer, self.merge = tokenizer, _merger(tokenizer)

    def __missing__(self, word: str) -> bytes:
        if len(word) > 100:
            found = self.tokenizer.encode_batch_fast([[word]], is_pretokenized=True, add_special_tokens=False)[0].ids
            return array("I", found).tobytes()
        if len(self) >= 300_000:
            self.clear()
        self[word] = ids = array("I", self.merge(word)).tobytes()
        return ids


def _merger(tokenizer: object) -> Callable[[str], list[int]]:
    """A word's ids by the byte-level vocabulary of a tokenizer whose ids are in the order of its merges.

    The merging itself is tiktoken's, several times faster a word than tokenizers' and with the same ids, as tests hold.
    """
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary's names
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(map(byte.__getitem__, name)): i for name, i in tokenizer.get_vocab().items() if name not in added}
    return tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encoder(cfg: PackingConfig) -> Callable[[list[str]], list[np.ndarray]]:
    """Texts to ids as tokenizers gives them without special tokens; one for each process.

    The tokenizer encodes a text word by word, so texts are cut into words here and each word's ids are looked up.
    Texts that hold an added token, or characters on which the cut might differ, go through it as a whole.
    """
    if cfg.tokenizer not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(cfg.tokenizer or default_tokenizer())
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        words = None if cfg.tokenizer else _Words(tokenizer)

        def whole(text: str) -> bool:
            return bool(cfg.tokenizer) or UNUSUAL.search(text) is not None or any(t in text for t in added)

        def encode(texts: list[str]) -> list[np.ndarray]:
            apart = [whole(t) for t in texts]
            alone = lambda t: np.array(tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4")
            known = lambda t: np.frombuffer(b"".join(map(words.__getitem__, SPLIT.findall(t))), "<u4")
            return [alone(t) if a else known(t) for t, a in zip(texts, apart, strict=True)]

        _ENCODERS[cfg.tokenizer] = encode
    return _ENCODERS[cfg.tokenizer]


def _groups(texts: list[str | None], chars: int = 500_000) -> Iterator[list[str]]:
    """The texts in groups of about so many characters; null is the empty text."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cut(cfg: PackingConfig, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(cfg)
        for batch in slices(batches):
            rows, ids_of = [], []
            for i, ids in enumerate(ids for group in _groups(batch["text"].to_pylist()) for ids in encode(group)):
                ids = np.append(ids, np.uint32(cfg.end_id)).astype("<u4", copy=False)
                for start in range(0, len(ids), cfg.window):
                    piece = ids[start : start + cfg.window]
                    rows.append((i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                    if with_ids:
                        ids_of.append(piece.astype(np.int32))
            cols = np.array(rows, np.int64).reshape(-1, 5)
            out = [batch["doc_id"].take(pa.array(cols[:, 0])), *[pa.array(cols[:, k]) for k in range(1, 5)]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                out, names = [*out, pa.array(ids_of, pa.list_(pa.int32()))], [*names, "input_ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def cut_documents(docs: DataFrame, cfg: PackingConfig = PackingConfig(), with_ids: bool = False) -> DataFrame:
    """Pieces of every row's ids, the end id last: full windows and what is left. A null text is the empty text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", input_ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_cut(cfg, with_ids), schema)


def _knapsack(widths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how many of each width fit the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(widths, kind="stable")
    w, v = widths[order], values[order]
    for c in range(1, capacity + 1):
        best[c], choice[c] = best[c - 1], -1
        k = np.searchsorted(w, c, "right")
        if k:
            gains = best[c - w[:k]] + v[:k]
            j = int(np.argmax(gains))
            if gains[j] > best[c] + 1e-12:
                best[c], choice[c] = gains[j], j
    pattern, c = np.zeros(len(widths), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[order[choice[c]]] += 1
            c -= w[choice[c]]
    return float(best[capacity]), pattern


def _first_columns(widths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A basis to begin with: patterns filled with the widest items left, each used until one of its widths is met.

    Column c is the pattern that ends width c, so that in the order of their making, which is returned with them, the
    columns are triangular.
    """
    columns, x = np.zeros((len(widths), len(widths)), np.int64), np.zeros(len(widths))
    left = demand.astype(np.float64)
    order = np.argsort(-widths, kind="stable").tolist()
    open_, made = set(order), []
    while open_:
        pattern, room = np.zeros(len(widths), np.int64), capacity
        for c in order:
            if c in open_:
                pattern[c] = room // widths[c]
                room -= int(pattern[c] * widths[c])
        used = np.flatnonzero(pattern)
        c = int(used[np.argmin(left[used] / pattern[used])])
        columns[:, c], x[c] = pattern, left[c] / pattern[c]
        left = np.maximum(left - x[c] * pattern, 0)
        open_.remove(c)
        made.append(c)
    return columns, x, np.array(made)


def _inverse(columns: np.ndarray, made: np.ndarray) -> np.ndarray:
    """The inverse of columns that are lower triangular in the order made, by forward substitution.

    Products here and below are elementwise: BLAS takes threads for matrices of this size, and those wait forever in a
    driver whose session runs.
    """
    lower = columns[np.ix_(made, made)].astype(np.float64)
    rows = np.eye(len(made))
    for i in range(len(made)):
        rows[i] = (rows[i] - (lower[i, :i, None] * rows[:i]).sum(axis=0)) / lower[i, i]
    inverse = np.empty_like(rows)
    inverse[np.ix_(made, made)] = rows
    return inverse


def cutting_stock(widths: np.ndarray, demand: np.ndarray, capacity: int, max_columns: int, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often each is used, so that every demand is met exactly: the linear program by
    revised simplex with priced columns, rounded down, then first fit decreasing for the few items left.
    """
    m = len(widths)
    if not m:
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    columns, x, made = _first_columns(widths, demand, capacity)
    inverse = _inverse(columns, made)
    for _ in range(max_columns):
        value, pattern = _knapsack(widths, inverse.sum(axis=0), capacity)
        if value <= 1 + tolerance:
            break
        d = (inverse * pattern).sum(axis=1)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(np.argmin(ratio))
        step = ratio[r]
        x = np.maximum(x - step * d, 0)
        x[r] = step
        inverse[r] /= d[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(d[others], inverse[r])
        columns[:, r] = pattern
    times = np.floor(x + 1e-6).astype(np.int64)
    while (over := (columns * times).sum(axis=1) - demand).max() > 0:  # rounding noise
        c = int(np.argmax(over))
        times[np.flatnonzero((columns[c] > 0) & (times > 0))[0]] -= 1
    left = demand - (columns * times).sum(axis=1)
    rest: list[tuple[int, np.ndarray]] = []
    for c in np.argsort(-widths, kind="stable"):
        for _ in range(int(left[c])):
            for k, (room, pattern) in enumerate(rest):
                if room >= widths[c]:
                    pattern[c] += 1
                    rest[k] = (room - int(widths[c]), pattern)
                    break
            else:
                pattern = np.zeros(m, np.int64)
                pattern[c] = 1
                rest.append((capacity - int(widths[c]), pattern))
    patterns = np.vstack([columns.T[times > 0], *[p for _, p in rest]])
    return patterns, np.concatenate([times[times > 0], np.ones(len(rest), np.int64)])


def _suppliers(histogram: list[tuple[int, int]], cfg: PackingConfig) -> dict[int, list[tuple[int, int, int, int]]]:
    """By width in grains the units that have it: class of pieces, first rank, pieces a unit, units.

    A class is a length below grain * grain, or beyond it a number of grains (from grain * grain + grain on).
    """
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    small = cfg.grain * cfg.grain
    for c, n in histogram:
        if c >= small:
            out.setdefault(c - small, []).append((c, 0, 1, n))
            continue
        bundles, rest = divmod(n, cfg.grain)
        for width, first, per, units in ((c, 0, cfg.grain, bundles), (-(-c // cfg.grain), bundles * cfg.grain, 1, rest)):
            if units:
                out.setdefault(width, []).append((c, first, per, units))
    return dict(sorted(out.items()))


def _places(histogram: list[tuple[int, int]], cfg: PackingConfig) -> list[tuple[int, ...]]:
    """class, ranks from and below, pieces a unit, its first unit's number, units a sequence, first sequence.

    The piece with this rank is in unit number + (rank - from) div pieces, and that in sequence first + unit div units.
    """
    units = _suppliers(histogram, cfg)
    widths = np.array(list(units), np.int64)
    demand = np.array([sum(x[3] for x in of) for of in units.values()], np.int64)
    patterns, times = cutting_stock(widths, demand, cfg.window // cfg.grain, cfg.max_columns, cfg.tolerance)
    places, used, first = [], np.zeros(len(widths), np.int64), 0
    for pattern, n in zip(patterns, times, strict=True):
        for c in np.flatnonzero(pattern):
            a, low = int(pattern[c]), int(used[c])
            high, at = low + a * int(n), 0
            for kind, rank, per, count in units[int(widths[c])]:
                i, j = max(low, at), min(high, at + count)
                if i < j:
                    places.append((kind, rank + (i - at) * per, rank + (j - at) * per, per, i - low, a, first))
                at += count
            used[c] = high
        first += int(n)
    return places


#: Rows of a bucket in which ranks are numbered.
_BUCKET = 100_000


def pack_documents(docs: DataFrame, cfg: PackingConfig = PackingConfig(), with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there.

    Equal rows are packed one by one, a null text is the empty text, an empty table gives no rows; very long texts are
    encoded whole and cut into windows. Pieces are computed once and written to the shared folder when this is called;
    they are ranked and placed as a few numbers each; with_ids adds input_ids, which meet their places in one shuffle at the end. A full window
    is a sequence; what is left goes by class of length. Of classes there are grain * grain + window / grain at most: their
    counts reach the driver, and the places, bounded by them, are broadcast. Ranks are numbered in buckets that grow in number.
    """
    spark = docs.sparkSession
    if cfg.window % cfg.grain or cfg.window <= cfg.grain * cfg.grain:
        raise ValueError("the window must be a multiple of the grain, and above its square")
    small = cfg.grain * cfg.grain
    length = F.col("length")
    grains = small + F.ceil(length / cfg.grain).cast("long")
    kind = F.when(length == cfg.window, F.lit(-1)).when(length < small, length).otherwise(grains)
    cut = cut_documents(docs, cfg, with_ids)
    written = materialize(cut.withColumn("piece", F.monotonically_increasing_id()) if with_ids else cut, "pieces")
    pieces = written.drop("input_ids").withColumn("class", kind.cast("long"))
    histogram = sorted((r["class"], r["n"]) for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect())
    full = sum(n for c, n in histogram if c < 0)
    rest = [x for x in histogram if x[0] >= 0]
    places = spark.createDataFrame(_places(rest, cfg), "c long, low long, high long, per long, unit long, a long, first long")
    cols = pieces.drop("class").columns
    windows = rank_rows(pieces.where("class < 0").drop("class"), [], "sequence_id", max(64, full // _BUCKET)).withColumn("offset", F.lit(0).cast("long"))
    ranked = rank_rows(pieces.where("class >= 0"), ["class"], "rank", max(64, max((n for _, n in rest), default=0) // _BUCKET))
    fits = (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(F.broadcast(places), fits).withColumn("sequence_id", full + F.col("first") + F.expr("(unit + (rank - low) div per) div a"))
    inside = W.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(W.unboundedPreceding, -1)
    filled = placed.select(*cols, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
    out = windows.select(*cols, "sequence_id", "offset").unionByName(filled)
    return out.join(written.select("piece", "input_ids"), "piece").drop("piece") if with_ids else out


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
