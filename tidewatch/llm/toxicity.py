"""Toxic passages as maximum-scoring segments.

Tokens score their log-odds of standing in toxic texts, under Dirichlet priors: a word's rate is drawn to the rate of
words that begin alike, and that to the overall rate. A linear-time scan finds all maximal segments of a text, scores
above chance by extreme-value statistics are significant, and their sums are calibrated to probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket

EDGES = ".,;:!?\"'()[]{}«»“”„…-–—"


@dataclass(frozen=True)
class ToxicityConfig:
    #: Labelled rows at most that the model learns from; beyond it a sample by hash of doc_id.
    max_labelled: int = 400_000
    #: Words share 2^hash_bits buckets of counts; collisions() tells what share of a table's words meets another one there.
    hash_bits: int = 22
    prefix: int = 5
    #: Weights of the priors, in tokens.
    prefix_prior: float = 20.0
    word_prior: float = 5.0
    #: Taken off each token's log-odds, so that chance segments end.
    drift: float = 0.7
    #: Expected number of chance segments of this score in a text, below which a passage is significant.
    max_expected: float = 0.05


@dataclass
class ToxicityModel:
    cfg: ToxicityConfig
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    rate: float = 0.5
    rates: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, float, float] = (0.0, 1.0, 0.0)

    def __getstate__(self) -> dict:
        """Few buckets differ from the rest unless the table is large, and a broadcast is a file on every machine: only those are sent."""
        pack = lambda x: x if isinstance(x, tuple) else _packed(x.ravel())
        return {**self.__dict__, "counts": pack(self.counts), "rates": pack(self.rates)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.open()

    def open(self) -> None:
        """All buckets as arrays, which only what scores needs: a fitted model holds the few."""
        if isinstance(self.counts, tuple):
            self.counts, self.rates = _unpacked(*self.counts).reshape(-1, 2), _unpacked(*self.rates)


def _packed(x: np.ndarray) -> tuple[int, float, np.ndarray | None, np.ndarray]:
    """Length, a common value, and places and values of what differs from it; all values where that would be longer."""
    some = np.sort(x[:: len(x) // 1000 + 1])
    base = some[len(some) // 2] if len(some) else 0.0
    at = np.flatnonzero(x != base).astype(np.int32)
    return (len(x), base, at, x[at]) if len(at) <= len(x) // 2 else (len(x), base, None, x)


def _unpacked(n: int, base: float, at: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    if at is None:
        return values
    out = np.full(n, base, values.dtype)
    out[at] = values
    return out


def _core(word: str) -> str:
    return word.strip(EDGES) or word


def _slots(word: str, cfg: ToxicityConfig) -> tuple[int, int]:
    """Hash buckets of a word and of its beginning."""
    mask, word = (1 << cfg.hash_bits) - 1, _core(word)
    return zlib.crc32(word.encode()) & mask, zlib.crc32(b"^" + word[: cfg.prefix].encode()) & mask


class _Scores(dict):
    """Token to score, filled as tokens come; emptied at a million."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        model.open()
        self.model = model

    def __missing__(self, word: str) -> float:
        m = self.model
        w, p = _slots(word, m.cfg)
        toxic, all_ = m.counts[w]
        prior = m.rates[p]
        rate = (toxic + m.cfg.word_prior * prior) / (all_ + m.cfg.word_prior)
        score = float(np.log(rate / (1 - rate)) - np.log(m.rate / (1 - m.rate))) - m.cfg.drift
        if len(self) > 1_000_000:
            self.clear()
        self[word] = score
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by one scan that keeps candidates with their prefix sums."""
    left: list[float] = []  # the prefix sum before a candidate
    right: list[float] = []  # and after it
    begin: list[int] = []
    end: list[int] = []
    back: list[int] = []  # the nearest earlier candidate with a smaller left sum
    at = np.flatnonzero(scores > 0)
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    for i, lo, hi in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
        start, stop = i, i + 1
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                left.append(lo)
                right.append(hi)
                begin.append(start)
                end.append(stop)
                back.append(j)
                break
            lo, start = left[j], begin[j]
            del left[j:], right[j:], begin[j:], end[j:]
            j = back.pop(j)
            del back[len(left) :]
    return [(s, e, r - x) for s, e, x, r in zip(begin, end, left, right, strict=True)]


def _tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _count(cfg: ToxicityConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << cfg.hash_bits
        sums = np.zeros((2 * size, 2), np.int64)
        words: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> None:
            for label, counts in enumerate(words):
                for word, n in counts.items():
                    w, p = _slots(word, cfg)
                    sums[w, label] += n
                    sums[size + p, label] += n
                counts.clear()

        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                words[label].update(_tokens(text))
                if len(words[label]) > 300_000:
                    flush()
        flush()
        at = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at, 1]), pa.array(sums[at, 0])], names=["slot", "toxic", "clean"])

    return run


def _segments_of(model: ToxicityModel) -> Callable[[str | None], tuple[np.ndarray, list[tuple[int, int, float]]]]:
    memo = _Scores(model)

    def of(text: str | None) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        words = _tokens(text)
        scores = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
        return scores, maximal_segments(scores)

    return of


#: Bins of token scores, for the scale of the extreme-value law.
BINS = np.linspace(-12, 12, 961)


def _observe(shared: object) -> Callable:
    """Per text its label, number of tokens and best segment; and bins of clean tokens' scores, as labels below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _segments_of(shared.value)
        hist = np.zeros(len(BINS) + 1, np.int64)
        for batch in batches:
            rows = []
            for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                scores, found = of(text)
                if not label:
                    hist += np.bincount(np.digitize(scores, BINS), minlength=len(hist))
                rows.append((int(label), len(scores), max((s for *_, s in found), default=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.float64()))], names=["label", "n", "best"])
        at = np.flatnonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - at, pa.int32()), pa.array(hist[at]), pa.array(np.zeros(len(at)))], names=["label", "n", "best"])

    return run


def _measure(shared: object, lam: float, k: float) -> Callable:
    """Per text its label and features, under the law of lam and k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = replace(shared.value, lam=lam, k=k)
        of = _segments_of(model)
        for batch in batches:
            rows = [(int(label), *_features(found, len(scores), model)) for label, (scores, found) in zip(batch["toxic"].to_pylist(), map(of, batch["text"].to_pylist()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.float64(), pa.float64()))], names=["label", "best", "sum"])

    return run


def _features(found: list[tuple[int, int, float]], n: int, model: ToxicityModel) -> tuple[float, float]:
    """The best segment's score in units of the extreme-value law, and the sum of all segments' that are above chance."""
    base = np.log(model.k * max(n, 1))
    norm = model.lam * np.array([s for *_, s in found] or [0.0]) - base
    return float(np.clip(norm.max(), -20, 60)), float(np.log1p(norm[norm > 0].sum()))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Learn from labelled documents whose crc32(doc_id) mod 5 is not 0: remainders 1 to 3 give the token counts,
    4 the calibration. Several labels of a doc_id: toxic if any is; null labels and ids are no labels. The labels used
    are bounded by cfg.max_labelled and broadcast; texts are not shuffled. Without labels every score is 0.5.
    """
    spark = docs.sparkSession
    part = bucket(F.col("doc_id"), 5)
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).where(part != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > cfg.max_labelled:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(900_000 * cfg.max_labelled / n)).limit(cfg.max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").withColumn("fold", part)
    counted = rows.where("fold < 4").select("text", "toxic").mapInArrow(_count(cfg), "slot bigint, toxic bigint, clean bigint").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # A row a bucket in use: columns of 12 bytes a row reach the driver, no objects.
    counted = counted.select(F.col("slot").cast("int"), F.col("toxic").cast("float"), F.col("clean").cast("float")).toArrow()
    size, slot = 1 << cfg.hash_bits, counted["slot"].to_numpy()
    sums = np.column_stack([counted[c].to_numpy() for c in ("toxic", "clean")])
    words, starts = sums[slot < size], np.vstack([sums[slot >= size], np.zeros((1, 2), np.float32)])  # the last: a bucket without words
    toxic, clean = words.sum(axis=0, dtype=np.float64)
    model = ToxicityModel(cfg, rate=(toxic + 1) / (toxic + clean + 2))
    rates = (starts[:, 0] + cfg.prefix_prior * model.rate) / (starts.sum(axis=1) + cfg.prefix_prior)
    at = 2 * slot[slot < size]
    model.rates = (size, rates[-1], (slot[slot >= size] - size).astype(np.int32), rates[:-1])
    model.counts = (2 * size, np.float32(0), np.concatenate([at, at + 1]).astype(np.int32), np.concatenate([words[:, 0], words.sum(axis=1)]))
    del counted, slot, sums, words, starts, at
    shared = spark.sparkContext.broadcast(model)
    held = rows.where("fold = 4").select("text", "toxic")
    seen = held.mapInArrow(_observe(shared), "label int, n bigint, best double").toArrow().to_pandas()
    hist = np.zeros(len(BINS) + 1)
    for label, count in seen.loc[seen["label"] < 0, ["label", "n"]].itertuples(index=False):
        hist[-1 - label] += count
    cases = seen[seen["label"] >= 0]
    model.lam, model.k = _law(hist, cases[cases["label"] == 0])
    y = cases["label"].to_numpy(np.float64)
    model.weights = (0.0, 0.0, 0.0)
    if 0 < y.sum() < len(y):
        cases = held.mapInArrow(_measure(shared, model.lam, model.k), "label int, best double, sum double").toArrow().to_pandas()
        model.weights = tuple(_fit_logistic(cases[["best", "sum"]].to_numpy(), cases["label"].to_numpy(np.float64)))
    shared.destroy()
    return model


def _law(hist: np.ndarray, clean: object) -> tuple[float, float]:
    """Scale and size of the extreme-value law: E[exp(lam * score)] = 1 over clean tokens, and K by the mean maximum."""
    mids = np.concatenate(([BINS[0]], (BINS[:-1] + BINS[1:]) / 2, [BINS[-1]]))
    lam = 1.0
    if hist.sum() and hist[mids > 0].sum() and (hist * mids).sum() < 0:
        p, low, high = hist / hist.sum(), 1e-3, 50.0
        for _ in range(80):
            lam = (low + high) / 2
            low, high = (low, lam) if (p * np.exp(np.minimum(lam * mids, 600))).sum() > 1 else (lam, high)
    best = clean["best"].to_numpy(np.float64) if len(clean) else np.zeros(1)
    n = np.maximum(clean["n"].to_numpy(np.float64), 1) if len(clean) else np.ones(1)
    return lam, float(np.exp(np.median(lam * best - np.log(n)) + np.log(np.log(2))))


_PASSAGES = "array<struct<start:int,end:int,score:double,expected:double,passage:string>>"


def _score(shared: object) -> Callable:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64()), ("passage", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        of, weights = _segments_of(model), np.array(model.weights)
        for batch in batches:
            probs, passages = [], []
            for text in batch["text"].to_pylist():
                scores, found = of(text)
                z = weights @ np.array([1.0, *_features(found, len(scores), model)])
                probs.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
                least = (np.log(model.k * max(len(scores), 1)) - np.log(model.cfg.max_expected)) / model.lam
                found = [x for x in found if x[2] >= least]
                spans = [m.span() for m in re.finditer(r"\S+", text)] if found else []
                passages.append([{"start": spans[s][0], "end": spans[e - 1][1], "score": x, "expected": float(model.k * len(scores) * np.exp(-model.lam * x)), "passage": text[spans[s][0] : spans[e - 1][1]]} for s, e, x in found])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(probs, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    return run


def collisions(docs: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> float:
    """The share of the distinct words of a table that share their bucket with another one."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).select(F.expr(f"trim(both {_quoted(EDGES)} from w)").alias("w")).distinct()
    sizes = words.groupBy(F.crc32(F.col("w").cast("binary")).bitwiseAND(F.lit((1 << cfg.hash_bits) - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    r = sizes.agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("n")).first()
    return float(r["c"] or 0) / max(int(r["n"] or 0), 1)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1) and the significant toxic passages of every row, with code point offsets.

    Null and empty texts have no tokens and get the score of no evidence; an empty table gives no rows. All segments of a text
    take part, however long it is: the scan is linear. Rows are scored one by one; only doc_id and text are read, and nothing
    is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_score(shared), f"doc_id {kind}, score double, passages {_PASSAGES}")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    held = bucket(F.col("doc_id"), 5) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
