"""Language-model scores by a weighted backoff automaton.

The model holds every n-gram of the training texts up to an order; none is dropped. Its states are contexts. A word that
followed a context is an arc, with the Dirichlet-smoothed probability (count + prior * p) / (context's count + prior),
where p is the word's probability in the shorter context; for all others the failure arc, of weight
prior / (context's count + prior), leads to that context. The root holds the smoothed word counts.

A batch of texts needs no more of the model than its own n-grams. So each batch counts its n-grams and sends them, once
each, to buckets by hash; a bucket sums what batches counted and answers each with the totals of what it sent. From these
the batch builds its part of the automaton and walks its texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, materialize

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Stands for the end of a text; no word holds a line feed.
END = b"\n"


@dataclass(frozen=True)
class LmConfig:
    #: Words of the longest n-grams.
    order: int = 2
    #: Weight of the shorter context's distribution, in tokens.
    prior: float = 20.0
    #: Added to each word's count at the root.
    smoothing: float = 0.1
    #: Tokens after which a batch of texts is closed; a longer text is a batch of its own.
    batch_tokens: int = 300_000
    #: N-grams that a bucket is sent, about; there are as many buckets as that takes.
    bucket_keys: int = 1_000_000


class _Index(dict):
    """Word to its number, in the order they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, which compress well where high bytes are alike, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T), 1)


def _unpack(data: bytes, kind: type = np.uint64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _batch_texts(cfg: LmConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, tokens, learn, ids = _Index(), [], [], []

        def flush() -> pa.RecordBatch:
            kinds = {"doc_id": pa.concat_arrays(ids), "learn": pa.array(learn, pa.bool_()), "sizes": pa.array(map(len, tokens), pa.int64())}
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in kinds.values()]
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
            blobs = [pa.array([_pack(x)], pa.binary()) for x in (hashes, np.concatenate(tokens))]
            numbers = [pa.array([n], pa.int64()) for n in (len(index), sum(map(len, tokens)))]
            out = pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists, *blobs, *numbers], names=["batch", *kinds, "words", "tokens", "n_words", "n_tokens"])
            for x in (index, tokens, learn, ids):
                x.clear()
            return out

        size = 0
        for batch in batches:
            for i, (known, text) in enumerate(zip(batch["learn"].to_pylist(), batch["text"], strict=True)):
                words = (text.as_py() or b"").translate(_LOWER).split()
                words.append(END)
                tokens.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                learn.append(bool(known))
                ids.append(batch["doc_id"].slice(i, 1))
                size += len(words)
                if size >= cfg.batch_tokens:
                    yield flush()
                    size = 0
        if tokens:
            yield flush()

    return run


@dataclass
class _Texts:
    """A batch: words' hashes, tokens as numbers of words, and of each token its place in its text and whether it teaches."""

    hashes: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    place: np.ndarray
    learn: np.ndarray

    @classmethod
    def of(cls, row: dict) -> _Texts:
        sizes = np.array(row["sizes"], np.int64)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(starts, sizes)
        return cls(_unpack(row["words"]), _unpack(row["tokens"], np.uint32).astype(np.int64), sizes, place, np.repeat(np.array(row["learn"], bool), sizes))

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, the distinct keys of n-grams, ascending, and for each token the number of the one it ends; -1 for none."""
        keys, number = np.unique(self.hashes, return_inverse=True)
        yield 1, keys, number[self.tokens]
        words = self.hashes[self.tokens]
        full = words
        for n in range(2, order + 1):
            full = np.concatenate((full[:1], full[:-1])) * np.uint64(0x9E3779B97F4A7C15) + words
            full ^= full >> np.uint64(32)
            full *= np.uint64(0xBF58476D1CE4E5B9)
            full ^= full >> np.uint64(29)
            inside = self.place >= n - 1
            keys, number = np.unique(full[inside], return_inverse=True)
            at = np.full(len(full), -1, np.int64)
            at[inside] = number
            yield n, keys, at


def _deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys' order by bucket, and where in it each bucket begins."""
    own = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return order, np.searchsorted(own[order], np.arange(buckets + 1))


def _ask(order: int, buckets: dict[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                texts = _Texts.of(row)
                for n, keys, at in texts.grams(order):
                    counts = np.bincount(at[texts.learn & (at >= 0)], minlength=len(keys)).astype(np.uint64)
                    dealt, bounds = _deal(keys, buckets[n])
                    keys, counts = keys[dealt], counts[dealt]
                    spans = [(b, s, e) for b, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if s < e]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([n] * len(spans), pa.int32()),
                            pa.array([b for b, _, _ in spans], pa.int32()),
                            pa.array([row["batch"]] * len(spans), pa.string()),
                            pa.array([_pack(np.diff(keys[s:e], prepend=np.uint64(0))) for _, s, e in spans], pa.binary()),
                            pa.array([_pack(counts[s:e]) for _, s, e in spans], pa.binary()),
                        ],
                        names=["n", "bucket", "batch", "keys", "counts"],
                    )

    return run


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    """Totals of each batch's keys, and in a row without batch the bucket's tokens and how many keys have any."""
    keys = [np.cumsum(_unpack(x.as_py()), dtype=np.uint64) for x in asked["keys"]]
    _, number = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_unpack(x.as_py()) for x in asked["counts"]])
    sums = np.bincount(number, weights=counts).astype(np.uint64)
    ends = np.cumsum([len(k) for k in keys])
    totals = [_pack(sums[x]) for x in np.split(number, ends[:-1])]
    n, b = (x.as_py() for x in key)
    m = len(totals)
    return pa.table({
        "batch": pa.array([*asked["batch"].to_pylist(), None], pa.string()),
        "n": pa.array([n] * (m + 1), pa.int32()),
        "bucket": pa.array([b] * (m + 1), pa.int32()),
        "totals": pa.array([*totals, None], pa.binary()),
        "tokens": pa.array([None] * m + [int(sums.sum())], pa.int64()),
        "kinds": pa.array([None] * m + [int((sums > 0).sum())], pa.int64()),
    })


class Automaton:
    """The part of the model that a batch of texts meets. A state is a context, named by the number of its n-gram."""

    def __init__(self, texts: _Texts, cfg: LmConfig, root: Callable[[np.ndarray], np.ndarray]):
        self.texts, self.cfg, self.root = texts, cfg, root
        #: By n: for each token the n-gram that it ends, and how often training texts have each.
        self.ends: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}

    def add(self, n: int, ends: np.ndarray, counts: np.ndarray) -> None:
        self.ends[n], self.counts[n] = ends, counts

    def _times(self, n: int) -> np.ndarray:
        """How often training texts have the n-gram that each token ends; 0 where it ends none."""
        at = self.ends[n]
        return np.where(at >= 0, self.counts[n][at], 0)

    def walk(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token whether the root knows it, its log10 probability there, and that from its state.

        The state before a token is its longest context that training texts have: all tokens' states are known from the
        n-grams that end before them, so one sweep takes all tokens a level up, from the root on. What it adds at a level
        is the arc's own probability, or the weight of the failure arc that led below.
        """
        times = self._times(1)
        base = np.log10(self.root(times))
        log, known = base, times > 0
        prior = self.cfg.prior
        for n in range(2, self.cfg.order + 1):
            context = np.concatenate(([0], times[:-1])) * (self.texts.place >= n - 1)
            times = self._times(n)
            arc = np.log10((times + prior * 10**log) / (context + prior))
            fail = log + np.log10(prior / (context + prior))
            log = np.where(times > 0, arc, fail)
        return known, base, log


def _score(cfg: LmConfig, buckets: dict[int, int], n: int, v: int) -> Callable:
    def root(times: np.ndarray) -> np.ndarray:
        return (times + cfg.smoothing) / (n + cfg.smoothing * (v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).drop_columns("doc_id").to_pylist()[0]
                texts = _Texts.of(row)
                automaton = Automaton(texts, cfg, root)
                answers = {(x["n"], x["bucket"]): x["totals"] for x in row["answers"]}
                for k, keys, at in texts.grams(cfg.order):
                    order, bounds = _deal(keys, buckets[k])
                    counts = np.zeros(len(keys), np.float64)
                    parts = [_unpack(answers[k, b]) for b in range(buckets[k]) if bounds[b] < bounds[b + 1]]
                    if parts:
                        counts[order] = np.concatenate(parts)
                    automaton.add(k, at, counts if len(counts) else np.zeros(1))
                starts = np.cumsum(texts.sizes) - texts.sizes
                known, base, log = (np.add.reduceat(x, starts) for x in (lambda k, b, s: (k.astype(np.int64), b, s))(*automaton.walk()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][i].values, pa.array(texts.sizes), pa.array(known), pa.array(base), pa.array(log)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, learn: Column, cfg: LmConfig = LmConfig()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs, learning from those where learn holds.

    Null and empty texts are their end alone; a null in learn is false; equal rows are scored and counted one by one; without
    training texts every token has probability 1; an empty table gives no rows. A very long text is a batch of its own, in one
    task. Only doc_id, text and what learn reads are read. Words and n-grams are hashed to 64 bits. Each batch's tokens, as
    numbers, are written to the shared folder when this is called, and shuffled once to meet the answers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", learn.alias("learn"), F.col("text").cast("binary").alias("text"))
    schema = f"batch string, doc_id array<{kind}>, learn array<boolean>, sizes array<bigint>, words binary, tokens binary, n_words bigint, n_tokens bigint"
    rows = materialize(texts.mapInArrow(_batch_texts(cfg), schema), "batches")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    buckets = {n: int((sizes["words" if n == 1 else "tokens"] or 0) // cfg.bucket_keys) + 1 for n in range(1, cfg.order + 1)}
    asked = rows.mapInArrow(_ask(cfg.order, buckets), "n int, bucket int, batch string, keys binary, counts binary")
    answers = asked.groupBy("n", "bucket").applyInArrow(_answer, "batch string, n int, bucket int, totals binary, tokens bigint, kinds bigint")
    answers = materialize(answers, "answers")
    total = answers.where("batch IS NULL AND n = 1").agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"] or 0)
    # As many partitions as batches, so that a task holds few of them.
    parts = int(sizes["n"]) + 1
    own = answers.where("batch IS NOT NULL").repartition(parts, "batch").groupBy("batch").agg(F.collect_list(F.struct("n", "bucket", "totals")).alias("answers"))
    met = rows.repartition(parts, "batch").join(own, "batch").drop("batch")
    out = met.mapInArrow(_score(cfg, buckets, n, v), f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = bucket(F.col("doc_id"), 10) == 0
    return score_texts(docs, ~held).withColumn("held_out", held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
