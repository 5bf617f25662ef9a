"""Hard negatives by a vector-approximation file.

The file holds the rows in blocks. Each dimension of a block is cut into cells of about equally many rows, and a row is kept
twice: as the numbers of its cells, a byte a dimension, and as it is. Every anchor meets every block. Tables of the cells'
ends give each row two corners, and these a lower and an upper bound of its score with the anchor; only rows whose bounds
let them into the best positives, or among the best of a window of scores, are scored exactly. What a block finds is merged
over all blocks, so results are those of scoring everything.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize


@dataclass(frozen=True)
class NegativeConfig:
    #: Positives of an anchor, and negatives of an anchor and positive.
    positives: int = 5
    negatives: int = 3
    #: A negative's score is from `least` to `most` hundredths of the positive's.
    least: int = 50
    most: int = 95
    #: Cells a dimension, 256 at most.
    cells: int = 64
    #: Rows of a block, and anchors that meet it together.
    block_rows: int = 4096
    block_anchors: int = 512
    #: Groups of blocks to which all anchors are sent, at most: tasks of a pass.
    stripes: int = 8192


#: Stands for a null vec_id, so that it comes after all others.
_NO_ID = (1 << 63) - 1
#: Candidates scored at once.
_AT_ONCE = 1 << 18


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and v: floor(scale * x) of every component x.

    Rows with a null label, a null vector, or a null, infinite or NaN component are left out. Whole numbers beyond 2^20 in
    size are taken as 2^20: sums over up to 2^13 of their products are exact in doubles.
    """
    x = lambda e: e.cast("double")
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(x(e)) & (F.abs(x(e)) < float("inf")))
    whole = F.transform("embedding", lambda e: F.floor(F.greatest(F.lit(-(2.0**20)), F.least(F.lit(2.0**20), scale * x(e)))).cast("int"))
    kept = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return kept.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors in blocks of vectors of one length."""
    open_: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)

    def close(dims: int) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*open_.pop(dims), strict=True))

    for batch in batches:
        ids, labels, lists = batch["vec_id"].to_numpy(), batch["label"].to_numpy(), batch["v"]
        ends = lists.offsets.to_numpy()
        values, lengths = lists.values.to_numpy(), np.diff(ends)
        for dims in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == dims)
            vectors = values[ends[own][:, None] + np.arange(dims)] if dims else np.zeros((len(own), 0), np.int32)
            for k in range(0, len(own), size):
                part = own[k : k + size]
                open_[dims].append((ids[part], labels[part], vectors[k : k + size]))
                if sum(len(x[0]) for x in open_[dims]) >= size:
                    yield close(dims)
    for dims in list(open_):
        yield close(dims)


def approximate(vectors: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each row and dimension, and the least and largest value in each dimension and cell."""
    n, dims = vectors.shape
    cell = np.zeros((n, dims), np.uint8)
    low, high = np.zeros((dims, cells), np.int32), np.zeros((dims, cells), np.int32)
    for d in range(dims):
        column = np.sort(vectors[:, d])
        edges = np.unique(column[np.arange(cells) * n // cells])
        cell[:, d] = np.searchsorted(edges, vectors[:, d], "right") - 1
        begins = np.searchsorted(column, edges)
        low[d, : len(edges)] = edges
        high[d, : len(edges)] = column[np.r_[begins[1:], n] - 1]
    return cell, low, high


def _file(cfg: NegativeConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vectors in _blocks(batches, cfg.block_rows):
            blobs = [x.tobytes() for x in (ids, labels, *approximate(vectors, cfg.cells), vectors.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([vectors.shape[1]], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], names=["block", "dims", "ids", "labels", "cells", "low", "high", "vectors"])

    return run


def _anchors(cfg: NegativeConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vectors in _blocks(batches, cfg.block_anchors):
            blobs = [x.tobytes() for x in (ids, labels, vectors.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([vectors.shape[1]], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], names=["of", "dims", "a_ids", "a_labels", "a_vectors"])

    return run


class _Pair:
    """A block of anchors before a block of the file."""

    def __init__(self, row: dict, cfg: NegativeConfig) -> None:
        shaped = lambda name, kind, *shape: np.frombuffer(row[name], kind).reshape(*shape) if row["dims"] else np.zeros([max(0, s) for s in shape], kind)
        dims = row["dims"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.a_ids, self.a_labels = np.frombuffer(row["a_ids"], np.int64), np.frombuffer(row["a_labels"], np.int64)
        self.vectors, self.anchors = shaped("vectors", np.int32, len(self.ids), dims), shaped("a_vectors", np.int32, len(self.a_ids), dims)
        cells = shaped("cells", np.uint8, len(self.ids), dims)
        low, high = shaped("low", np.int32, dims, cfg.cells), shaped("high", np.int32, dims, cfg.cells)
        at = np.arange(dims)
        low, high = low[at, cells].T.astype(np.float64), high[at, cells].T.astype(np.float64)
        up, down = np.maximum(self.anchors, 0).astype(np.float64), np.minimum(self.anchors, 0).astype(np.float64)
        self.lower, self.upper = up @ low + down @ high, up @ high + down @ low
        self.same = self.a_labels[:, None] == self.labels[None, :]

    def scores(self, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for k in range(0, len(a), _AT_ONCE):
            s = slice(k, k + _AT_ONCE)
            out[s] = (self.anchors[a[s]].astype(np.int64) * self.vectors[r[s]]).sum(axis=1)
        return out

    def best(self, a: np.ndarray, r: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the first k of each anchor's candidates: higher scores first, then smaller ids."""
        order = np.lexsort((self.ids[r], -scores, a))
        a = a[order]
        place = np.arange(len(a))
        first = np.maximum.accumulate(np.where(np.r_[True, a[1:] != a[:-1]], place, 0)) if len(a) else place
        return order[place - first < k]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or minus infinity."""
    return np.partition(values, -k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def _positives(cfg: NegativeConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pair = _Pair(row, cfg)
                able = pair.same & (pair.a_ids[:, None] != pair.ids[None, :])
                bound = _kth(np.where(able, pair.lower, -np.inf), cfg.positives)
                a, r = np.nonzero(able & (pair.upper >= bound[:, None]))
                scores = pair.scores(a, r)
                keep = pair.best(a, r, scores, cfg.positives)
                yield pa.RecordBatch.from_arrays([pa.array([row["of"]] * len(keep), pa.string()), pa.array(a[keep].astype(np.int32)), pa.array(pair.ids[r[keep]]), pa.array(scores[keep])], names=["of", "i", "positive_id", "positive_score"])

    return run


def _negatives(cfg: NegativeConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                row = batch.slice(b, 1).to_pylist()[0]
                pair = _Pair(row, cfg)
                windows = defaultdict(list)
                for x in row["positives"]:
                    windows[x["place"]].append((x["i"], x["positive_id"], x["positive_score"]))
                for place, found in windows.items():
                    i, positive, score = (np.array(x) for x in zip(*found, strict=True))
                    least, most = -(-cfg.least * score // 100)[:, None], (cfg.most * score // 100)[:, None]
                    lower, upper, other = pair.lower[i], pair.upper[i], ~pair.same[i]
                    bound = _kth(np.where(other & (lower >= least) & (upper <= most), lower, -np.inf), cfg.negatives)
                    a, r = np.nonzero(other & (lower <= most) & (upper >= np.maximum(least, bound[:, None])))
                    scores = pair.scores(i[a], r)
                    inside = (scores >= least[a, 0]) & (scores <= most[a, 0])
                    a, r, scores = a[inside], r[inside], scores[inside]
                    keep = pair.best(a, r, scores, cfg.negatives)
                    a, r = a[keep], r[keep]
                    values = [pa.array([row["of"]] * len(keep), pa.string()), pa.array(i[a].astype(np.int32)), pa.array(np.full(len(keep), place, np.int32)), *map(pa.array, (pair.a_ids[i[a]], positive[a].astype(np.int64), score[a].astype(np.int64), pair.ids[r], scores[keep]))]
                    yield pa.RecordBatch.from_arrays(values, names=["of", "i", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def hard_negatives(rows: DataFrame, anchors: DataFrame, cfg: NegativeConfig = NegativeConfig()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for rows and anchors as quantised gives them.

    An anchor's positives are the `positives` best rows of its label with another vec_id; for each of them the negatives are
    the `negatives` best rows of other labels whose score is within the window, ranked from 1. Scores are inner products, ties go to
    smaller vec_ids, null ones last (nor is 2^63 - 1 told from null). Repeated rows count as often as they occur, repeated
    anchors once. Vectors of different lengths have no score with each other. Empty tables give no rows.

    The file and the anchors' blocks are written to the shared folder. Anchors, as many as they may be, go to each stripe of the file, a
    block at a time: every pair of blocks is worked on by itself, and of each the best few are kept, so no task holds all of
    either side. All anchors meet all rows: work grows with the product of the two.
    """
    file = materialize(rows.mapInArrow(_file(cfg), "block string, dims int, ids binary, labels binary, cells binary, low binary, high binary, vectors binary"), "vector-file")
    asked = materialize(anchors.distinct().mapInArrow(_anchors(cfg), "of string, dims int, a_ids binary, a_labels binary, a_vectors binary"), "anchors")
    n = max(1, min(cfg.stripes, file.count()))
    striped = file.withColumn("stripe", F.pmod(F.crc32(F.col("block").cast("binary")), F.lit(n)).cast("int")).repartition(n, "stripe")

    def met(blocks: DataFrame) -> DataFrame:
        """The anchors' blocks, streamed, with each block of the file. Never by broadcast: Spark takes their size as that of one copy."""
        return blocks.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(striped.hint("merge"), ["stripe", "dims"])

    of_anchor = W.partitionBy("of", "i").orderBy(F.desc("positive_score"), "positive_id")
    found = met(asked).mapInArrow(_positives(cfg), "of string, i int, positive_id bigint, positive_score bigint")
    best = found.withColumn("place", F.row_number().over(of_anchor)).where(F.col("place") <= cfg.positives)
    best = best.groupBy("of").agg(F.collect_list(F.struct("i", "place", "positive_id", "positive_score")).alias("positives"))
    windows = materialize(asked.join(best, "of"), "windows")
    schema = "of string, i int, place int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    scored = met(windows).mapInArrow(_negatives(cfg), schema)
    in_window = W.partitionBy("of", "i", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = scored.withColumn("rank", F.row_number().over(in_window)).where(F.col("rank") <= cfg.negatives)
    given = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return ranked.select("anchor_id", given("positive_id"), "rank", given("negative_id"), "positive_score", "negative_score")


def relabelled(vec_id: Column, label: Column) -> Column:
    """The next label of ten where vec_id is divisible by seven."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = quantised(table.select("vec_id", relabelled(F.col("vec_id"), F.col("label")).alias("label"), "embedding"))
    return hard_negatives(rows, rows.where((F.col("vec_id") % 50 == 0) & (F.col("vec_id") != _NO_ID)))
