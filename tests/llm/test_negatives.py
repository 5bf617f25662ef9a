from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from tidewatch.llm import negatives as M
from tidewatch.llm import sql

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=5, m=3):
    """Rows (vec_id, embedding, label): every score of every anchor."""
    kept = []
    for d, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((d, (label + 1) % 10 if d is not None and d % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    first = lambda x: (-x[1], x[0] is None, x[0] or 0)
    for a, label, v in sorted({x for x in kept if x[0] is not None and x[0] % 50 == 0}):
        scores = [(d, sum(x * y for x, y in zip(v, w, strict=True)), other) for d, other, w in kept if len(w) == len(v)]
        for p, ps, _ in sorted((x for x in scores if x[2] == label and x[0] != a), key=first)[:k]:
            able = [x for x in scores if x[2] != label and 50 * ps <= 100 * x[1] <= 95 * ps]
            for rank, (n, ns, _) in enumerate(sorted(able, key=first)[:m], 1):
                yield (a, p, rank, n, ps, ns)


def key(row):
    return tuple((x is None, x or 0) for x in row)


def mined(spark, rows, cfg=M.NegativeConfig()):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    q = M.quantised(table.select("vec_id", M.relabelled(table.vec_id, table.label).alias("label"), "embedding"))
    return sorted(map(tuple, M.hard_negatives(q, q.where(f"vec_id % 50 = 0 and vec_id <> {M._NO_ID}"), cfg).collect()), key=key)


def test_query(spark, small):
    """All rows of the table against plain scores; and its SQL."""
    got = M.op12_negatives(spark, small)
    assert got.columns == COLUMNS
    got = sorted(map(tuple, got.collect()))
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    assert got == sorted(plain(rows)) and got
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    assert sorted(duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({sql.OP12_NEGATIVES})").fetchall()) == got


@pytest.mark.parametrize("seed", range(3))
def test_small_blocks_and_ties(spark, seed):
    """Few values, so that scores tie everywhere; blocks and cells too small to hold a label."""
    rng = random.Random(seed)
    rows = [(d * 5 if d % 3 else d * 50, [rng.randrange(-2, 4) / 7 for _ in range(3)], rng.randrange(3)) for d in range(300)]
    cfg = M.NegativeConfig(block_rows=17, block_anchors=5, cells=3, stripes=4)
    assert mined(spark, rows, cfg) == sorted(plain(rows), key=key)


def test_edges(spark):
    """Nulls, values that are no numbers, repeated rows and ids, vectors of other lengths, negative and huge values."""
    nan, inf = float("nan"), float("inf")
    rng = random.Random(9)
    rows = [(d, [rng.uniform(-1, 1) for _ in range(4)], d % 2) for d in range(120)]
    rows += [(50, None, 1), (100, [1.0, None, 0.0, 0.0], 1), (150, [1.0, nan, 0.0, 0.0], 1), (200, [inf, 0.0, 0.0, 0.0], 0), (250, [1.0, 1.0, 1.0, 1.0], None)]
    rows += [(None, [0.9, 0.1, 0.2, 0.3], 1), (None, [0.5, 0.1, 0.2, 0.3], 0), (300, [0.5, 0.5], 1), (301, [0.6, 0.5], 1), (302, [0.5, 0.4], 0), (350, [], 1), (351, [], 0), (352, [], 1)]
    rows += rows[40:60] + [(50, [0.3, 0.3, 0.1, -0.2], 0), (53, [0.3, 0.3, 0.1, -0.2], 1), (400, [-1000.0, 3000.0, 1.0, 0.0], 0), (401, [-900.0, 2000.0, 0.0, 0.0], 0), (402, [-800.0, 1500.0, 0.0, 0.0], 1)]
    assert mined(spark, rows) == sorted(plain(rows), key=key)
    table = spark.createDataFrame([(50, [1e30], 1), (51, [1.0], 1)], SCHEMA)
    assert [tuple(r["v"]) for r in M.quantised(table).orderBy("vec_id").collect()] == [(1 << 20,), (256,)]
    assert mined(spark, rows[:1]) == []


def test_empty_table_and_other_columns(spark, small):
    import pyspark.sql.functions as F

    table = spark.read.parquet(f"{small}/embeddings.parquet").select("*", *[F.lit(1).alias(c) for c in ("v", "block", "dims", "rank", "of", "i")])
    q = M.quantised(table)
    assert M.hard_negatives(q.limit(0), q.limit(0)).count() == 0 and M.hard_negatives(q, q.limit(0)).count() == 0
    assert M.hard_negatives(q, q.where("vec_id % 50 = 0")).count() > 0


def test_bounds_hold_and_leave_rows_out(spark):
    """Every score lies within its bounds, and few rows of a random block need scoring. Small enough for BLAS without threads."""
    rng = np.random.default_rng(1)
    vectors, anchors = rng.integers(-90, 90, (1000, 16)).astype(np.int32), rng.integers(-90, 90, (12, 16)).astype(np.int32)
    cells, low, high = M.approximate(vectors, 64)
    ids = np.arange(1000)
    row = {"dims": 16, "ids": ids.tobytes(), "labels": (ids % 2).tobytes(), "cells": cells.tobytes(), "low": low.tobytes(), "high": high.tobytes(), "vectors": vectors.tobytes(), "a_ids": (ids[:12] + 5000).tobytes(), "a_labels": (ids[:12] % 2).tobytes(), "a_vectors": anchors.tobytes()}
    pair = M._Pair(row, M.NegativeConfig())
    exact = (anchors[:, None, :].astype(np.int64) * vectors[None]).sum(axis=2)
    assert (pair.lower <= exact).all() and (exact <= pair.upper).all()
    bound = M._kth(np.where(pair.same, pair.lower, -np.inf), 5)
    assert (pair.same & (pair.upper >= bound[:, None])).sum() < 12 * 80
