"""Documents with the edge cases that every operator must stand."""

from __future__ import annotations

import pytest

EDGES = [
    (1, "The quick brown fox jumps over the lazy dog. It was not amused.", "en", "a", 60),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "en", "b", 4),
    (5, "word " * 5000, "en", "b", 25000),
    (6, "Same text here, and here again.\nSame text here, and here again.", "de", "b", 64),
    (6, "Same text here, and here again.\nSame text here, and here again.", "de", "b", 64),
    (7, "é😀 ünï   text\r\nwith a@b.cc and 10.0.0.1", "fr", "c", 40),
    (None, "no id at all, a row that nobody owns", "en", "c", 36),
    (8, "x" * 3000, "en", "c", 3000),
    (9, "Same text here, and here again.\nSame text here, and here again.", "de", "c", 64),
]
#: Extra columns whose names operators might use themselves.
CLASH = ["fp", "n", "th", "key", "class", "rank", "kept", "spans", "score", "label", "fold", "shard", "group"]


@pytest.fixture(scope="session")
def edges(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"clash-{c}").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()
