from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import lm as M

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


class Plain:
    """The model from plain counts of all n-grams, its automaton walked token by token."""

    def __init__(self, texts, order, prior):
        self.order, self.prior = order, prior
        self.counts = Counter()
        for text in texts:
            t = tokens(text)
            for n in range(1, order + 1):
                self.counts.update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
        words = {k: c for k, c in self.counts.items() if len(k) == 1}
        self.n, self.v = sum(words.values()), len(words)

    def root(self, word):
        return (self.counts[(word,)] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def arc(self, state, word):
        """The probability of a word's arc from a state."""
        if not state:
            return self.root(word)
        below = state[1:]
        low = 1.0
        while below and not self.counts[(*below, word)]:
            low *= self.prior / (self.counts[below] + self.prior)
            below = below[1:]
        return (self.counts[(*state, word)] + self.prior * low * self.arc(below, word)) / (self.counts[state] + self.prior)

    def score(self, text):
        state, total = (), 0.0
        for word in tokens(text):
            while state and not self.counts[(*state, word)]:
                total += math.log10(self.prior / (self.counts[state] + self.prior))
                state = state[1:]
            total += math.log10(self.arc(state, word))
            state = (*state, word)[1 - self.order :] if self.order > 1 else ()
            while state and not self.counts[state]:
                state = state[1:]
        return total


def same(a, b):
    return abs(a - b) < 1e-6 * max(1, abs(a))


def test_query_against_plain_counts(spark, small, documents):
    out = M.op4_lm(spark, small).toPandas().set_index("doc_id")
    rows = documents.select("doc_id", "text").collect()
    assert len(out) == len(rows)
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in rows}
    model = Plain([r["text"] for r in rows if not held[r["doc_id"]]], 2, M.LmConfig().prior)
    assert (out["train_tokens"] == model.n).all()
    for r in rows:
        t, got = tokens(r["text"]), out.loc[r["doc_id"]]
        assert got["held_out"] == held[r["doc_id"]]
        assert same(math.fsum(math.log10(model.root(x)) for x in t), got["base_score"])
        assert (got["n_tokens"], got["n_known"]) == (len(t), sum(model.counts[(x,)] > 0 for x in t))
        assert same(model.score(r["text"]), got["score"])
    unseen = out[out["held_out"]]
    assert unseen["score"].sum() > unseen["base_score"].sum()


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_batches_and_buckets(spark, documents, order):
    """Small batches and many buckets give what one batch and one bucket give."""
    docs = documents.where("doc_id % 7 = 0").select("doc_id", F.substring("text", 1, 3000).alias("text"))
    rows = docs.collect()
    model = Plain([r["text"] for r in rows if r["doc_id"] % 3], order, 5.0)
    out = M.score_texts(docs, F.col("doc_id") % 3 != 0, M.LmConfig(order=order, prior=5.0, batch_tokens=2000, bucket_keys=5000))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    assert all(same(model.score(r["text"]), got[r["doc_id"]]["score"]) for r in rows)


def test_probabilities_sum_to_one():
    model = Plain(["a b a c", "b a b", "c c a"], 3, 2.0)
    words = ["a", "b", "c", "\n"]
    for state in [(), ("a",), ("b",), ("a", "b"), ("c", "c")]:
        unknown = 0.1 / (model.n + 0.1 * (model.v + 1))
        for i in range(len(state)):
            unknown *= 2.0 / (model.counts[state[i:]] + 2.0)
        total = 0.0
        for w in words:
            p, at = 1.0, state
            while at and not model.counts[(*at, w)]:
                p *= 2.0 / (model.counts[at] + 2.0)
                at = at[1:]
            total += p * model.arc(at, w)
        assert abs(total + unknown - 1) < 1e-9


def test_edges(edges, empty):
    rows = M.score_texts(edges, F.col("doc_id") < 8).collect()
    assert len(rows) == edges.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[5]["n_tokens"] == 5001
    assert len({(r["score"]) for r in rows if r["doc_id"] in (6, 9)}) == 1
    assert all(math.isfinite(r["score"]) for r in rows)
    assert M.score_texts(empty, F.lit(True)).count() == 0
    assert all(r["score"] == 0 for r in M.score_texts(edges.where("doc_id = 3"), F.lit(False)).collect())


def test_very_long_texts(spark):
    texts = ["word " * 400_000, "x" * 2_000_000, " " * 2_000_000, "a\n" * 500_000, " ".join(f"w{i}" for i in range(300_000))]
    out = M.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id") < 4).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == {0: 400_001, 1: 2, 2: 1, 3: 500_001, 4: 300_001}
    assert all(math.isfinite(r["score"]) for r in out)
