from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pandas as pd

from tidewatch.llm import toxicity as M


def brute_segments(scores, lo, hi):
    best = None
    for i in range(lo, hi):
        for j in range(i + 1, hi + 1):
            v = scores[i:j].sum()
            tie = best is not None and abs(v - best[2]) < 1e-12 and j - i < best[1] - best[0]
            if v > 1e-12 and (best is None or v > best[2] + 1e-12 or tie):
                best = (i, j, v)
    if best is None:
        return []
    return [*brute_segments(scores, lo, best[0]), round(best[2], 6), *brute_segments(scores, best[1], hi)]


def test_all_maximal_segments():
    random.seed(1)
    for _ in range(200):
        s = np.array([random.choice([-3, -2, -1, -0.5, 1, 2, 0.5]) for _ in range(random.randint(0, 30))])
        assert [round(x, 6) for *_, x in M.maximal_segments(s)] == brute_segments(s, 0, len(s))


def test_held_out_accuracy(spark, small):
    out = M.op1_toxicity(spark, small).toPandas()
    assert len(out) == 1000 and out["doc_id"].is_unique and out["score"].between(0, 1).all()
    labels = spark.read.parquet(f"{small}/labels.parquet").toPandas()
    both = out.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.9
    toxic, clean = held[held["toxic"] == 1]["score"], held[held["toxic"] == 0]["score"]
    assert np.mean([(t > clean).mean() for t in toxic]) > 0.95


def test_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    model = M.fit_toxicity(edges, labels)
    rows = M.score_toxicity(edges, model).collect()
    assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert M.score_toxicity(empty, M.fit_toxicity(empty, labels.limit(0))).count() == 0


def test_passages_are_found(spark):
    bad = "idiot moron"
    docs = spark.createDataFrame([(i, ("calm words go on and on " * 20) + (bad if i % 2 else "")) for i in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    found = M.score_toxicity(docs, M.fit_toxicity(docs, labels)).where("doc_id % 2 = 1").first()
    assert found["passages"] and bad in found["passages"][0]["passage"]


def plain_scores(texts, marks, cfg):
    """Scores of texts from plain counts; the segments by enumeration, the law and the logistic fit as defined."""
    from collections import Counter

    core = lambda w: w.strip(M.EDGES) or w
    words, starts = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d in texts}
    for d, label in marks.items():
        if 0 < fold[d] < 4:
            for w in texts[d].lower().split():
                words[label][core(w)] += 1
                starts[label][core(w)[: cfg.prefix]] += 1
    toxic, clean = (sum(words[i].values()) for i in (1, 0))
    rate = (toxic + 1) / (toxic + clean + 2)

    def score(w):
        w = core(w)
        p = w[: cfg.prefix]
        prior = (starts[1][p] + cfg.prefix_prior * rate) / (starts[0][p] + starts[1][p] + cfg.prefix_prior)
        r = (words[1][w] + cfg.word_prior * prior) / (words[0][w] + words[1][w] + cfg.word_prior)
        return math.log(r / (1 - r)) - math.log(rate / (1 - rate)) - cfg.drift

    found = {}
    for d, text in texts.items():
        s = np.array([score(w) for w in text.lower().split()])
        found[d] = s, np.array(brute_segments(s, 0, len(s)) or [0.0])
    held = [d for d in marks if fold[d] == 4]
    hist = np.zeros(len(M.BINS) + 1)
    for d in held:
        if not marks[d]:
            hist += np.bincount(np.digitize(found[d][0], M.BINS), minlength=len(hist))
    frame = pd.DataFrame([(len(found[d][0]), found[d][1].max()) for d in held if not marks[d]], columns=["n", "best"])
    lam, k = M._law(hist, frame)

    def features(d):
        norm = lam * found[d][1] - math.log(k * max(len(found[d][0]), 1))
        return [1.0, min(max(norm.max(), -20), 60), math.log1p(norm[norm > 0].sum())]

    x, y = np.array([features(d) for d in held]), np.array([marks[d] for d in held], float)
    w = M._fit_logistic(x[:, 1:], y)
    assert np.abs(x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 1e-2 * w).max() < 1e-6
    return {d: 1 / (1 + math.exp(-float(w @ features(d)))) for d in texts}


def test_scores_against_plain_python(spark):
    """Every segment of a text counts: texts hold up to nine toxic passages."""
    random.seed(6)
    calm, bad = [f"calm{i}" for i in range(40)], [f"foul{i}" for i in range(6)]
    texts, marks = {}, {}
    for d in range(300):
        n = random.choice([0, 0, 1, 2, 5, 9])
        parts = [" ".join(random.choices(calm, k=random.randint(1, 5))) for _ in range(n + 1)]
        texts[d] = " ".join(p for i, part in enumerate(parts) for p in (part, *([random.choice(bad)] if i < n else [])))
        if d % 3:
            marks[d] = int(n > 0) if random.random() < 0.95 else int(n == 0)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    model = M.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r["score"] for r in M.score_toxicity(docs, model).collect()}
    want = plain_scores(texts, marks, M.ToxicityConfig())
    assert all(abs(got[d] - want[d]) < 1e-4 for d in texts)


def test_very_long_texts(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = M.fit_toxicity(documents, labels)
    texts = ["word " * 400_000, "x" * 2_000_000, " " * 2_000_000, "a\n" * 500_000]
    rows = M.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)


def test_few_words_share_a_bucket(documents):
    assert M.collisions(documents) < 0.05


def test_models_are_sent_without_empty_buckets():
    import pickle

    import numpy as np

    from tidewatch.llm.toxicity import ToxicityConfig, ToxicityModel

    rng = np.random.default_rng(1)
    counts, rates = np.zeros((1 << 20, 2), np.float32), np.full(1 << 20, 0.3, np.float32)
    at = rng.integers(0, 1 << 20, 5000)
    counts[at], rates[at] = rng.random((5000, 2)), rng.random(5000)
    full = ToxicityModel(ToxicityConfig(), rng.random((64, 2)).astype(np.float32), 0.4, rng.random(64).astype(np.float32))
    for model in (ToxicityModel(ToxicityConfig(), counts, 0.3, rates, 2.0, 3.0, (1.0, 2.0, 3.0)), full, ToxicityModel(ToxicityConfig())):
        sent = pickle.dumps(model)
        got = pickle.loads(sent)
        assert len(sent) < 200_000 and got.weights == model.weights and got.lam == model.lam
        for a, b in ((got.counts, model.counts), (got.rates, model.rates)):
            assert a.dtype == b.dtype and np.array_equal(a.ravel(), b.ravel())


def test_driver_holds_columns_not_rows(spark):
    """A bucket in use takes tens of bytes of the driver's Python, also where rows are not sent as Arrow by default."""
    import tracemalloc

    docs = spark.range(400).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 999), i -> concat(hex(xxhash64(id, i)), 'x')), ' ') AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    tracemalloc.start()
    try:
        model = M.fit_toxicity(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    used = len(model.counts[2]) // 2 + len(model.rates[2])
    assert used > 350_000 and peak < 100 * used
