from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidewatch.llm import runs as M


def plain_runs(words, least=12):
    """All runs by their definition: for each period the stretches of equal words so far apart."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x, found = np.array([ids[w] for w in words], np.int64), {}
    for p in range(1, len(x) // 2 + 1):
        same = np.r_[False, x[:-p] == x[p:], False].astype(np.int8)
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            if b - a + p >= max(least, 2 * p):
                found.setdefault((int(a), int(b - a + p)), p)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark, tiny):
    """Every document of the table, some made periodic by the query."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    got = M.op11_runs(spark, tiny)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(plain_row(*r) for r in docs)


@pytest.mark.parametrize("seed", range(6))
def test_random_words(seed):
    """Few different words, so that runs of all periods meet, overlap and nest, in many texts at once."""
    rng = random.Random(seed)
    texts = []
    for _ in range(120):
        words = [rng.randrange(1 + seed) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            at, piece = rng.randrange(len(words) + 1), [rng.randrange(9) for _ in range(rng.randrange(1, 9))]
            words[at:at] = (piece * rng.randrange(1, 9))[: rng.randrange(1, 60)]
        texts.append(words)
    lengths = np.array([len(t) for t in texts])
    for least in (12, 4, 7):
        got = M.find_runs(np.array([w for t in texts for w in t], np.int64), lengths, M.RunConfig(min_words=least, block_pairs=500))
        assert got.tolist() == [[i, *r] for i, t in enumerate(texts) for r in plain_runs(t, least)]


def test_fibonacci_words():
    """Known for many runs at many scales."""
    a, b = [0], [0, 1]
    for _ in range(11):
        a, b = b, b + a
    got = M.find_runs(np.array(b, np.int64), np.array([len(b)]), M.RunConfig())
    assert [tuple(r[1:]) for r in got.tolist()] == plain_runs(b)


def test_edges(spark, edges, empty):
    got = {r["doc_id"]: r for r in M.periodic_runs(edges).collect()}
    assert M.periodic_runs(edges).count() == edges.count() and M.periodic_runs(empty).count() == 0
    assert [tuple(r) for r in got[5]["runs"]] == [(0, 5000, 1)] and got[5]["collapsed"] == "word"
    assert all(got[k]["runs"] == [] and got[k]["collapsed"] == "" and got[k]["n_words"] == 0 for k in (2, 3, 4))
    assert got[None]["collapsed"] == "no id at all, a row that nobody owns"
    for doc_id, text in edges.select("doc_id", "text").distinct().collect():
        words = (text or "").encode().split()
        assert [tuple(r) for r in got[doc_id]["runs"]] == plain_runs(words)


def test_spaces_of_other_scripts_are_letters(spark):
    text = "a b　c " * 13 + "\x1c\x85 end"
    r = M.periodic_runs(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 13, 1)] and r["collapsed"] == "a b　c \x1c\x85 end"


def test_very_long_texts(spark):
    """One word 400,000 times, and 300,000 words that repeat after 100,003."""
    rng = np.random.default_rng(3)
    period = [f"w{i}" for i in rng.integers(0, 50_000, 100_003)]
    docs = spark.createDataFrame([(1, "a " * 400_000), (2, " ".join((period * 3)[:300_000]))], "doc_id int, text string")
    got = {r["doc_id"]: r for r in M.periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 400_000, 1)]
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 300_000, 100_003)] and got[2]["collapsed"] == " ".join(period)
