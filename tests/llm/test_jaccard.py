from __future__ import annotations

import random
import re
import time
from collections import defaultdict
from itertools import permutations

import corpus_pipeline as C
import numpy as np
from tidewatch.llm import jaccard as M


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The least doc_id of each group, every two texts compared."""
    sets = [(d, shingles(t)) for d, t in sorted(rows)]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        groups[find(i)].append(d)
    return {min(g) for g in groups.values()}


def copies():
    """Texts, near copies of many similarities, chains of them, a large group, exact copies, short and empty ones."""
    random.seed(4)
    word = lambda: f"w{random.randrange(3000)}"
    texts = ["", " ", "one", "One", "one two three four", "one two three four five", "one two three four six"]
    for n in (8, 20, 45, 60, 100, 200, 300):
        for _ in range(3):
            words = [word() for _ in range(n)]
            texts.append(" ".join(words))
            for _ in range(6):
                if random.random() < 0.5:
                    words = list(words)
                for _ in range(random.randint(0, max(1, n // 40))):
                    words[random.randrange(n)] = word()
                texts.append(" ".join(words))
    base = [word() for _ in range(150)]
    for _ in range(80):
        words = list(base)
        for _ in range(random.randint(1, 5)):
            words[random.randrange(150)] = word()
        texts.append(" ".join(words))
    random.shuffle(texts)
    return list(enumerate(texts + texts[:10]))


def test_stage_against_all_pairs(spark):
    """The pipeline's stage joins what a similarity of 0.8 or more connects, and nothing else."""
    rows = copies()
    want = brute(rows)
    out = C.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = out.select("doc_id", "text").collect()
    assert len(got) == len(want) and {r["doc_id"] for r in got} == want
    assert 20 < len(want) < len(rows) - 80


def test_leaders_are_not_needed(spark, monkeypatch):
    monkeypatch.setattr(M, "STAR_ROUNDS", 0)
    rows = [r for r in copies() if len(r[1]) < 700]
    got = M.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == brute(rows)


def test_edges(edges, empty):
    kept = M.keep_one_similar(edges)
    assert kept.columns == edges.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids.count(6) == 1 and 9 not in ids and 3 not in ids and 4 not in ids and None in ids
    assert M.keep_one_similar(empty).count() == 0


def test_disk_follows_pairs(spark, monkeypatch):
    """Only sets in a pair are written, and the stages leave no more than a few numbers a row in the shared folder."""
    import os

    from tidewatch.llm import common

    random.seed(8)
    passage = " ".join(f"p{random.randrange(10**6)}" for _ in range(60))
    words = lambda n: " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
    # Half of each text is a passage that all have: prefixes meet there, but no two texts are similar but the last two.
    texts = [f"{words(30)} {passage} {words(30)}" for _ in range(400)]
    rows = [*enumerate(texts), (400, f"{texts[0]} more"), (401, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = []

    def written(df, tag):
        out = common.materialize(df, tag)
        if tag == "sets":
            sets.append(out.count())
        return out

    monkeypatch.setattr(M, "materialize", written)
    top = common.scratch_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names if not f.startswith("."))
    before = size()
    kept = {r["doc_id"] for r in C.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert kept == {*range(400), 401} and sets and max(sets) <= 20
    C.line_dedup(spark, docs, "").count()
    files = sum(len([f for f in names if f.endswith(".parquet")]) for _, _, names in os.walk(top))
    assert size() - before < 40 * len(rows) + 2000 * files


def test_many_common_hashes_cost_a_set_little():
    """They were sorted anew with each set, so that work grew with sets times common hashes: some 70 ms a set for these."""
    rng = np.random.default_rng(3)
    common = np.unique(rng.integers(-(2**62), 2**62, M.MOST))
    sets = [np.unique(np.concatenate((rng.integers(-(2**62), 2**62, 400), rng.choice(common, 100)))) for _ in range(200)]
    began = time.process_time()
    found = [M.among(g, common) for g in sets]
    assert time.process_time() - began < 2
    assert all((f == np.isin(g, common)).all() for g, f in zip(sets[:3], found, strict=False))
    assert not M.among(sets[0], common[:0]).any() and not len(M.among(common[:0], common))


def test_shingles_are_told_apart():
    """As many hashes as shingles, in any order of their words, cut at white space only; short texts are one."""
    random.seed(8)
    texts = [" ".join(random.choice("abc") for _ in range(n)) for n in (1, 2, 4, 5, 6, 40, 3000)] + ["A\tb  c", "", " \n"]
    assert [len(M.shingle_set(t.encode(), 5)) for t in texts] == [len(shingles(t)) for t in texts]
    orders = {" ".join(p) for p in permutations("abcde")} | {"a b c d", "a b c", "b a c"}
    assert len({M.shingle_set(t.encode(), 5)[0] for t in orders}) == len(orders)
    assert M.shingle_set(b"x A\tb c d", 5).tolist() == M.shingle_set(b"X a b  C d", 5).tolist()
