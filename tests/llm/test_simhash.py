from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from tidewatch.llm import simhash as M
from tidewatch.llm.components import components


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


def brute_groups(values):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.nonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 2)[0]:
            parent[find(i)] = find(i + 1 + j)
    groups = defaultdict(list)
    for i in range(len(values)):
        groups[find(i)].append(i)
    return groups.values()


def test_fingerprints_and_groups(spark, small, documents):
    out = {r["doc_id"]: r for r in M.op2_simhash(spark, small).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(out) == len(rows)
    for r in rows:
        assert out[r["doc_id"]]["fingerprint"] == f"{brute_fingerprint(r['text']):016x}"
    ids = sorted(out)
    values = np.array([int(out[i]["fingerprint"], 16) for i in ids], np.uint64)
    for group in brute_groups(values):
        assert {out[ids[g]]["component_id"] for g in group} == {min(ids[g] for g in group)}


def test_links_of_crowded_segments(spark):
    random.seed(3)

    def flip(x, n):
        for b in random.sample(range(64), n):
            x ^= 1 << b
        return x

    values = {0, 1, 3, 1 << 63}
    for size in (1, 2, 5, 100, 400):
        chain = [random.getrandbits(64)]
        for _ in range(size):
            chain.append(flip(random.choice(chain), random.choice([1, 2, 2, 3])))
        values |= set(chain)
    low = random.getrandbits(32)
    values |= {(random.getrandbits(32) << 32) | low for _ in range(150)}
    array = np.array(sorted(values), np.uint64)
    signed = array.astype(np.int64).tolist()
    got = {r["node"]: r["root"] for r in components(M.mih_links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    want = {signed[i]: min(signed[j] for j in g) for g in brute_groups(array) if len(g) > 1 for i in g}
    assert got == want


def test_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_edges(edges, empty):
    rows = M.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fp"] == by[3]["fp"] == by[4]["fp"] == 0 and by[4]["component_id"] == 2
    assert by[9]["component_id"] == 6
    assert M.near_duplicates(empty).count() == 0
    kept = M.keep_one(edges)
    assert kept.columns == edges.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids.count(6) == 1 and 9 not in ids and 3 not in ids and None in ids
    assert M.keep_one(empty).count() == 0
