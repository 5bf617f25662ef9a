from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidewatch.llm import sharding as M


def brute_place(key, regions, weights=None):
    weigh = lambda x: (weights or {}).get(x, 1.0) if isinstance(x, int) else sum(map(weigh, x))

    def pick(prefix, nodes):
        if len(nodes) == 1:
            return 0
        u = [(int(hashlib.md5(f"{prefix}/{i}:{key}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12 for i in range(len(nodes))]
        return min(range(len(nodes)), key=lambda i: (-math.log(u[i]) / weigh(nodes[i]), i))

    r = pick("root", regions)
    k = pick(f"r{r}", regions[r])
    return regions[r][k][pick(f"r{r}/{k}", regions[r][k])]


def test_law_slots_and_growth(spark, small, documents):
    rows = M.op7_sharding(spark, small).collect()
    texts = dict(documents.select("doc_id", "text").collect())
    tree, slots = M.HashTree(40).regions(), defaultdict(list)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert r["shard"] == brute_place(str(r["doc_id"]), tree)
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r["grown_shard"] == 40 for r in rows)


def test_every_later_shard_takes_only_into_itself(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    placed = keys.select(*[M.place(F.col("k"), M.HashTree(n)).alias(f"s{n}") for n in range(40, 46)]).collect()
    for r in placed:
        for n in range(40, 45):
            assert r[f"s{n + 1}"] in (r[f"s{n}"], n)


def test_weights_move_rows_only_where_they_change(spark):
    keys = spark.range(6000).select(F.col("id").cast("string").alias("k"))
    even, heavy = M.HashTree(40), M.HashTree(40, weights={3: 2.0, 4: 0.0})
    rows = keys.select("k", M.place(F.col("k"), even).alias("a"), M.place(F.col("k"), heavy).alias("b")).collect()
    moved = Counter((r["a"] // 5, r["b"] // 5) for r in rows if r["a"] != r["b"])
    assert set(moved) == {(0, 0)}
    counts = Counter(r["b"] for r in rows)
    assert counts[4] == 0 and 1.5 < counts[3] / (sum(counts[s] for s in range(5, 40)) / 35) < 2.6


def test_edges(edges, empty):
    rows = M.shard_documents(edges).collect()
    assert len(rows) == edges.count() and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {16}
    assert M.shard_documents(empty).count() == 0
