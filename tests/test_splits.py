"""Splits by whole groups against trying every window."""

from __future__ import annotations

import hashlib
import random

import pytest

from tidewatch.operators import splits as S


def plain(rows, fraction, both):
    """rows: group, label. The groups held out, by trying one window after the other."""
    names = sorted({g for g, _ in rows}, key=lambda g: hashlib.md5(f"42:{'' if g is None else g}".encode()).hexdigest())
    n, classes = len(names), {c for _, c in rows if c is not None}
    if n < 2:
        return set()
    held = min(max(1, int(fraction * n + 0.5)), n - 1)
    windows = [{names[(s + i) % n] for i in range(held)} for s in range(n)]
    leaves = [w for w in windows if {c for g, c in rows if c is not None and g not in w} == classes]
    if both:
        return next((w for w in leaves if {c for g, c in rows if c is not None and g in w} == classes), leaves[0] if leaves else set())
    return leaves[0] if leaves else windows[0]


@pytest.mark.parametrize("both", [False, True])
def test_every_window(spark, both):
    rng = random.Random(7)
    for groups, fraction in ((2, 0.5), (5, 0.2), (9, 0.4), (30, 0.1), (30, 0.8), (31, 0.5), (1, 0.5)):
        rare = rng.sample(range(groups), min(groups, 3))
        rows = [(None if g == 0 else f"g{g}", rng.choice([0, 1, None]) if g not in rare else 2) for g in range(groups) for _ in range(4)]
        for data in (rows, [(g, None if c == 2 and g != f"g{rare[0]}" else c) for g, c in rows]):
            df = spark.createDataFrame(data, "g string, c int").repartition(3)
            got = S.split_groups(df, "g", "c", fraction, both).collect()
            assert len(got) == len(data)
            assert {r["g"] for r in got if r["held_out"]} == plain(data, fraction, both)
            assert not {r["g"] for r in got if r["held_out"]} & {r["g"] for r in got if not r["held_out"]}


def test_windows_of_places():
    """All classes, gaps and windows of small circles."""
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randrange(2, 14)
        held = rng.randrange(1, n)
        classes = [sorted(rng.sample(range(n), rng.randrange(1, n + 1))) for _ in range(rng.randrange(1, 4))]
        both, block = rng.random() < 0.5, max(1, min(held, n - held) // 2)
        fine = [s for s in range(n) if all(any((p - s) % n >= held for p in c) and (not both or any((p - s) % n < held for p in c)) for c in classes)]
        spans = [[(min(x), max(x)) for k in range(n) if (x := [p for p in c if p // block == k])] for c in classes]
        assert S._first_start([x for s in spans for x in S._forbidden(s, n, held, both)], n) == (fine[0] if fine else None)


def test_partitioning_and_emptiness(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    a, b = (sorted(S.split_groups(rows.repartition(k), "l_suppkey", "l_returnflag", 0.3).collect()) for k in (2, 9))
    assert a == b and 0 < sum(r["held_out"] for r in a) < len(a)
    assert S.split_groups(rows.limit(0), "l_suppkey", "l_returnflag", 0.3).count() == 0
