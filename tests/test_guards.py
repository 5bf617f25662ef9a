"""Addresses that carry others, and scores of long vectors."""

from __future__ import annotations

import ipaddress
import math
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scores as S
from tidewatch.functions import text as T

REFUSED = [
    "http://[::ffff:7f00:1]/", "http://[64:ff9b::7f00:1]/", "http://[2002:7f00:1::]/", "http://[::7f00:1]/", "http://127.0.0.1%2f/", "http://①②⑦.0.0.1/",
    "http://example.org\\@127.0.0.1/", "http://[::ffff:127.0.0.1]/", "http://[2001::7f00:1]/", "http://[2001:0:7f00::1]/", "http://[2001:db8::1]/", "http://[2001:0db8:1::1]/", "http://[2001:1ff::1]/",
    "http://[fe80::1%25eth0]/", "http://[fc00::1]/", "http://[ff02::1]/", "http://[2606::1::1]/", "http://[2606:1:2:3:4:5:6:7:8]/", "http://[2606:1:2]/", "http://[2606::1", "http://2606::1/", "http://[12345::1]/", "http://[3fff:123::1]/", "http://exa mple.org/", "http://127。0。0。1/", "http://１２７.0.0.1/", "http://ex_ample\t.org/",
]
ALLOWED = ["http://[2606:2800:220:1:248:1893:25c8:1946]/", "https://[2A00:1450:4001::200E]:443/x", "http://[2001:4860:4860::8888]/", "http://[3000::]/", "https://a-b.example.org:8080/x?y=z#w", "http://EXAMPLE.org./", "http://xn--bcher-kva.example/"]


def test_addresses(spark):
    df = spark.createDataFrame([(u,) for u in REFUSED + ALLOWED], "u string")
    got = {r["u"]: r["ok"] for r in df.select("u", T.url_allowed(F.col("u")).alias("ok")).collect()}
    assert [u for u in REFUSED if got[u]] == [] and [u for u in ALLOWED if not got[u]] == []


def test_no_address_that_is_not_global_passes(spark):
    """Random IPv6 texts against the standard library."""
    import random

    rng = random.Random(8)
    heads = ["2001:", "2002:", "2606:", "::", "64:ff9b::", "fe80::", "2001:db8:", "3fff:", "fd00:", "2001:1:", "ff0e:", "3fff:0:", "2001:2:0:"]
    texts = []
    for _ in range(600):
        number = rng.getrandbits(128) if rng.random() < 0.5 else int(ipaddress.ip_address("2001::")) + (rng.getrandbits(rng.randrange(1, 112)))
        texts.append(str(ipaddress.ip_address(number)) if rng.random() < 0.6 else ipaddress.ip_address(number).exploded)
    for h in heads:
        for _ in range(20):
            tail = ":".join(f"{rng.getrandbits(16):x}" for _ in range(rng.randrange(1, 4)))
            texts.append(f"{h}{'' if h.endswith('::') else ':'}{tail}".replace(":::", "::"))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.url_allowed(F.concat(F.lit("http://["), "t", F.lit("]/"))).alias("ok")).where("ok").collect():
        a = ipaddress.ip_address(r["t"])
        assert a.is_global and not a.is_multicast and a.sixtofour is None and a.teredo is None, r["t"]


@pytest.mark.parametrize("n", [1, 20_484])
def test_softmax_of_long_rows(spark, n):
    values = [math.sin(i) * 5 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<double>")
    df.select(S.softmax(F.col("v"))).collect()
    began = time.perf_counter()
    got = df.select(S.softmax(F.col("v")).alias("p")).first()["p"]
    assert time.perf_counter() - began < 3
    powers = [math.exp(v - max(values)) for v in values]
    assert max(abs(a - b / sum(powers)) for a, b in zip(got, powers, strict=True)) < 1e-12


def test_rows_without_numbers(spark):
    nan, inf = math.nan, math.inf
    rows = [[1.0, None, 3.0], [0.0, 0.0], [nan, inf, -inf], [-1.0, 2.0], [5.0], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<double>")
    got = {r["i"]: r for r in df.select("i", S.probability_rows(F.col("v")).alias("p"), S.softmax(F.col("v")).alias("s"), S.softmax_score(F.lit(0.5)).alias("one")).collect()}
    assert [got[i]["p"] for i in range(6)] == [[0.25, 0.0, 0.75], [0.5, 0.5], [1 / 3] * 3, [0.0, 1.0], [1.0], []]
    assert got[2]["s"] == [1 / 3] * 3 and got[4]["s"] == [1.0]
    assert abs(got[0]["one"][1] - 1 / (1 + math.exp(-1.0))) < 1e-12 and abs(sum(got[0]["s"]) - 1) < 1e-12
