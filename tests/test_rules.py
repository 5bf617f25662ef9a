"""Contracts, subsamples, rules by host and columns by name, on literal cases."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import contracts as C
from tidewatch.operators import hosts as H
from tidewatch.sources.dimensions import read_site_sections, site_sections


def marks(df, columns=("k", "s", "v")):
    added, xored = C.checksum(columns)
    return tuple(df.agg(added, xored).first())


def test_a_changed_lost_or_doubled_row_is_found(spark):
    rows = [(i, f"s{i % 5}" if i % 7 else None, i * 0.5) for i in range(200)]
    make = lambda r, n=4: spark.createDataFrame(r, "k int, s string, v double").repartition(n)
    whole = marks(make(rows))
    assert whole == marks(make(rows[::-1], 9))
    others = [rows[1:], rows + rows[:1], [(0, None, 9.5), *rows[1:]], [(0, "", 0.0), *rows[1:]], rows + [(5, "a", 1.0)] * 2, rows[2:] + [rows[2]] * 2, [(0, "null", 0.0), *rows[1:]]]
    assert len({marks(make(r)) for r in others} | {whole}) == len(others) + 1
    assert marks(make(rows[:0])) == ("0", 0)
    parts = [marks(make(rows[:80])), marks(make(rows[80:]))]
    assert whole == (str(int(parts[0][0]) + int(parts[1][0])), parts[0][1] ^ parts[1][1])
    split = lambda a, b: marks(spark.createDataFrame([(a, b)], "k string, s string"), ("k", "s"))
    assert len({split("a|b", "c"), split("a", "b|c"), split("a\\", "|b|c"), split(None, "\\0"), split("\\0", None)}) == 5


def test_contract(spark):
    rows = [(1, "a", [0.5, 1.0], "mesh"), (2, "b", [0.5, math.nan], "mesh"), (2, "c", [0.5], "other"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, c string, v array<double>, m string")
    contract = C.Contract(types={"k": "int", "v": "array<float>", "gone": "int"}, required=("k",), constants={"m": "mesh"}, enums={"c": ("a", "b")}, ranges={"k": (1, 1)}, widths={"v": 2}, finite=("v",), unique=("k",), rows=4, summed=("k", "c"), checksum=("1", 2))
    got = {r["rule"]: (r["expected"], r["found"], r["ok"]) for r in C.check(df, contract).collect()}
    mark = ":".join(map(str, marks(df, ("k", "c"))))
    assert got == {
        "required k": ("0", "1", False), "constant m": ("0", "2", False), "enum c": ("0", "1", False), "range k": ("0", "2", False), "width v": ("0", "2", False), "finite v": ("0", "2", False),
        "type k": ("int", "int", True), "type v": ("array<float>", "array<double>", False), "type gone": ("int", "missing", False), "rows": ("4", "4", True), "checksum": ("1:2", mark, False), "unique k": ("0", "1", False),
    }
    with pytest.raises(ValueError, match="enum c: expected 0, found 1"):
        C.enforce(df, contract)
    fine = C.Contract(types={"k": "int"}, enums={"m": ("mesh", "other")}, rows=4, summed=("k", "c"), checksum=marks(df, ("k", "c")))
    assert C.enforce(df, fine) is df and C.check(df, C.Contract()).count() == 0
    lacking = {r["rule"]: r["ok"] for r in C.check(df, C.Contract(required=("x",), unique=("k", "y"), summed=("z",))).collect()}
    assert lacking == {"column x": False, "column y": False, "column z": False}


def test_subsample(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(500)] + [(1000, "one"), (1001, None)]
    df = spark.createDataFrame(rows, "k int, c string").repartition(5)
    got = {tuple(r) for r in C.stratified_subsample(df, "c", ["k"], 100).collect()}
    order = lambda k: int(hashlib.md5(f"42:{k}".encode()).hexdigest()[:15], 16)
    by = {c: sorted((k for k, x in rows if x == c), key=order) for c in ("big", "small", "one")}
    chosen = [(k, "big") for k in by["big"][:90]] + [(k, "small") for k in by["small"][:10]] + [(1000, "one")]
    assert got == set(sorted(chosen, key=lambda r: order(r[0]))[:100])
    assert C.stratified_subsample(df, "c", ["k"], 501).count() == 501 and C.stratified_subsample(df.limit(0), "c", ["k"], 5).count() == 0


def test_hosts(spark, tmp_path):
    rules = spark.createDataFrame([("example.com",), ("shop.example.com",), ("com",), ("127.0.0.1",), ("1",)], "host string")
    hosts = ["example.com", "Shop.Example.com:8080", "a.shop.example.com.", "badexample.com", "x.org", "127.0.0.1", "9.0.0.1", None, "", "shop.example.com.evil.org"]
    got = {r["h"]: r["rule_host"] for r in H.match_hosts(spark.createDataFrame([(h,) for h in hosts], "h string"), "h", rules).collect()}
    assert got == dict(zip(hosts, ["example.com", "shop.example.com", "shop.example.com", "com", None, "127.0.0.1", None, None, None, None], strict=True))
    text = "sites:\n  a.b:\n    sections:\n      - id: x\n        selectors: ['#x', '.y']\n      - id: z\n  c.d:\n"
    assert [tuple(r) for r in site_sections(spark, text).collect()] == [("a.b", "x", 0, "#x"), ("a.b", "x", 0, ".y")]
    (tmp_path / "sites.yaml").write_text(text)
    assert read_site_sections(spark, str(tmp_path / "sites.yaml")).count() == 2
    assert read_site_sections(spark, str(tmp_path / "none.yaml")).count() == 0 and site_sections(spark, "").count() == 0


def test_selectors(spark):
    rules = spark.createDataFrame([("h", "hero", 1, "#hero"), ("h", "any", 2, "div"), ("h", "box", 0, ".box"), ("o", "other", 0, "div"), ("h", "empty", -1, " ")], "rule_host string, section string, section_place int, selector string")
    elements = spark.createDataFrame([(1, 0, "#hero", "h"), (1, 1, "div.box", "h"), (1, 2, "mybox", "h"), (1, 3, "#hero2", "h"), (1, 4, None, "h"), (1, 5, "div", None), (1, 6, "div#a", "o")], "p int, i int, d string, rule_host string")
    got = {r["i"]: r["section"] for r in H.match_selectors(elements, ["p"], "d", rules, "i").collect()}
    assert got == {0: "hero", 1: "box", 2: "box", 3: "hero", 6: "other"}


def test_columns(spark):
    columns = spark.createDataFrame([(0, "Vis_A"), (1, "Vis"), (2, "Default_B"), (3, "Default_A"), (4, "net_7")], "place int, column string")
    ids = spark.createDataFrame([("Limbic", "net_7"), ("Vis", "net_7"), ("Cont", "net_9")], "name string, column string")
    wanted = ["Vis", "Default", "Vis_B_2", "Limbic", "Cont", "Visual", " Vis "]
    got = {r["name"]: (r["column"], r["tier"]) for r in H.resolve_columns(spark.createDataFrame([(w,) for w in wanted], "name string"), columns, ids).collect()}
    assert got == {"Vis": ("Vis", 1), "Default": ("Default_B", 2), "Vis_B_2": ("Vis", 2), "Limbic": ("net_7", 3), "Cont": (None, None), "Visual": (None, None), " Vis ": ("Vis", 1)}
    assert H.resolve_columns(columns.select(F.col("column").alias("name")).limit(0), columns, ids).count() == 0
