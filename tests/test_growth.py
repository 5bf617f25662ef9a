"""Work that grows with different values, not with pairs of rows."""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.operators import cohorts, joins, moments, sections
from tidewatch.plans.registry import QUERIES
from tidewatch.streaming import explore


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_equal_boxes_meet_once(spark):
    inner = spark.range(500).select(F.concat(F.lit("d"), "id").alias("a"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(50).alias("w"), F.lit(50).alias("h"))
    outer = spark.range(300).select(F.col("id").alias("b"), *[F.lit(v).alias(c) for c, v in zip("uvpq", (10, 10, 300, 300), strict=True)])
    own, other = ("x", "y", "w", "h"), ("u", "v", "p", "q")
    pairs = joins.box_overlaps(inner, outer, own, other, 20)
    assert [round(r["ratio"], 3) for r in pairs.collect()] == [0.64]
    whole = joins.members(pairs, inner, outer, own, other)
    assert whole.select("a", "b").distinct().count() == whole.count() == 500 * 300
    assert joins.overlap_join(inner.where("a = 'd7'"), outer, own, other, 20).count() == 300


def test_weights_are_those_of_the_number(spark):
    rows = moments.with_weight(spark.range(5000), [F.col("id"), F.lit(3)], "w")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "id", F.lit("3")).cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(16**12))
    want = sum((F.when(u >= p, 1).otherwise(0) for p in moments.POISSON), F.lit(0))
    assert rows.where(F.col("w") != want).count() == 0 and rows.where("w > 2").count() > 0


def test_resampled_rows_are_small(spark, tiny):
    assert "transform(sequence" not in plan(QUERIES["bootstrap_ci"].run(spark, tiny)).lower()


def test_all_replicates_are_drawn(spark, tiny):
    """2000, as the source draws; a nation with a customer or two has some without any."""
    got = QUERIES["bootstrap_ci"].run(spark, tiny).where("n >= 8").select("replicates").distinct().collect()
    assert got and min(r["replicates"] for r in got) > 1990 and max(r["replicates"] for r in got) == 2000


def test_weights_of_many_replicates(spark):
    """Names of one block of the hash and longer ones, of one table or one by one."""
    names = ["7", "x" * 30, "", "x" * 49, "x" * 50, "é" * 40, "y" * 200]
    rows = spark.createDataFrame([(i, n, r) for i, n in enumerate(names) for r in (0, 9, 10, 99, 100, 1023)], "i int, name string, r int")
    want = {(x["i"], x["r"]): x["w"] for x in moments.with_weight(rows, [F.col("name"), F.col("r")], "w").collect()}
    got = moments.poisson_weights([f"{n}:".encode() for n in names], range(1024))
    assert all(got[i, r] == w for (i, r), w in want.items()) and got.max() > 3


def test_resampled_groups_and_gaps(spark, monkeypatch):
    """More groups than a part has, null values and a null key, against weights a row and replicate; parts add up to the whole."""
    rows = spark.range(4000).select("id", (F.col("id") % 83).alias("a"), F.when(F.col("id") % 2 == 0, "e").alias("b"), F.when(F.col("id") % 83 != 4, F.col("id") / 3).alias("v"))
    many = moments.with_weight(rows.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(29)))), [F.col("id"), F.col("r")], "w")
    sums = many.groupBy("a", "b", "r").agg(F.sum(F.when(F.col("w") > 0, F.col("v") * F.col("w"))).alias("s"), F.sum("w").alias("n")).where("n > 0")
    want = {r["a"]: (r["low"], r["high"], r["k"]) for r in sums.where("b = 'e'").groupBy("a").agg(F.percentile(F.col("s") / F.col("n"), F.lit(0.025)).alias("low"), F.percentile(F.col("s") / F.col("n"), F.lit(0.975)).alias("high"), F.count("*").alias("k")).collect()}
    got = {r["a"]: (r["low"], r["high"], r["replicates"]) for r in cohorts.bootstrap_mean(rows, ["a", "b"], "id", "v", 30).collect()}
    assert set(got) == set(want) and got[4] == (None, None, 30)
    assert all(abs(x - y) < 1e-9 for a in set(got) - {4} for x, y in zip(got[a], want[a], strict=True))
    batch = pa.RecordBatch.from_pydict({"a": [1, 2, None, 1, 3, 2], "__name": [b"%d:" % i for i in range(6)], "__v": [1.0, None, 3.0, 4.0, 5.0, 6.0]})
    parts = lambda: [r for b in cohorts._resampled(["a"], 30)(iter([batch])) for r in b.to_pylist()]
    whole = parts()
    for name, n in (("_GROUPS", 3), ("_REPLICATES", 7), ("_NAMES", 2)):
        monkeypatch.setattr(cohorts, name, n)
    assert len(whole) == 4 and parts() == whole


def test_permutations_are_not_broadcast(spark, tiny):
    """The size before explode let Spark collect all permutations of the smaller side."""
    for key in ("permutation_p", "permutation_within_sites"):
        assert "BroadcastHashJoin" not in plan(QUERIES[key].run(spark, tiny))


def test_blend_keeps_halves(spark, tmp_path):
    """0.8 * -9.625 + 0.2 * 41 is a half, and 0.2 * 41 isn't a fifth of 41."""
    spark.createDataFrame([(0, -962.5), (3, -962.5)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(87).select(F.when(F.col("id") < 41, 0).otherwise(3).cast("long").alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(QUERIES["left_join_blend"].sql).fetchall()
    assert sorted((r["c_custkey"], r["score"]) for r in QUERIES["left_join_blend"].run(spark, str(tmp_path)).collect()) == sorted(want)


def test_blend_counts_all_orders(spark, tmp_path):
    """Customers of any number have their orders counted; 50 stands in only where there are none."""
    spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 0.0)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(60).select((F.col("id") % 2).alias("o_custkey"), "id").where("o_custkey = 1 OR id < 20").select("o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    assert sorted((r["c_custkey"], r["score"]) for r in QUERIES["left_join_blend"].run(spark, str(tmp_path)).collect()) == [(0, 2), (1, 6), (2, 10)]


def test_nearest_of_crowded_places(spark):
    a = spark.range(200_000).select("id", (F.col("id") % 3).cast("int").alias("x"), F.lit(0).alias("y"))
    b = spark.range(200_000).select(F.col("id").alias("near"), (F.col("id") % 2 * 5).cast("int").alias("u"), F.lit(0).alias("v"))
    out = joins.nearest_point(a, b, "id", "near", ("x", "y"), ("u", "v"), 40)
    got = {tuple(r) for r in out.select(F.col("id") % 3, "near", "d2").distinct().collect()}
    assert got == {(0, 0, 0.0), (1, 0, 1.0), (2, 0, 4.0)} and out.count() == 200_000


def test_equal_views_meet_once(spark):
    views = spark.range(200_000).select(F.col("id").alias("snap"), F.lit(1).alias("k"), *[F.lit(v).alias(c) for c, v in zip(("vx", "vy", "vw", "vh"), (0, 0, 100, 100), strict=True)])
    marks = spark.range(200_000).select(F.lit(1).alias("k"), (200_000 - F.col("id")).alias("place"), F.concat(F.lit("#"), "id").alias("dom_id"), *[F.lit(v).alias(c) for c, v in zip("xywh", (0, 0, 50, 50), strict=True)])
    out = sections.assign_sections(views, marks, "k", ("vx", "vy", "vw", "vh"), ("x", "y", "w", "h"), "place", 900.0)
    assert [tuple(r) for r in out.groupBy("section", "source").count().collect()] == [("#199999", "landmark", 200_000)]


def test_landmarks_of_any_number(spark, tmp_path):
    """Part 16 is a navigation that fills most of the view of supplier 16; 16 is not divisible by 3."""
    spark.createDataFrame([(16,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(16, "n", "t", 40)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    assert [tuple(r) for r in QUERIES["section_assign"].run(spark, str(tmp_path)).collect()] == [(16, "x-16", "landmark")]


def test_few_moments_are_summed_by_spark(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (1, 2.0, 0.5, 1.0), (None, 4.0, 1.0, 1.0), (2, float("nan"), 1.0, 1.0), (2, None, 1.0, 1.0), (2, float("inf"), 1.0, 1.0), (3, 1.0, 1.0, -1.0)], "g int, a double, b double, y double")
    native = moments.group_moments(rows, "g", ["a", "b"], ["y"])
    assert "MapInArrow" not in plan(native)
    got = {r["g"]: r["m"] for r in native.collect()}
    monkeypatch.setattr(moments, "_NATIVE", 0)
    assert got == {r["g"]: r["m"] for r in moments.group_moments(rows, "g", ["a", "b"], ["y"]).collect()} and set(got) == {1, 3, None}


def test_sessions_are_held_in_small_parts(spark):
    import pyarrow as pa

    step = pa.array([[{"t": 0, "url": "", "path": "/", "at": 0.0, "most": 0.0, "options": []}]] * 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), step], names=["s", "__s"])
    parts = list(explore._fold(explore.ExploreConfig(), "s", "t", (pa.int64(), pa.int64()))(iter([batch])))
    assert max(p.num_rows for p in parts) <= explore._SESSIONS
    assert [v for p in parts for v in p.column(0).to_pylist()] == list(range(1000))
