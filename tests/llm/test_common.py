from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.llm import common as M


def test_ranks_are_gapless_with_hot_rows(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 2).alias("g"))
    got = M.rank_rows(df, ["g"], "r", spread=8).groupBy("g").agg(F.count("r").alias("n"), F.countDistinct("r").alias("d"), F.min("r").alias("low"), F.max("r").alias("high")).collect()
    assert sum(r["n"] for r in got) == 40_000
    assert all(r["n"] == r["d"] == r["high"] + 1 and r["low"] == 0 for r in got)


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("g"), F.col("id").alias("k"))
    a = {(r["g"], r["k"]): r["r"] for r in M.rank_rows(df.repartition(3), ["g"], "r").collect()}
    b = {(r["g"], r["k"]): r["r"] for r in M.rank_rows(df.repartition(17), ["g"], "r").collect()}
    assert a == b


def test_hot_keys_join_like_others(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = M.join_hot(rows, keyed, "k", "n")
    assert got.columns == ["k", "v", "top"] and got.count() == 30_000
    assert got.where("k = -1").agg(F.countDistinct("top")).first()[0] == 1
    assert M.join_hot(rows.limit(0), keyed.limit(0), "k", "n").count() == 0


def test_words_and_buckets(spark):
    r = spark.createDataFrame([("a\t b c\x0b d", None)], "t string, n long").select(M.words_of(F.col("t")).alias("w"), M.words_of(F.lit(None).cast("string")).alias("e"), M.bucket(F.lit(12), 10).alias("b"), M.bucket(F.col("n"), 10).alias("z")).first()
    import zlib

    assert r["w"] == ["a", "b c", "d"] and r["e"] == [] and r["b"] == zlib.crc32(b"12") % 10 and r["z"] == 0


def test_shuffle_files_go_with_the_write(spark):
    """What a written table was shuffled through is deleted when it is written, not when the driver next collects garbage."""
    import os
    import time

    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before = files()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    df = spark.range(200_000).repartition(7).groupBy((F.col("id") % 50_000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = M.materialize(df, "shuffled")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 50_000 and df.count() == 50_000 and df.count() == 50_000 and spark.conf.get(key) == setting
