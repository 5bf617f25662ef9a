"""Operators, functions, sources and streams on literal fixtures."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import boxes, grids, scores, specs, text
from tidewatch.operators import cohorts, joins, ranking, reshape, sections, series, stats, tracks
from tidewatch.sources import clicks, cohort, dimensions, labels, manifest, matrix, sinks
from tidewatch.streaming import policy, windows


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_tiny_atlas_and_norms(spark, tmp_path):
    (tmp_path / "v.csv").write_text("vertex_index,parcel_id,parcel_label,yeo_network_id,yeo_network_name,hemisphere\n" + "\n".join(f"{i},{i // 2 + 1},p{i // 2 + 1},{[1, 2, 3, 7][i // 2]},n,lh" for i in range(8)))
    table = dimensions.read_vertex_table(spark, str(tmp_path / "v.csv"))
    assert table.select("parcel_id").distinct().count() == 4
    ramp = spark.createDataFrame([(t, v, float(t * 8 + v)) for t in range(3) for v in range(8)], "t int, vertex_index long, value double").join(table, "vertex_index")
    means = stats.reduce_groups(ramp, ["t", "parcel_id"], "value", "mean").where("t = 0 AND parcel_id = 1").first()
    assert means["mean"] == 0.5
    nets = stats.mean_of_means(ramp, ["t"], "parcel_id", "yeo_network_id", "value")
    assert {r["yeo_network_id"] for r in nets.collect()} == {1, 2, 3, 7}
    norms = spark.createDataFrame([(10, 0.0, 1.0), (20, 1.0, 2.0)], "parcel long, mean double, std double")
    frames = spark.createDataFrame([(0, 10, 0.0), (0, 20, 5.0)], "t int, parcel long, value double")
    assert {r["parcel"]: r["z"] for r in stats.z_against(frames, norms, "parcel", "value").collect()} == {10: 0.0, 20: 2.0}
    with pytest.raises(Exception, match="no norm"):
        stats.z_against(frames.withColumn("parcel", F.lit(99).cast("long")), norms, "parcel", "value").collect()


def test_legacy_atlas_and_gaps(spark, tmp_path):
    (tmp_path / "old.csv").write_text("vertex_index,region_name\n0,b\n1,a\n2,b\n")
    rows = {r["vertex_index"]: r["parcel_id"] for r in dimensions.read_vertex_table(spark, str(tmp_path / "old.csv")).collect()}
    assert rows == {0: 2, 1: 1, 2: 2}
    (tmp_path / "gap.csv").write_text("vertex_index,region_name\n0,b\n2,a\n")
    with pytest.raises(ValueError, match="vertex_index"):
        dimensions.read_vertex_table(spark, str(tmp_path / "gap.csv"))
    assert dimensions.validate_vertices(dimensions.demo_vertices(spark, 100, 10)).first()["violations"] == 0


def test_scalar_guards(spark):
    z, flat = F.lit(None).cast("double"), F.lit(5.0)
    r = one(spark, scores.magnitude(z), scores.magnitude(F.lit(float("nan"))), scores.minmax(flat, flat, flat, 100, 50), scores.score_from_ratio(F.lit(1.0), 1.0, 0.5), scores.clip_score(F.lit(50.5)), scores.clip_score(F.lit(51.5)), scores.range_midpoint(F.lit("55-60")), scores.range_midpoint(F.lit("x")))
    assert tuple(r) == (0.0, 0.0, 50.0, 50, 50, 52, 57.5, None)
    assert tuple(one(spark, scores.brain_weight(F.lit(3.0), F.lit(3.0)), scores.brain_weight(F.lit(3.0), F.lit(3.0), F.lit(3.0)))) == (1.0, 1.0)


def test_roles_and_clickability(spark):
    rows = [("b", "BUTTON", "", "Get started", 20, 120, 44), ("p", "P", "", "a body of text that is long", 240, 420, 40), ("main-nav", "NAV", "", "", 0, 10, 10), ("x", "A", "", "", 0, 10, 10)]
    df = spark.createDataFrame(rows, "dom_id string, tag string, role string, text string, y int, w int, h int")
    got = {r["dom_id"]: r for r in df.withColumns({"r": scores.display_role(*map(F.col, ("dom_id", "tag", "role", "text"))), "c": scores.clickability(*map(F.col, ("dom_id", "tag", "role", "text", "y", "w", "h")), F.lit(0.5))}).collect()}
    assert (got["b"]["r"], got["p"]["r"], got["x"]["r"]) == ("CTA", "body", "link") and got["b"]["c"] > got["p"]["c"]


def test_boxes(spark):
    box = lambda *v: tuple(map(F.lit, v))
    r = one(spark, boxes.overlap_ratio(box(10, 10, 20, 20), box(0, 0, 100, 100)), boxes.overlap_ratio(box(500, 500, 20, 20), box(0, 0, 100, 100)), boxes.holds_point(box(0, 0, 10, 10), F.lit(10), F.lit(0)), boxes.clip_to_frame(box(0, 900, 10, 10), F.lit(0), F.lit(0), 100, 100))
    assert tuple(r) == (1.0, 0.0, False, None)


def test_copy_scores(spark):
    long = " ".join(["word"] * 600)
    r = one(spark, text.urgency(F.lit("Get started free today")), text.copy_flags(F.lit(600), F.lit(0.0)), text.copy_flags(F.lit(3), F.lit(80.0)), text.clarity(F.lit(600), text.sentence_length(F.lit(long))), text.goal_fit(F.lit("buy the shoes"), F.lit("buy shoes")), text.url_path(F.lit("https://a.b/c?d=1")), text.host(F.lit("not a url")))
    assert r["c0"] == 64.0 and r["c1"] == ["wall_of_text"] and r["c2"] == ["sparse_content", "strong_cta"]
    assert (r["c3"], r["c4"], r["c5"], r["c6"]) == (18.0, 100.0, "/c?d=1", "unknown")


def test_runs_fill_and_cooldown(spark):
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate([1.0, 2.0, 2.0, 0.0, 2.0, 2.0, 2.0])], "s int, t long, v double")
    assert [(r["t_start"], r["t_end"], r["n_frames"]) for r in series.threshold_runs(df, ["s"], "t", "v", 1.5, 3).collect()] == [(4, 6, 3)]
    frames = spark.range(4).select(F.lit(0).alias("s"), F.col("id").alias("t"))
    filled = series.forward_fill(spark.createDataFrame([(0, 1, 7.0)], "s int, t long, v double"), ["s"], "t", frames, ["v"]).orderBy("t").collect()
    assert [r["v"] for r in filled] == [None, 7.0, 7.0, 7.0]
    assert one(spark, series.cooldown(F.array(*[F.lit(x).cast("long") for x in (0, 1, 3, 4, 7)]), 3))["c0"] == [0, 3, 7]
    assert series.sliding(df, ["s"], "t", 3, 2, ["v"]).count() == 3


def test_nearest_takes_the_earlier_on_ties(spark):
    left = spark.createDataFrame([(0, 5, "x"), (0, 0, "y"), (1, 3, "z")], "s int, t long, name string")
    right = spark.createDataFrame([(0, 3, 30), (0, 7, 70), (0, 3, 31)], "s int, u long, shot int")
    got = {r["name"]: r["shot"] for r in series.nearest(left, right, ["s"], "t", "u", "shot", ["shot"]).collect()}
    assert got == {"x": 30, "y": 30, "z": None}


def test_interpolation(spark):
    pts = spark.createDataFrame([("v", t, x) for t, x in [(0.0, 0.0), (0.5, 0.5), (1.0, 1.0), (1.5, 0.5)]], "k string, t double, x double")
    grid = spark.createDataFrame([("v", t) for t in (-1.0, 0.25, 2.0)], "k string, t double")
    held = [r["x"] for r in series.interpolate(grid, pts, ["k"], "t", "x").orderBy("t").collect()]
    free = [r["x"] for r in series.interpolate(grid, pts, ["k"], "t", "x", extrapolate=True).orderBy("t").collect()]
    assert held == [0.0, 0.25, 0.5] and free == [-1.0, 0.25, 0.0]


def test_tracks(spark):
    rng = np.random.default_rng(42)
    frames = spark.createDataFrame([("a", t, rng.normal(size=8).tolist()) for t in range(40)], "s string, t long, vec array<double>")
    short = tracks.activation_track(frames, frames.limit(5), ["s"], "t", "vec")
    full = tracks.activation_track(frames, frames, ["s"], "t", "vec")
    assert not short.first()["from_baseline"] and full.first()["from_baseline"]
    assert abs(full.agg(F.avg("z")).first()[0]) < 1e-9
    x = spark.createDataFrame([("a", 0, None, 1.0), ("a", 1, 2.0, 3.0)], "s string, t long, e double, a double")
    assert {r["source"] for r in tracks.source_fallback(x, ["s"], [("e", "e"), ("a", "a")], "partial").collect()} == {"a"}


def test_sections(spark):
    views = spark.createDataFrame([(0, "p", 0, 0, 1000, 800), (1, "q", 0, 2000, 1000, 800)], "snap int, k string, vx int, vy int, vw int, vh int")
    marks = spark.createDataFrame([("p", 0, "#hero", 0, 0, 1000, 400), ("p", 1, "#low", 0, 500, 1000, 100)], "k string, place int, dom_id string, x int, y int, w int, h int")
    got = {r["snap"]: r["section"] for r in sections.assign_sections(views, marks, "k", ("vx", "vy", "vw", "vh"), ("x", "y", "w", "h"), "place", 3000.0).collect()}
    assert got == {0: "#hero", 1: "bottom"}
    m = spark.createDataFrame([("s", "hero", 0.2), ("s", "pricing", 1.0)], "s string, section string, m double")
    ranks = {r["section"]: (r["rank"], r["label"], r["score"]) for r in ranking.rank_sections(m, ["s"], "section", "m").collect()}
    assert ranks == {"pricing": (1, "strongest", 100), "hero": (2, "weakest", 0)}
    assert one(spark, sections.advice(F.lit(0.0), F.lit(0.5), F.lit(0.5), F.lit(5)))["c0"] == ["shorten_or_raise_cta"]


def test_joins_and_sets(spark):
    e = spark.createDataFrame([(i, c) for i, c in enumerate("aaaabbc")], "i int, label string")
    assert joins.balance(e, "label", "a", "i").groupBy("label").count().where("label = 'a'").first()["count"] == 1
    with pytest.raises(Exception, match="not covered"):
        joins.relabel(e, "label", {"x": ["a", "b"]}, "m").collect()
    with pytest.raises(ValueError):
        joins.relabel(e, "label", {"x": ["a"], "y": ["a"]}, "m")
    pairs = joins.overlap_join(spark.createDataFrame([(1, 0, 0, 50, 50)], "a int, x int, y int, w int, h int"), spark.createDataFrame([(2, 10, 10, 300, 300)], "b int, u int, v int, p int, q int"), ("x", "y", "w", "h"), ("u", "v", "p", "q"), 20)
    assert [round(r["ratio"], 3) for r in pairs.collect()] == [0.64]
    kept = joins.keep_or_all(spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.9), (2, 0.1)], "g int, r double"), ["g"], F.col("r") >= 0.5)
    assert sorted((r["g"], r["r"]) for r in kept.collect()) == [(1, 0.1), (1, 0.2), (2, 0.9)]


def test_first_match_makes_no_pairs(spark):
    names = ["", "a", "ab", "bc", "abc", "äb", "zäbz", "q", None, "abcd", "x"]
    left = spark.createDataFrame([(i, n, "t" if i % 3 else "u") for i, n in enumerate(names)], "i int, name string, pt string")
    shown = [(7, "abc", "t"), (3, "b", "v"), (5, "xäbx", "u"), (2, "abc", "w"), (9, None, "t"), (4, "q", "t")]
    right = spark.createDataFrame(shown, "o int, sel string, txt string")
    want = {}
    for i, n in enumerate(names):
        tiers = [(t, o) for o, s, x in shown for t in ([1] if n is not None and s == n else []) + ([2] if None not in (n, s) and (n in s or s in n) else []) + ([3] if x == ("t" if i % 3 else "u") else [])]
        want[i] = min(tiers)
    out = joins.first_match(left, right, "i", [("same", "name", "sel"), ("within", "name", "sel"), ("same", "pt", "txt")], "o")
    assert {r["i"]: (r["tier"], r["o"]) for r in out.collect()} == want
    none = joins.first_match(left.where("name = 'x'"), right, "i", [("within", "name", "sel")], "o").collect()
    assert [(r["o"], r["tier"]) for r in none] == [(5, 1)]
    assert joins.first_match(left.where("name = 'x'"), right.where("o = 4"), "i", [("within", "name", "sel")], "o").first()["tier"] is None


def test_cohorts(spark):
    df = spark.createDataFrame([(f"s{i}", "x" if i < 25 else "y", float(i % 7), float(i)) for i in range(30)], "subject string, site string, a double, b double")
    members = cohorts.assign_clusters(df, {"all_x": {"site": "x"}, "all_y": {"site": "y"}}, "subject")
    assert {(r["cluster"], r["suppressed"]) for r in members.collect()} == {("all_x", False), ("all_y", True)}
    ci = cohorts.bootstrap_mean(df, ["site"], "subject", "b", 300).where("site = 'x'").first()
    assert ci["low"] < ci["mean"] < ci["high"] and ci["high"] - ci["low"] < 8
    assert cohorts.permutation_p(df.withColumn("c", F.col("b") * 2), "subject", "b", "c", 99).first()["p"] == 0.01
    w = cohorts.logistic_by_gradient(df.withColumn("y", (F.col("b") > 15).cast("int")).withColumn("x", F.col("b") / 30), ["x"], "y", rate=1.0, rounds=30)
    assert w[1] > 0
    out = cohorts.ridge_group_folds(df.withColumn("y", 2 * F.col("a") + 1), "subject", ["a"], "y", 1e-6, 4)
    assert out.where(F.abs(F.col("predicted") - F.col("target")) > 1e-3).count() == 0
    assert stats.auc(df.withColumn("y", (F.col("b") > 15).cast("int")), [], "b", "y").first()["auc"] == 1.0


def test_click_and_label_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Selector,Text,Clicks,Sessions,URL\n#cta,Go,12,100,u\n#hero,,"1,003",,u\n#none,,x,,u\n')
    rows = {r["selector"]: r for r in clicks.read_clicks(spark, str(tmp_path / "c.csv")).collect()}
    assert rows["#cta"]["rate"] == 0.12 and rows["#hero"]["clicks"] == 1003 and "#none" not in rows
    (tmp_path / "l.csv").write_text("Timestamp (microseconds),awe\n166666,1.7\n0,\n")
    got = labels.read_label_series(spark, str(tmp_path / "l.csv"), ["awe"]).collect()
    assert [(round(r["t_sec"], 6), r["awe"]) for r in got] == [(0.166666, 1.0), (0.0, 0.0)]


def test_manifest(spark, tmp_path):
    doc = {"session_id": "s", "dom_snapshots": [{"t_idx": 0, "url": "u", "elements": [{"dom_id": "hero", "tag": "SECTION", "bbox": [0, 0, 9, 9]}, {"dom_id": "b", "tag": "BUTTON", "text": " Go "}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text("{broken")
    m = manifest.read_manifests(spark, str(tmp_path))
    els = manifest.elements(manifest.snapshots(m))
    assert m.count() == 1 and els.count() == 2 and manifest.visible_text(els).first()["text"] == "Go"
    r = one(spark, *[manifest.selector(F.lit(d), F.lit(t), F.lit(h)) for d, t, h in [("#a", "", ""), ("a", "A", '/x"y'), ("main", "DIV", ""), ("x1", "DIV", ""), ("", "", "")]])
    assert tuple(r) == ("#a", 'a[href="/x\\"y"]', "main", "#x1", "")


def test_matrices(spark, tmp_path):
    np.savez(tmp_path / "a.npz", preds=np.arange(24, dtype=np.float32).reshape(3, 8))
    frames = matrix.read_matrices(spark, str(tmp_path / "*.npz"), width=8)
    assert frames.count() == 3 and matrix.to_long(frames, ["path"]).agg(F.sum("value")).first()[0] == 276.0
    assert matrix.stack_frames(frames, 2).count() == 2
    expected = frames.select("path").distinct().union(spark.createDataFrame([("nowhere",)], "path string"))
    assert {r["status"] for r in matrix.classify_frames(frames, expected, "path", 8).collect()} == {"ok", "missing"}
    with pytest.raises(Exception, match="shape"):
        matrix.read_matrices(spark, str(tmp_path / "*.npz"), width=9).collect()


def test_studies(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Subject,Gender,Age\nsub-1,F,35\n2,1,36\n")
    (tmp_path / "b.tsv").write_text("participant_id\tage\tsex\nx\t55-60\tMALE\ny\tn/a\tF\n")
    files = {str(tmp_path / "a.csv"): cohort.Study("one", "one_"), str(tmp_path / "b.tsv"): cohort.Study("two", "two_", needs_age=True), str(tmp_path / "none.csv"): cohort.Study("three", "three_")}
    got = {r["subject_id"]: (r["age"], r["age_band"], r["sex"]) for r in cohort.read_studies(spark, files).collect()}
    assert got == {"one_1": (35.0, "young_adult", "female"), "one_2": (36.0, "middle", "male"), "two_x": (57.5, "older", "male")}
    with pytest.raises(ValueError, match="more than once"):
        cohort.harmonize([cohort.normalize(spark.createDataFrame([("1",), ("1",)], "Subject string"), cohort.Study("o", "o_"))])


def test_bands_rules_front_matter(spark, tmp_path):
    (tmp_path / "b.csv").write_text("norm_start,norm_end,label,interpretation\n0,0.5,low,l\n0.5,1.0001,high,h\n")
    bands = dimensions.read_bands(spark, str(tmp_path / "b.csv"))
    x = spark.createDataFrame([(0.5,), (0.2,), (9.0,)], "x double")
    assert [r["label"] for r in joins.range_bands(x, bands, "x", "norm_start", "norm_end", ["label"]).orderBy("x").collect()] == ["low", "high", "high"]
    (tmp_path / "r.yaml").write_text("- id: a\n  when: {network: Vis, z_above: 1.0, min_duration_s: 0.5}\n  insight_key: k\n")
    assert tuple(dimensions.read_rules(spark, str(tmp_path / "r.yaml")).first()) == ("a", "Vis", 1.0, 0.5, "k")
    (tmp_path / "n.md").write_text("---\ntitle: A note\ntags:\n  - x\n  - y\n---\nbody: no\n")
    assert dimensions.read_front_matter(spark, str(tmp_path / "n.md")).first()["fields"] == {"title": "A note", "tags": "x\ny"}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_sessions(spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, v int"), path)
    sinks.replace_sessions(spark.createDataFrame([("a", 9)], "session_id string, v int"), path)
    assert {tuple(r) for r in spark.read.parquet(path).select("session_id", "v").collect()} == {("a", 9), ("b", 2)}
    left = sinks.clear_sessions(spark, path, spark.createDataFrame([("a",)], "session_id string"), ["session_id"])
    assert [r["session_id"] for r in left.collect()] == ["b"]
    merged = sinks.merge_table(spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("b", "new")], "k string, w string"), ["k"])
    assert {tuple(r) for r in merged.collect()} == {("a", 1, None), ("b", None, "new")}
    assert sinks.first_existing(spark, ["file:///nowhere", f"file://{path}"]) == f"file://{path}"


def test_reshape_and_specs(spark):
    r = one(spark, reshape.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))))
    assert r["c0"] == {"a": 1, "b": 3}
    spec = specs.resolve_spec("fused_v2", window=3)
    names = spec.names(["r1", "r2"])
    assert len(names) == 20 and spec.window == 3
    vec = F.array(*[F.lit(float(i)) for i in range(20)])
    assert one(spark, specs.pick(vec, names, ["r2:mean", "sub:0"]))["c0"] == [2.0, 4.0]
    with pytest.raises(ValueError):
        specs.resolve_spec("none")
    with pytest.raises(ValueError):
        stats.parse_reducers("mean,nope")


def test_grids(spark):
    df = spark.createDataFrame([(1, [[0.0, 1.0], [2.0, 3.0]])], "i int, g array<array<double>>")
    assert grids.resize(df, "g", 3, 3).first()["g"][1][1] == 1.5
    assert abs(sum(map(sum, grids.resize(df, "g", 5, 5, density=True).first()["g"])) - 1) < 1e-9
    heat = grids.stamp(spark.createDataFrame([(1, 10, 10, 20, 20, 0.9), (1, 60, 60, 10, 10, 0.3)], "f int, x int, y int, w int, h int, s double"), ["f"], ("x", "y", "w", "h"), "s", 100, 100, 5)
    top = heat.orderBy(F.desc("heat")).first()
    assert top["heat"] == 1.0 and (top["cx"], top["cy"]) in {(3, 3), (4, 4), (3, 4), (4, 3)}


def test_streams_equal_batches(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    part = events.where("user_id < 20").withColumn("session_id", F.col("user_id"))
    for day, rule in enumerate(("ts < '2024-01-11'", "ts >= '2024-01-11' AND ts < '2024-01-21'", "ts >= '2024-01-21'")):
        part.where(rule).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.replay(spark, str(tmp_path / "in"), part.schema, 3)
    q = windows.tumbling(stream, "ts", "1 day", ["event_type"], "value", watermark="1 hour").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    same = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.collect())
    assert same(spark.table("tumbled")) == same(windows.tumbling(part, "ts", "1 day", ["event_type"], "value"))
    steps = part.select("session_id", series.frame_no(["session_id"], "ts", "event_id").alias("t_idx"), F.col("event_type").alias("channel"))
    steps.coalesce(1).write.parquet(str(tmp_path / "steps"))
    q = policy.stream_policy(windows.replay(spark, str(tmp_path / "steps"), steps.schema), 3).writeStream.format("memory").queryName("acted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    acts = lambda df: sorted((r["session_id"], r["t_idx"], r["budget"], r["action"]) for r in df.collect())
    assert acts(spark.table("acted")) == acts(policy.replay_policy(steps, 3))
