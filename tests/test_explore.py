"""The exploration policy: literal cases, its fold against one step after the other, its stream against its fold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.streaming import explore as X

HOME = "http://127.0.0.1:8780/index.html"
ELEMENTS = f"array<{X.ELEMENT}>"


def element(dom_id, tag, text="", href="", y=0.0, h=40.0, seen=1.0, view=True, role=None):
    return (dom_id, tag, role, text, href, float(y), float(h), seen, view)


def options(spark, *elements, cfg=X.ExploreConfig()):
    df = spark.createDataFrame([(list(elements),)], f"e {ELEMENTS}")
    return df.select(X.candidates(F.col("e"), F.lit(HOME), cfg=cfg).alias("o")).first()["o"]


def fresh():
    return {"frames": 0, "clicks": 0, "pages": [], "actions": []}


CTA = element("#hero-cta", "BUTTON", "Start free trial", y=100, h=48)


def test_what_can_be_acted_on(spark):
    got = options(spark, element("#copy", "P", "Some body copy", y=400), element("#cta-hero", "BUTTON", "Get started free", y=100, h=48), element("#ext", "A", "External", "https://evil.example.com/page"), element("#out", "A", "Bye", "/logout"), element("a", "A", "Features", "features.html"), element("#x", "A", "", "#part"), element("#hid", "BUTTON", view=False), element(None, "BUTTON"), element("#r", "DIV", role="button"))
    assert [o["selector"] for o in got] == ["#cta-hero", 'a[href="features.html"]', "#r"]
    assert abs(got[0]["base"] - (0.7 + 0.25 + 0.2 * (1 - 124 / 720))) < 1e-12 and got[1]["path"] == "/features.html" and got[0]["path"] == ""
    assert options(spark, CTA, cfg=X.ExploreConfig(deny_selectors=("HERO",))) == [] and options(spark) == []
    assert options(spark, element("#a", "A", "", "/deep/x.html?y=1#z", seen=0.0))[0][3:4] == ("/deep/x.html",)


def test_unvisited_pages_outrank_a_call_to_action(spark):
    got = options(spark, element("#cta-primary", "A", "Start free trial", "pricing.html", y=2000, h=48), element("a", "A", "Features", "features.html", y=20, h=20))
    state = fresh() | {"pages": ["/index.html", "/pricing.html"]}
    assert X.decide(state, HOME, "/index.html", (0, 0), got, X.ExploreConfig()) == ("click", 'a[href="features.html"]', "element_score")
    assert state["clicks"] == 1 and state["actions"] == [f'{HOME}|a[href="features.html"]']
    assert X.decide(state, HOME, "/index.html", (0, 0), got, X.ExploreConfig(max_clicks=1)) == ("stop", "", "page_end_no_actions")


@pytest.mark.parametrize(("scroll", "cfg", "want"), [
    ((200, 3280), {}, ("scroll_down", "", "below_fold_content")),
    ((3100, 3280), {}, ("click", "#hero-cta", "element_score")),
    ((3280, 3280), {}, ("click", "#hero-cta", "element_score")),
    ((200, 3280), {"scroll_before_clicks": False}, ("click", "#hero-cta", "element_score")),
    ((0, 3280), {"max_clicks": 0}, ("scroll_down", "", "below_fold_content")),
    ((0, 0), {"max_clicks": 0}, ("stop", "", "page_end_no_actions")),
    ((0, 0), {"click_threshold": 2.0}, ("click", "#hero-cta", "fallback_click")),
    ((0, 3280), {"max_frames": 0}, ("stop", "", "budget_exhausted")),
])
def test_scroll_then_click(spark, scroll, cfg, want):
    assert X.decide(fresh(), HOME, "/index.html", scroll, options(spark, CTA), X.ExploreConfig(**cfg)) == want


def snapshots(spark, sessions=12, most=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        for t in range(rng.randrange(1, most)):
            found = [element(f"#cta-{rng.randrange(3)}", "BUTTON", rng.choice(["Buy", "x"]), y=rng.randrange(900)), element(f"nav-{rng.randrange(4)}", "A", "", f"/p{rng.randrange(6)}", seen=rng.choice([None, 0.0, 0.1, 0.5, 1.0])), element("a", "A", "", f"q{rng.randrange(6)}.html", y=rng.randrange(900))]
            rows.append((s, t, rng.choice([None, f"http://127.0.0.1:8780/p{rng.randrange(4)}"]), rng.randrange(1500), rng.choice([None, 720, 1500, 2200]), 720, rng.sample(found, rng.randrange(4)) if rng.random() < 0.95 else None))
    df = spark.createDataFrame(rows, f"session int, t int, page_url string, scroll_y int, scroll_height int, client_height int, elements {ELEMENTS}").repartition(4)
    return df.withColumn("options", X.candidates(F.col("elements"), F.lit(HOME))).drop("elements")


CONFIGS = [X.ExploreConfig(), X.ExploreConfig(max_frames=9, max_clicks=3, max_pages=3), X.ExploreConfig(scroll_before_clicks=False, navigate_while_scrolling=False, unvisited_bonus=0.0)]


@pytest.mark.parametrize("cfg", CONFIGS)
def test_fold_equals_steps(spark, cfg):
    df = snapshots(spark)
    got = {(r["session"], r["t"]): (r["action"], r["selector"], r["reason"]) for r in X.replay(df, "session", "t", cfg).collect()}
    states, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["session"], r["t"])):
        path = "/" + r["page_url"].rsplit("/", 1)[1] if r["page_url"] else "/"
        most = max(0, r["scroll_height"] - 720) if r["scroll_height"] else 0
        want[r["session"], r["t"]] = X.decide(states.setdefault(r["session"], fresh()), r["page_url"] or "", path, (r["scroll_y"], most), r["options"], cfg)
    assert got == want and len({a for a, _, _ in got.values()}) == 3
    assert X.replay(df.limit(0), "session", "t", cfg).count() == 0


def test_stream_equals_fold(spark, tmp_path):
    df, cfg = snapshots(spark, 6, 20, 5), CONFIGS[1]
    for i, rule in enumerate(("t < 7", "t >= 7 AND t < 13", "t >= 13")):
        df.where(rule).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    # with timeouts of processing time Spark runs batches without data for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = X.explore_stream(stream, "session", "t", cfg).writeStream.format("memory").queryName("explored").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(240)
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted(spark.table("explored").where("t IS NOT NULL").collect()) == sorted(X.replay(df, "session", "t", cfg).collect())
