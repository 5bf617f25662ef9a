"""Sections, attribution, vectors and composite scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as S
from ..operators import sections as P
from ..operators import series as ts
from .base import EV, FR, Tables, query
from .joins import SECTION, sections
from .kernel import CLICK, ELEMENT, SIG, clicked, elements, r6, signal

SNAP = f"{ELEMENT}, snap AS (SELECT s_suppkey AS snapshot, s_suppkey % 20 AS k, 0 AS vx, CAST(s_suppkey * 7 % 800 AS INT) AS vy, 400 AS vw, 120 AS vh FROM supplier), lm AS (SELECT p_partkey % 20 AS k, p_partkey, dom_id, x, y, w, h FROM el WHERE tag IN ('NAV', 'SECTION'))"


@query(f"WITH {SNAP}, o AS (SELECT snapshot, p_partkey, dom_id, greatest(least(vx + vw, x + w) - greatest(vx, x), 0) * greatest(least(vy + vh, y + h) - greatest(vy, y), 0) AS a FROM snap JOIN lm USING (k)), b AS (SELECT snapshot, dom_id FROM o WHERE a > 0 QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY a DESC, p_partkey) = 1) SELECT snapshot, coalesce(dom_id, CASE WHEN vy + vh / 2.0 < 900 / 3.0 THEN 'top' WHEN vy + vh / 2.0 < 600 THEN 'middle' ELSE 'bottom' END) AS section, CASE WHEN dom_id IS NULL THEN 'scroll_band' ELSE 'landmark' END AS source FROM snap LEFT JOIN b USING (snapshot)")
def section_assign(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    snaps = t.supplier.select(k.alias("snapshot"), (k % 20).alias("k"), F.lit(0).alias("vx"), (k * 7 % 800).cast("int").alias("vy"), F.lit(400).alias("vw"), F.lit(120).alias("vh"))
    marks = elements(t).where("tag IN ('NAV', 'SECTION')").select((F.col("p_partkey") % 20).alias("k"), "p_partkey", "dom_id", "x", "y", "w", "h")
    return P.assign_sections(snaps, marks, "k", ("vx", "vy", "vw", "vh"), ("x", "y", "w", "h"), "p_partkey", 900.0).select("snapshot", "section", "source")


REPORT = SECTION + ", rep AS (SELECT session_id, section, count(*) AS dwell, avg(engagement) AS mean, median(engagement) AS median, avg(CASE WHEN engagement > 0.05 THEN 1.0 ELSE 0.0 END) AS pct_engaging, avg(CASE WHEN engagement < -0.05 THEN 1.0 ELSE 0.0 END) AS pct_boring, arg_max(t_idx, engagement) AS peak_t FROM sc GROUP BY ALL)"


def report(t: Tables) -> DataFrame:
    return P.section_report(sections(t), ["session_id", "section"], "t_idx", "engagement", 0.05, -0.05)


@query(f"WITH {REPORT} SELECT session_id, section, dwell, round(mean, 6) AS mean, round(median, 6) AS median, round(pct_engaging, 6) AS pct_engaging, round(pct_boring, 6) AS pct_boring, peak_t FROM rep")
def section_report(t: Tables) -> DataFrame:
    return report(t).select("session_id", "section", "dwell", "peak_t", *[r6(c, c) for c in ("mean", "median", "pct_engaging", "pct_boring")])


@query(f"WITH {REPORT}, a AS (SELECT session_id, section, concat_ws(',', CASE WHEN pct_boring > 0.4 AND dwell < 8 THEN 'shorten_or_raise_cta' WHEN pct_boring > 0.35 THEN 'stronger_hook' END, CASE WHEN pct_engaging < 0.15 AND mean > 0 THEN 'raise_contrast' END, CASE WHEN mean > 1.5 AND dwell >= 10 THEN 'repeat_layout' END) AS tips FROM rep) SELECT session_id, section, CASE WHEN tips = '' THEN 'monitor' ELSE tips END AS tips FROM a")
def recommendations(t: Tables) -> DataFrame:
    return report(t).select("session_id", "section", F.array_join(P.advice(*map(F.col, ("mean", "pct_boring", "pct_engaging", "dwell"))), ",").alias("tips"))


@query(f"WITH {REPORT} SELECT session_id, section, 'Section ' || section || ' held ' || dwell || ' frames; peak at ' || peak_t || '.' AS narrative FROM rep")
def narrative_text(t: Tables) -> DataFrame:
    return report(t).select("session_id", "section", F.format_string("Section %d held %d frames; peak at %d.", "section", "dwell", "peak_t").alias("narrative"))


SAMP = f"{EV}, smp AS (SELECT session_id, t_idx, event_id, channel AS element, value, CASE WHEN event_id % 3 = 0 THEN 'real' ELSE 'proxy' END AS source, 'e' || event_id % 4 AS text FROM ev)"


def samples(t: Tables) -> DataFrame:
    k = F.col("event_id")
    return t.traces().select("session_id", "t_idx", "event_id", F.col("channel").alias("element"), "value", F.when(k % 3 == 0, "real").otherwise("proxy").alias("source"), F.concat(F.lit("e"), (k % 4).cast("string")).alias("text"))


@query(f"WITH {SAMP}, c AS (SELECT session_id, element, source, count(*) AS n FROM smp GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY session_id, element ORDER BY n DESC, source) AS k FROM c), g AS (SELECT session_id, element, avg(value) AS mean_density, count(*) AS n, min(text) AS text FROM smp GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(mean_density, 9) DESC, element) AS rank FROM g) SELECT session_id, element, round(mean_density, 6) AS mean_density, n, text, m.source, rank FROM r JOIN (SELECT session_id, element, source FROM m WHERE k = 1) m USING (session_id, element) WHERE rank <= 3")
def element_rollup_topk(t: Tables) -> DataFrame:
    return P.rollup_elements(samples(t), ["session_id"], "element", "value", "text", "source", 3).select("session_id", "element", r6("mean_density", "mean_density"), "n", "text", "source", "rank")


ATTR = f"{SAMP}, fr2 AS (SELECT DISTINCT session_id, t_idx FROM smp), st AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_idx) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM fr2), kp AS (SELECT session_id, t_idx FROM st WHERE i % CAST(greatest(1, ceil(n / 30)) AS BIGINT) = 0), ag AS (SELECT session_id, element, avg(value * least(1, t_idx / 50)) AS mean, count(*) AS n FROM smp JOIN kp USING (session_id, t_idx) GROUP BY ALL), att AS (SELECT *, coalesce(100 * mean / nullif(max(mean) OVER (PARTITION BY session_id), 0), 0) AS attention, least(1.0, n / 10) AS confidence, CAST(ascii(element) * 7 % 100 AS DOUBLE) AS click FROM ag)"


def attributed(t: Tables) -> DataFrame:
    weight = F.col("value") * F.least(F.lit(1.0), F.col("t_idx") / 50)
    a = P.attribute(samples(t), ["session_id"], "element", "t_idx", weight, 30)
    return a.withColumn("click", (F.ascii("element") * 7 % 100).cast("double"))


@query(f"WITH {ATTR} SELECT session_id, element, n, round(confidence, 6) AS confidence, round(attention, 6) AS attention, round(0.68 * attention + 0.32 * click, 6) AS combined, concat_ws(',', CASE WHEN attention >= 70 AND click < 40 THEN 'high_saliency_low_clickability' END, CASE WHEN click >= 70 AND attention < 45 THEN 'cta_low_saliency' END) AS flags FROM att")
def weighted_attribution(t: Tables) -> DataFrame:
    a, c = F.col("attention"), F.col("click")
    return attributed(t).select("session_id", "element", "n", r6("confidence", "confidence"), r6("attention", "attention"), r6(P.combine(a, c), "combined"), F.array_join(P.mismatch_flags(a, c), ",").alias("flags"))


@query(f"WITH {CLICK} SELECT p_partkey, round(100 * (p_partkey % 100 / 100.0) * (0.35 + 0.65 * (p_partkey % 7 / 6.0)), 6) AS attention, round(0.68 * (100 * (p_partkey % 100 / 100.0) * (0.35 + 0.65 * (p_partkey % 7 / 6.0))) + 0.32 * clickability, 6) AS combined FROM ck")
def section_blend(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    x = clicked(t).withColumn("attention", 100 * (k % 100 / 100.0) * (0.35 + 0.65 * (k % 7 / 6.0)))
    return x.select("p_partkey", r6("attention", "attention"), r6(P.combine(F.col("attention"), F.col("clickability")), "combined"))


@query(f"WITH {CLICK}, c AS (SELECT p_partkey, clickability, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 50 END AS clicks, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 9) / 10.0 END AS rate FROM ck), b AS (SELECT *, CASE WHEN clicks IS NULL THEN clickability ELSE 0.4 * clickability + 0.6 * greatest(100.0 * clicks / max(clicks) OVER (), 100 * rate) END AS blended FROM c) SELECT p_partkey, round(blended, 6) AS blended, clicks IS NOT NULL AS matched FROM b")
def click_blend(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    c = clicked(t).select("p_partkey", "clickability", F.when(k % 3 == 0, k % 50).alias("clicks"), F.when(k % 3 == 0, k % 9 / 10.0).alias("rate"))
    x = c.join(F.broadcast(c.agg(F.max("clicks").alias("top"))))  # a single row
    seen = 0.4 * F.col("clickability") + 0.6 * F.greatest(100.0 * F.col("clicks") / F.col("top"), 100 * F.col("rate"))
    return x.select("p_partkey", r6(F.when(F.col("clicks").isNull(), F.col("clickability")).otherwise(seen), "blended"), F.col("clicks").isNotNull().alias("matched"))


@query(f"WITH {EV}, s AS (SELECT session_id, t_idx, event_id FROM ev WHERE channel = 'error' AND value > 20), n AS (SELECT session_id, t_idx AS st, event_id AS snapshot, value AS heat FROM ev WHERE channel = 'view'), k AS (SELECT s.event_id, snapshot, heat, abs(st - s.t_idx) AS d, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(st - s.t_idx), st) AS k FROM s LEFT JOIN n USING (session_id)) SELECT event_id, snapshot, CASE WHEN snapshot IS NULL THEN 'no_snapshot' WHEN d > 3 THEN 'out_of_reach' WHEN heat < 10 THEN 'no_heat' ELSE 'ok' END AS reason FROM k WHERE k = 1")
def grounding_events(t: Tables) -> DataFrame:
    e = t.traces()
    spikes = e.where("channel = 'error' AND value > 20").select("session_id", "event_id", "t_idx")
    snaps = e.where("channel = 'view'").select("session_id", F.col("event_id").alias("snapshot"), F.col("t_idx").alias("st"), F.col("value").alias("heat"))
    j = ts.nearest(spikes, snaps, ["session_id"], "t_idx", "st", "st", ["snapshot", "st", "heat"])
    reason = F.when(F.col("snapshot").isNull(), "no_snapshot").when(F.abs(F.col("st") - F.col("t_idx")) > 3, "out_of_reach").when(F.col("heat") < 10, "no_heat").otherwise("ok")
    return j.select("event_id", "snapshot", reason.alias("reason"))


@query(f"WITH {SECTION}, m AS (SELECT session_id, avg(display) AS display, 0.48 * avg(display) FILTER (t_idx < ceil(n * 0.25)) + 0.34 * avg(display) + 0.18 * min(display) AS comparison FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM sc) GROUP BY session_id), s AS (SELECT session_id, arg_max(section, round(m, 9) * 1000 - section) AS strongest FROM (SELECT session_id, section, avg(display) AS m FROM sc GROUP BY ALL) GROUP BY session_id) SELECT session_id, round(display, 6) AS display, round(greatest(0, least(100, comparison)), 6) AS comparison, strongest, CAST(greatest(0, least(100, round_even(0.8 * comparison + 0.2 * 50, 0))) AS INT) AS overall FROM m JOIN s USING (session_id)")
def marketing_scores(t: Tables) -> DataFrame:
    """The display curve, the comparison score, the strongest section and a blend with a neutral copy score, by session."""
    x = sections(t).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("session_id")))
    early = F.avg(F.when(F.col("t_idx") < F.ceil(F.col("n") * 0.25), F.col("display")))
    m = x.groupBy("session_id").agg(F.avg("display").alias("display"), (0.48 * early + 0.34 * F.avg("display") + 0.18 * F.min("display")).alias("comparison"))
    best = x.groupBy("session_id", "section").agg(F.avg("display").alias("m")).groupBy("session_id").agg(F.max_by("section", F.round("m", 9) * 1000 - F.col("section")).alias("strongest"))
    return m.join(best, "session_id").select("session_id", r6("display", "display"), r6(S.clip(F.col("comparison"), 0, 100), "comparison"), "strongest", S.clip_score(0.8 * F.col("comparison") + 0.2 * 50).alias("overall"))


@query(f"WITH {SIG}, a AS (SELECT *, CASE WHEN hi - lo < 1e-6 THEN 50 ELSE (novelty - lo) / (hi - lo) * 100 END AS curve FROM (SELECT *, min(novelty) OVER w AS lo, max(novelty) OVER w AS hi FROM sig WINDOW w AS (PARTITION BY session_id))) SELECT session_id, round(avg(curve), 6) AS mean, round(median(curve), 6) AS median, arg_max(t_idx, round(curve, 9) * 1000000 - t_idx) AS peak_t FROM a GROUP BY session_id")
def activation_analysis(t: Tables) -> DataFrame:
    w = W.partitionBy("session_id")
    a = signal(t).withColumn("curve", S.minmax(F.col("novelty"), F.min("novelty").over(w), F.max("novelty").over(w), 100, 50))
    return a.groupBy("session_id").agg(r6(F.avg("curve"), "mean"), r6(F.median("curve"), "median"), F.max_by("t_idx", F.round("curve", 9) * 1000000 - F.col("t_idx")).alias("peak_t"))


CEN = f"{FR}, ex AS (SELECT session_id, t_idx, unnest(range(64)) AS v, unnest(vec) AS x FROM fr), tp AS (SELECT session_id AS template, v, avg(x) AS y FROM ex GROUP BY ALL), tn AS (SELECT template, sqrt(sum(y * y)) AS n FROM tp GROUP BY template), xn AS (SELECT session_id, t_idx, sqrt(sum(x * x)) AS n FROM ex GROUP BY ALL)"


def templates(t: Tables) -> DataFrame:
    """Unit vectors of each session's mean, one row: an array of (template, vec); a few dozen at most."""
    mean = t.frames().select("session_id", F.posexplode("vec").alias("v", "x")).groupBy("session_id", "v").agg(F.avg("x").alias("y"))
    vecs = mean.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "y"))), lambda s: s["y"]).alias("y"))
    return vecs.agg(F.array_sort(F.collect_list(F.struct(F.col("session_id").alias("template"), "y"))).alias("tpl"))


@query(f"WITH {CEN} SELECT session_id, t_idx, template, round(greatest(-1, least(1, sum(x * y) / (any_value(xn.n) + 1e-8) / any_value(tn.n))), 6) AS cosine FROM ex JOIN tp USING (v) JOIN tn USING (template) JOIN xn USING (session_id, t_idx) GROUP BY session_id, t_idx, template")
def cosine_templates(t: Tables) -> DataFrame:
    j = t.frames().join(F.broadcast(templates(t)))  # a single row
    cos = lambda s: S.clip(S.dot(F.col("vec"), s["y"]) / (S.norm(F.col("vec")) + 1e-8) / S.norm(s["y"]), -1, 1)
    rows = j.select("session_id", "t_idx", F.explode(F.transform("tpl", lambda s: F.struct(s["template"].alias("template"), cos(s).alias("cosine")))).alias("c"))
    return rows.select("session_id", "t_idx", "c.template", r6("c.cosine", "cosine"))


@query(f"WITH {CEN} SELECT session_id, t_idx, round(coalesce(sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0), 0), 6) AS cosine FROM ex JOIN tp USING (v) WHERE template = 0 AND v < 16 GROUP BY session_id, t_idx")
def masked_cosine(t: Tables) -> DataFrame:
    j = t.frames().join(F.broadcast(templates(t)))  # a single row
    a, b = F.slice("vec", 1, 16), F.slice(F.filter("tpl", lambda s: s["template"] == 0)[0]["y"], 1, 16)
    return j.select("session_id", "t_idx", r6(F.coalesce(S.dot(a, b) / F.nullif(S.norm(a) * S.norm(b), F.lit(0.0)), F.lit(0.0)), "cosine"))


@query(f"WITH {FR}, m AS (SELECT session_id, t_idx, list_avg(vec) AS m, list_stddev_pop(vec) AS s FROM fr) SELECT session_id, t_idx, CAST(r AS INT) AS region, round(m * (0.85 + 0.03 * r) + 0.1 * s, 6) AS proxy FROM m, range(8) AS x(r)")
def proxy_projection(t: Tables) -> DataFrame:
    n = F.size("vec")
    m = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) / n
    f = t.frames().select("session_id", "t_idx", "vec", m.alias("m"))
    s = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / n)
    f = f.select("session_id", "t_idx", "m", s.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("region"))
    return f.select("session_id", "t_idx", "region", r6(F.col("m") * (0.85 + 0.03 * F.col("region")) + 0.1 * F.col("s"), "proxy"))


@query(f"WITH {EV} SELECT session_id, round(sum(value / 100 * 0.5), 6) AS dwell FROM ev WHERE channel IN ('view', 'click') GROUP BY session_id")
def dwell_proxy(t: Tables) -> DataFrame:
    return t.traces().where("channel IN ('view', 'click')").groupBy("session_id").agg(r6(F.sum(F.col("value") / 100 * 0.5), "dwell"))

