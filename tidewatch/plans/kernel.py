"""Projections, aggregations and norms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as S
from ..operators import stats
from .base import ACT, EV, FR, Tables, query


def r6(c: object, name: str) -> object:
    return F.round(c, 6).alias(name)




@query(f"WITH {ACT} SELECT session_id, t_idx, parcel, round(avg(value), 6) AS mean, round(avg(abs(value)), 6) AS mean_abs, round(median(value), 6) AS median FROM act GROUP BY ALL")
def group_reduce(t: Tables) -> DataFrame:
    out = stats.reduce_groups(t.activation(), ["session_id", "t_idx", "parcel"], "value", "mean,mean_abs,median")
    return out.select("session_id", "t_idx", "parcel", *[r6(c, c) for c in ("mean", "mean_abs", "median")])


@query(f"WITH {ACT}, p AS (SELECT session_id, t_idx, network, parcel, avg(value) AS v FROM act GROUP BY ALL) SELECT session_id, t_idx, network, round(avg(v), 6) AS value FROM p GROUP BY ALL")
def hierarchy_rollup(t: Tables) -> DataFrame:
    return stats.mean_of_means(t.activation(), ["session_id", "t_idx"], "parcel", "network", "value").select("session_id", "t_idx", "network", r6("value", "value"))


@query(f"WITH {ACT} SELECT session_id, t_idx, network, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(avg(abs(value)), 6) AS mean_abs, round(max(abs(value)), 6) AS max_abs FROM act GROUP BY ALL")
def multi_reducer(t: Tables) -> DataFrame:
    out = stats.reduce_groups(t.activation(), ["session_id", "t_idx", "network"], "value", "mean,std,mean_abs,max_abs")
    return out.select("session_id", "t_idx", "network", *[r6(c, c) for c in ("mean", "std", "mean_abs", "max_abs")])


PARCELS = f"{ACT}, par AS (SELECT session_id, t_idx, parcel, avg(value) AS value FROM act GROUP BY ALL), norm AS (SELECT parcel, avg(value) AS mean, greatest(stddev_pop(value), 1e-8) AS std, count(*) AS n_samples, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.95) AS q95 FROM par GROUP BY parcel)"


def parcels(t: Tables) -> DataFrame:
    """Parcel means, taken within each frame's array: no shuffle."""
    rows = t.frames().select("session_id", "t_idx", F.posexplode(S.block_means(F.col("vec"), 8)).alias("parcel", "value"))
    return rows.withColumn("parcel", F.col("parcel").cast("long"))


@query(f"WITH {PARCELS} SELECT parcel, round(mean, 6) AS mean, round(std, 6) AS std, n_samples, round(q05, 6) AS q05, round(q50, 6) AS q50, round(q95, 6) AS q95 FROM norm")
def norm_stats(t: Tables) -> DataFrame:
    return stats.norm_table(parcels(t), ["parcel"], "value").select("parcel", "n_samples", *[r6(c, c) for c in ("mean", "std", "q05", "q50", "q95")])


@query(f"WITH {PARCELS} SELECT session_id, t_idx, parcel, round((value - mean) / std, 6) AS z FROM par JOIN norm USING (parcel)")
def zscore_vs_norm(t: Tables) -> DataFrame:
    p = parcels(t)
    return stats.z_against(p, stats.norm_table(p, ["parcel"], "value", quantiles=False), "parcel", "value").select("session_id", "t_idx", "parcel", r6("z", "z"))


@query(f"WITH {PARCELS} SELECT session_id, t_idx, parcel, value > q95 AS high FROM par JOIN norm USING (parcel)")
def quantile_flag(t: Tables) -> DataFrame:
    p = parcels(t)
    n = stats.norm_table(p, ["parcel"], "value").select("parcel", "q95")
    return p.join(n, "parcel", "left").select("session_id", "t_idx", "parcel", F.coalesce(F.col("value") > F.col("q95"), F.lit(False)).alias("high"))


@query(f"WITH {EV} SELECT event_id, round(CASE WHEN s < 1e-7 THEN 0 ELSE (value - m) / (s + 1e-8) END, 6) AS z FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM ev WINDOW w AS (PARTITION BY session_id, channel))")
def session_z(t: Tables) -> DataFrame:
    return stats.session_z(t.traces(), ["session_id", "channel"], "value").select("event_id", r6("z", "z"))


@query(f"WITH {ACT}, m AS (SELECT vertex, median(value) AS median, mad(value) AS mad FROM act GROUP BY vertex) SELECT vertex, round(median, 6) AS median, round(greatest(1.4826 * mad, 1e-6), 6) AS scale FROM m")
def robust_mad(t: Tables) -> DataFrame:
    return stats.robust_stats(t.activation(), ["vertex"], "value").select("vertex", r6("median", "median"), r6("scale", "scale"))


@query(f"WITH {EV} SELECT event_id, round(100 * cume_dist() OVER (PARTITION BY session_id ORDER BY value), 6) AS pct FROM ev")
def percentile_rank(t: Tables) -> DataFrame:
    return t.traces().select("event_id", r6(stats.percentile_rank(["session_id"], "value"), "pct"))


@query(f"WITH {EV}, c AS (SELECT * FROM ev WHERE channel = 'click'), v AS (SELECT session_id, value AS ref FROM ev WHERE channel = 'view') SELECT event_id, round((SELECT count(*) FROM v WHERE v.session_id = c.session_id AND ref <= c.value) / nullif((SELECT count(*) FROM v WHERE v.session_id = c.session_id), 0), 6) AS ecdf FROM c")
def ecdf_reference(t: Tables) -> DataFrame:
    e = t.traces()
    return stats.ecdf_against(e.where("channel = 'click'").select("session_id", "event_id", "value"), e.where("channel = 'view'"), ["session_id"], "value").select("event_id", r6("ecdf", "ecdf"))


@query(f"WITH {EV} SELECT event_id, round(CASE WHEN h - l < 1e-6 THEN 50 ELSE (value - l) / (h - l) * 100 END, 6) AS score FROM (SELECT *, min(value) OVER w AS l, max(value) OVER w AS h FROM ev WINDOW w AS (PARTITION BY session_id))")
def minmax_norm(t: Tables) -> DataFrame:
    return t.traces().select("event_id", r6(S.minmax(F.col("value"), F.min("value").over(W.partitionBy("session_id")), F.max("value").over(W.partitionBy("session_id")), 100, 50), "score"))


@query(f"WITH {ACT} SELECT session_id, t_idx, vertex, round(CASE WHEN h - l < 1e-6 THEN 0 ELSE (value - l) / (h - l) END, 6) AS heat FROM (SELECT *, min(value) OVER w AS l, max(value) OVER w AS h FROM act WINDOW w AS (PARTITION BY session_id, t_idx))")
def minmax_unit(t: Tables) -> DataFrame:
    low, high = F.array_min("vec"), F.array_max("vec")
    out = t.frames().select("session_id", "t_idx", F.posexplode(F.transform("vec", lambda x: S.minmax(x, low, high))).alias("v", "heat"))
    return out.select("session_id", "t_idx", F.col("v").cast("long").alias("vertex"), r6("heat", "heat"))


@query(f"WITH {ACT} SELECT session_id, t_idx, vertex, round(abs(value) / nullif(max(abs(value)) OVER (PARTITION BY session_id, t_idx), 0), 6) AS share FROM act")
def max_norm(t: Tables) -> DataFrame:
    w = W.partitionBy("session_id", "t_idx")
    return t.activation().select("session_id", "t_idx", "vertex", r6(F.abs("value") / F.nullif(F.max(F.abs("value")).over(w), F.lit(0.0)), "share"))


@query(f"WITH {ACT}, x AS (SELECT *, exp(value - max(value) OVER (PARTITION BY session_id, t_idx)) AS p FROM act) SELECT session_id, t_idx, vertex, round(p / sum(p) OVER (PARTITION BY session_id, t_idx), 6) AS density FROM x")
def log_density_norm(t: Tables) -> DataFrame:
    w = W.partitionBy("session_id", "t_idx")
    x = t.activation().withColumn("p", F.exp(F.col("value") - F.max("value").over(w)))
    return x.select("session_id", "t_idx", "vertex", r6(F.col("p") / F.sum("p").over(w), "density"))


@query(f"WITH {EV}, z AS (SELECT *, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) AS z FROM ev WINDOW w AS (PARTITION BY session_id)) SELECT event_id, CASE WHEN z > 1 THEN 'high_attention' WHEN z < -1 THEN 'low_attention' END AS label FROM z")
def threshold_label(t: Tables) -> DataFrame:
    z = stats.session_z(t.traces(), ["session_id"], "value", least=0.0)
    return z.select("event_id", S.threshold_label(F.col("z"), 1.0, -1.0, "high_attention", "low_attention").alias("label"))


@query(f"WITH {ACT} SELECT session_id, t_idx, round(avg(abs(value)), 6) AS mean_abs FROM act GROUP BY ALL")
def mean_abs_activation(t: Tables) -> DataFrame:
    return t.frames().select("session_id", "t_idx", r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size("vec"), "mean_abs"))


@query("SELECT c_custkey, CAST(greatest(0, least(100, round_even(50 + 28 * (c_acctbal / 4500.0 - 1) / 0.8, 0))) AS INT) AS score FROM customer")
def rubric_score(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.score_from_ratio(F.col("c_acctbal") / 4500.0, 1.0, 0.8).alias("score"))


NOV = f"{FR}, nov AS (SELECT session_id, t_idx, vec, coalesce(sqrt(list_sum(list_transform(range(1, len(vec) + 1), lambda i: (vec[i] - prev[i]) ** 2))), 0) AS novelty, list_avg(vec[1:16]) AS van, list_avg(vec[49:64]) AS dmn FROM (SELECT *, lag(vec) OVER (PARTITION BY session_id ORDER BY t_idx) AS prev FROM fr)), trk AS (SELECT session_id, t_idx, novelty, van - dmn AS engagement FROM nov)"


def track(t: Tables) -> DataFrame:
    """session_id, t_idx, engagement (first less last network mean), novelty."""
    from ..operators.series import novelty

    mean = lambda a, n: F.aggregate(F.slice("vec", a, n), F.lit(0.0), lambda s, x: s + x) / n
    return novelty(t.frames(), ["session_id"], "t_idx", "vec").select("session_id", "t_idx", "novelty", (mean(1, 16) - mean(49, 16)).alias("engagement"))


SIG = NOV + """, mm AS (SELECT *, CASE WHEN eh - el < 1e-6 THEN 50 ELSE (engagement - el) / (eh - el) * 100 END AS e, CASE WHEN nh - nl < 1e-6 THEN 50 ELSE (novelty - nl) / (nh - nl) * 100 END AS n
  FROM (SELECT *, min(engagement) OVER w AS el, max(engagement) OVER w AS eh, min(novelty) OVER w AS nl, max(novelty) OVER w AS nh FROM trk WINDOW w AS (PARTITION BY session_id))), sig AS (SELECT session_id, t_idx, engagement, novelty, greatest(0, least(100, 0.7 * e + 0.3 * n)) AS display FROM mm)"""


def signal(t: Tables) -> DataFrame:
    """The track with its display curve."""
    part = lambda c: S.minmax(F.col(c), F.min(c).over(W.partitionBy("session_id")), F.max(c).over(W.partitionBy("session_id")), 100, 50)
    return track(t).withColumn("display", S.clip(0.7 * part("engagement") + 0.3 * part("novelty"), 0, 100))


@query(f"WITH {SIG} SELECT session_id, t_idx, round(display, 6) AS display FROM sig")
def compound_signal(t: Tables) -> DataFrame:
    return signal(t).select("session_id", "t_idx", r6("display", "display"))


@query(f"WITH {SIG}, x AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM sig) SELECT session_id, round(greatest(0, least(100, 0.48 * avg(display) FILTER (t_idx < ceil(n * 0.25)) + 0.34 * avg(display) + 0.18 * min(display))), 6) AS score FROM x GROUP BY session_id")
def comparison_score(t: Tables) -> DataFrame:
    x = signal(t).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("session_id")))
    early = F.avg(F.when(F.col("t_idx") < F.ceil(F.col("n") * 0.25), F.col("display")))
    return x.groupBy("session_id").agg(r6(S.clip(0.48 * early + 0.34 * F.avg("display") + 0.18 * F.min("display"), 0, 100), "score"))


@query(f"WITH {NOV}, w AS (SELECT session_id, 0.72 * least(abs(engagement) / 3, 1) + 0.28 * least(abs(novelty) / 3, 1) AS b, least(abs(engagement * 2) / 3, 1) AS m FROM trk) SELECT session_id, round(avg(greatest(0, least(1, CASE WHEN m > 0 THEN 0.65 * b + 0.35 * m ELSE b END))), 6) AS weight FROM w GROUP BY session_id")
def brain_weight(t: Tables) -> DataFrame:
    w = S.brain_weight(F.col("engagement"), F.col("novelty"), F.col("engagement") * 2)
    return track(t).groupBy("session_id").agg(r6(F.avg(w), "weight"))


ELEMENT = "el AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'btn-' WHEN 1 THEN 'hero-' WHEN 2 THEN 'nav-' WHEN 3 THEN 'form-' WHEN 4 THEN 'img-' ELSE 'x-' END || p_partkey AS dom_id, ['BUTTON', 'H1', 'NAV', 'A', 'P', 'SECTION', 'DIV', 'SPAN', 'INPUT'][1 + (p_partkey // 7) % 9] AS tag, CASE WHEN p_partkey % 11 = 0 THEN 'button' ELSE '' END AS role, p_name || ' ' || p_type AS text, CAST(p_partkey % 1000 AS INT) AS x, CAST((p_partkey * 7) % 800 AS INT) AS y, p_size AS w, p_size * 2 AS h FROM part)"
ROLE = "CASE WHEN tag = 'BUTTON' OR role = 'button' OR contains(dom_id, 'cta') OR contains(dom_id, 'btn') THEN 'CTA' WHEN tag IN ('H1', 'H2') OR contains(dom_id, 'hero') OR contains(dom_id, 'headline') THEN 'headline' WHEN tag = 'NAV' OR role = 'navigation' OR starts_with(dom_id, 'nav') THEN 'nav' WHEN tag = 'FORM' OR role = 'form' OR contains(dom_id, 'form') THEN 'form' WHEN tag = 'IMG' OR role = 'img' OR contains(dom_id, 'image') OR contains(dom_id, 'img') THEN 'image' WHEN tag IN ('HEADER', 'SECTION', 'MAIN') AND length(text) > 40 THEN 'hero' WHEN tag IN ('P', 'SPAN', 'ARTICLE') AND length(text) > 20 THEN 'body' WHEN tag = 'A' THEN 'link' ELSE 'component' END"


def elements(t: Tables) -> DataFrame:
    """Page elements made of parts: dom_id, tag, role, text and a box."""
    k = F.col("p_partkey")
    prefix = F.element_at(F.array(*map(F.lit, ("btn-", "hero-", "nav-", "form-", "img-", "x-", "x-", "x-", "x-"))), (k % 9 + 1).cast("int"))
    tag = F.element_at(F.array(*map(F.lit, ("BUTTON", "H1", "NAV", "A", "P", "SECTION", "DIV", "SPAN", "INPUT"))), (F.floor(k / 7) % 9 + 1).cast("int"))
    return t.part.select("p_partkey", F.concat(prefix, k.cast("string")).alias("dom_id"), tag.alias("tag"), F.when(k % 11 == 0, F.lit("button")).otherwise("").alias("role"), F.concat_ws(" ", "p_name", "p_type").alias("text"), (k % 1000).cast("int").alias("x"), (k * 7 % 800).cast("int").alias("y"), F.col("p_size").alias("w"), (F.col("p_size") * 2).alias("h"))


@query(f"WITH {ELEMENT} SELECT p_partkey, {ROLE} AS display_role FROM el")
def classify_case(t: Tables) -> DataFrame:
    return elements(t).select("p_partkey", S.display_role(*map(F.col, ("dom_id", "tag", "role", "text"))).alias("display_role"))


CLICK = f"""{ELEMENT}, ro AS (SELECT *, {ROLE} AS r FROM el), cl AS (SELECT *, greatest(CASE r WHEN 'CTA' THEN 1.0 WHEN 'link' THEN 0.74 WHEN 'form' THEN 0.70 WHEN 'nav' THEN 0.50 WHEN 'image' THEN 0.24 WHEN 'headline' THEN 0.18 WHEN 'hero' THEN 0.16 WHEN 'body' THEN 0.08 ELSE 0.18 END, CASE WHEN tag IN ('BUTTON', 'A', 'INPUT', 'TEXTAREA', 'SELECT') OR role IN ('button', 'link', 'textbox') THEN 0.78 ELSE 0 END,
  CASE WHEN regexp_matches(lower(text) || chr(10) || dom_id, 'get started|start|try|sign up|signup|book|demo|buy|pricing|contact|learn more|subscribe|download') THEN 0.86 ELSE 0 END) AS weight FROM ro),
  ck AS (SELECT *, round_even(greatest(0, least(100, 100 * (0.48 * weight + 0.20 * pow(least(1.0, w * h / 12000.0), 0.35) + 0.18 * greatest(0, least(1, 1 - (y + h / 2.0) / (1.6 * 1080.0))) + 0.14 * 0.5))), 2) AS clickability FROM cl)"""


def clicked(t: Tables) -> DataFrame:
    c = S.clickability(*map(F.col, ("dom_id", "tag", "role", "text", "y", "w", "h")), F.lit(0.5))
    return elements(t).withColumn("clickability", c)


@query(f"WITH {CLICK} SELECT p_partkey, clickability FROM ck")
def clickability(t: Tables) -> DataFrame:
    return clicked(t).select("p_partkey", "clickability")


@query("SELECT p_partkey, round(least(1, greatest(0, ln(1 + 90 * (p_size * p_size / 2500.0)) / ln(91))), 6) AS score FROM part")
def log_saturation(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", r6(S.clip(F.log1p(90 * (F.col("p_size") * F.col("p_size") / 2500.0)) / F.log1p(F.lit(90.0)), 0, 1), "score"))


@query(f"WITH {ELEMENT} SELECT p_partkey, round((0.5 * least(1, w * h / 5000.0) + 0.3 * (1 - y / 800.0) + 0.2 * abs(x - 500) / 500.0) / (0.5 + 0.3 + 0.2), 6) AS score FROM el WHERE w * h >= 64")
def weighted_mean_parts(t: Tables) -> DataFrame:
    parts = [(0.5, F.least(F.lit(1.0), F.col("w") * F.col("h") / 5000.0)), (0.3, 1 - F.col("y") / 800.0), (0.2, F.abs(F.col("x") - 500) / 500.0)]
    score = sum((w * c for w, c in parts), F.lit(0.0)) / sum(w for w, _ in parts)
    return elements(t).where("w * h >= 64").select("p_partkey", r6(score, "score"))


@query(f"WITH {EV} SELECT event_id, round(1 / (1 + exp(-(0.8 * value / 50 - 1))), 6) AS p FROM ev")
def sigmoid_proj(t: Tables) -> DataFrame:
    return t.traces().select("event_id", r6(S.sigmoid(0.8 * F.col("value") / 50 - 1), "p"))


@query(f"WITH {ACT}, x AS (SELECT *, exp(value - max(value) OVER w) AS p FROM act WINDOW w AS (PARTITION BY session_id, t_idx)) SELECT session_id, t_idx, vertex, round(p / sum(p) OVER (PARTITION BY session_id, t_idx), 6) AS p FROM x")
def softmax_rows(t: Tables) -> DataFrame:
    rows = t.frames().select("session_id", "t_idx", F.posexplode(S.softmax(F.col("vec"))).alias("v", "p"))
    return rows.select("session_id", "t_idx", F.col("v").cast("long").alias("vertex"), r6("p", "p"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 2000 THEN 'young' WHEN c_acctbal < 6000 THEN 'middle' ELSE 'older' END AS band FROM customer")
def band_case(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.bands(F.col("c_acctbal"), (2000.0, 6000.0), ("young", "middle", "older")).alias("band"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size + 2.5 WHEN 1 THEN CAST(p_size AS DOUBLE) END AS mid FROM part")
def parse_range_midpoint(t: Tables) -> DataFrame:
    k = F.col("p_size")
    told = F.when(k % 3 == 0, F.concat_ws("-", k.cast("string"), (k + 5).cast("string"))).when(k % 3 == 1, k.cast("string")).otherwise("n/a")
    return t.part.select("p_partkey", S.range_midpoint(told).alias("mid"))


@query("SELECT event_id, CAST(round_even(epoch_us(ts) / 1000000.0 / 90, 0) AS BIGINT) - CAST(round_even(epoch_us(TIMESTAMP '2024-01-01') / 1000000.0 / 90, 0) AS BIGINT) AS bucket FROM events")
def time_bucket_round(t: Tables) -> DataFrame:
    seconds = lambda ts: F.unix_micros(ts.cast("timestamp")) / 1000000.0
    at = lambda ts: F.bround(seconds(ts) / 90, 0).cast("long")
    return t.events.select("event_id", (at(F.col("ts")) - at(F.lit("2024-01-01").cast("timestamp"))).alias("bucket"))


@query(f"WITH {EV} SELECT event_id, CASE WHEN channel = 'error' THEN 'friction' WHEN value / 50 - 1 >= 1 THEN 'engaging' WHEN value / 50 - 1 <= -0.9 THEN 'boring' WHEN value > 70 THEN 'engaging' ELSE 'neutral' END AS reaction FROM ev")
def reaction_case(t: Tables) -> DataFrame:
    e = F.col("value") / 50 - 1
    flags = F.when(F.col("channel") == "error", F.array(F.lit("friction"))).otherwise(F.array().cast("array<string>"))
    reaction = F.when(F.array_contains(flags, "high_arousal") | F.array_contains(flags, "friction"), "friction").when(e >= 1, "engaging").when(e <= -0.9, "boring").when(F.col("value") > 70, "engaging").otherwise("neutral")
    return t.traces().select("event_id", reaction.alias("reaction"))


@query("SELECT o_custkey, count(*) AS runs, min(o_orderpriority) AS priority, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY o_custkey")
def dedupe_mean(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("runs"), F.min("o_orderpriority").alias("priority"), r6(F.avg("o_totalprice"), "mean_price"))


@query(f"WITH {ACT} SELECT session_id, t_idx, CASE WHEN vertex % 8 < 2 THEN 'joy' WHEN vertex % 8 < 5 THEN 'fear' ELSE 'calm' END AS product, round(max(greatest(0, least(1, value))), 6) AS score FROM act GROUP BY ALL")
def map_max_rollup(t: Tables) -> DataFrame:
    groups = t.spark.createDataFrame([(v, "joy" if v < 2 else "fear" if v < 5 else "calm") for v in range(8)], "source long, product string")
    rows = t.activation().withColumn("source", F.col("vertex") % 8).join(F.broadcast(groups), "source")
    return rows.groupBy("session_id", "t_idx", "product").agg(r6(F.max(S.clip(F.col("value"), 0, 1)), "score"))


@query(f"""WITH {ACT}, p AS (SELECT session_id, t_idx, vertex, exp(value) / sum(exp(value)) OVER (PARTITION BY session_id, t_idx) AS p FROM act), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, t_idx ORDER BY p DESC, vertex) AS k FROM p)
SELECT session_id, t_idx, round(-sum(p * log2(p)), 6) AS entropy_bits, round(-sum(p * log2(p)) / log2(64), 6) AS entropy_norm, min(vertex) FILTER (k = 1) AS peak, round(sum(p) FILTER (k <= 4), 6) AS top_mass FROM r GROUP BY ALL""")
def entropy_topmass(t: Tables) -> DataFrame:
    w = W.partitionBy("session_id", "t_idx")
    p = t.activation().select("session_id", "t_idx", "vertex", (F.exp("value") / F.sum(F.exp("value")).over(w)).alias("p")).withColumn("k", F.row_number().over(w.orderBy(F.desc("p"), "vertex")))
    bits = -F.sum(F.col("p") * F.log2("p"))
    return p.groupBy("session_id", "t_idx").agg(r6(bits, "entropy_bits"), r6(bits / F.log2(F.lit(64.0)), "entropy_norm"), F.min(F.when(F.col("k") == 1, F.col("vertex"))).alias("peak"), r6(F.sum(F.when(F.col("k") <= 4, F.col("p"))), "top_mass"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def class_counts(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME target VALUE v) SELECT target, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS low, max(v) AS high, stddev_pop(v) < 1e-6 AS near_constant FROM u GROUP BY target")
def column_profile(t: Tables) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    u = t.lineitem.select(*cols).unpivot([], cols, "target", "v")
    return u.groupBy("target").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_pop("v"), 4).alias("std"), F.min("v").alias("low"), F.max("v").alias("high"), (F.stddev_pop("v") < 1e-6).alias("near_constant"))


@query(f"WITH {EV} SELECT session_id, count(*) AS n_frames, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value, count(*) FILTER (channel = 'error') AS n_errors, count(*) FILTER (channel = 'purchase') AS n_purchases, round(avg(value) FILTER (channel = 'view'), 6) AS mean_view, count(DISTINCT channel) AS n_channels FROM ev GROUP BY session_id")
def session_features(t: Tables) -> DataFrame:
    of = lambda c: F.count(F.when(F.col("channel") == c, 1))
    return t.traces().groupBy("session_id").agg(F.count(F.lit(1)).alias("n_frames"), r6(F.avg("value"), "mean_value"), r6(F.stddev_pop("value"), "std_value"), of("error").alias("n_errors"), of("purchase").alias("n_purchases"), r6(F.avg(F.when(F.col("channel") == "view", F.col("value"))), "mean_view"), F.countDistinct("channel").alias("n_channels"))


@query(f"WITH {EV} SELECT session_id, round(coalesce(avg(value) FILTER (channel = 'purchase' AND value > 90), avg(value)), 6) AS mean FROM ev GROUP BY session_id")
def coalesce_avg(t: Tables) -> DataFrame:
    wanted = F.avg(F.when((F.col("channel") == "purchase") & (F.col("value") > 90), F.col("value")))
    return t.traces().groupBy("session_id").agg(r6(F.coalesce(wanted, F.avg("value")), "mean"))


@query("WITH s AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY c_nationkey) SELECT count(*) AS n_groups, round(avg(m) FILTER (n >= 50), 6) AS macro_mean, count(*) FILTER (n >= 50 AND m > 4500) >= 2 AND count(*) FILTER (m < 4600) >= 1 AS passed FROM s")
def gate_summary(t: Tables) -> DataFrame:
    s = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m"))
    many = F.count(F.when((F.col("n") >= 50) & (F.col("m") > 4500), 1)) >= 2
    return s.agg(F.count(F.lit(1)).alias("n_groups"), r6(F.avg(F.when(F.col("n") >= 50, F.col("m"))), "macro_mean"), (many & (F.count(F.when(F.col("m") < 4600, 1)) >= 1)).alias("passed"))


@query("WITH g AS (SELECT p_brand, count(*) AS size, count(DISTINCT p_type) AS types, count(DISTINCT p_name) AS names FROM part GROUP BY p_brand) SELECT p_brand, size, types, names, types > 1 AS violates FROM g")
def fd_validate(t: Tables) -> DataFrame:
    g = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("p_type").alias("types"), F.countDistinct("p_name").alias("names"))
    return g.withColumn("violates", F.col("types") > 1)


@query("WITH o AS (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS groups, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS low, max(n) AS high, max(q) AS top FROM o")
def two_level_agg(t: Tables) -> DataFrame:
    o = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"))
    return o.agg(F.count(F.lit(1)).alias("groups"), r6(F.avg("n"), "mean"), r6(F.stddev_pop("n"), "std"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("q").alias("top"))


@query("SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END), 2) AS open_price FROM lineitem GROUP BY l_returnflag")
def conditional_sum(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(0.0)), 2).alias("open_price"))
