"""Joins, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import boxes as B
from ..functions import scores as S
from ..operators import joins as J
from ..operators import ranking as R
from .base import ACT, EV, FR, Tables, query
from .kernel import CLICK, ELEMENT, SIG, clicked, elements, r6, signal

BANDS = [(0.0, 20.0, "S_LO"), (20.0, 40.0, "S_BELO"), (40.0, 60.0, "S_MID"), (60.0, 80.0, "S_ABOVE"), (80.0, 100.001, "S_HI")]


@query(f"WITH {EV} SELECT event_id, CASE WHEN value < 20 THEN 'S_LO' WHEN value < 40 THEN 'S_BELO' WHEN value < 60 THEN 'S_MID' WHEN value < 80 THEN 'S_ABOVE' ELSE 'S_HI' END AS code FROM ev")
def range_band_join(t: Tables) -> DataFrame:
    bands = t.spark.createDataFrame(BANDS, "low double, high double, code string")
    return J.range_bands(t.traces(), bands, "value", "low", "high", ["code"]).select("event_id", "code")


BOXES = f"{ELEMENT}, inn AS (SELECT p_partkey, dom_id, x, y, w, h FROM el), sec AS (SELECT p_partkey AS section, x - x % 100 AS sx, y - y % 100 AS sy FROM el WHERE p_partkey % 10 = 0)"


@query(f"WITH {BOXES}, o AS (SELECT section, dom_id, greatest(least(x + w, sx + 100) - greatest(x, sx), 0) * greatest(least(y + h, sy + 100) - greatest(y, sy), 0) / (w * h) AS ratio FROM inn JOIN sec ON x < sx + 100 AND x + w > sx AND y < sy + 100 AND y + h > sy), f AS (SELECT *, max(CAST(ratio >= 0.5 AS INT)) OVER (PARTITION BY section) AS any_hit FROM o WHERE ratio > 0) SELECT section, dom_id, round(ratio, 6) AS ratio FROM f WHERE any_hit = 0 OR ratio >= 0.5")
def bbox_overlap_join(t: Tables) -> DataFrame:
    e = elements(t)
    sections = e.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("section"), (F.col("x") - F.col("x") % 100).alias("sx"), (F.col("y") - F.col("y") % 100).alias("sy"))
    sections = sections.select("*", F.lit(100).alias("sw"), F.lit(100).alias("sh"))
    own, other = ("x", "y", "w", "h"), ("sx", "sy", "sw", "sh")
    inner = e.select("dom_id", *own)
    pairs = J.keep_or_all(J.box_overlaps(inner, sections, own, other, 200), other, F.col("ratio") >= 0.5)  # a section has one box
    return J.members(pairs.withColumn("ratio", F.round("ratio", 6)), inner, sections, own, other).select("section", "dom_id", "ratio")


@query(f"WITH {ELEMENT} SELECT p_partkey, dom_id FROM el WHERE 500 >= x AND 500 < x + w AND (p_partkey * 13) % 800 >= y AND (p_partkey * 13) % 800 < y + h")
def point_in_box(t: Tables) -> DataFrame:
    e = elements(t)
    return e.where(B.holds_point(tuple(map(F.col, ("x", "y", "w", "h"))), F.lit(500), F.col("p_partkey") * 13 % 800)).select("p_partkey", "dom_id")


@query(f"WITH {ACT}, g AS (SELECT session_id, t_idx, vertex % 8 AS px, vertex // 8 AS py, value FROM act), b AS (SELECT * FROM (VALUES ('a', 0, 0, 4, 4), ('b', 2, 2, 3, 5), ('c', 5, 1, 9, 2)) AS v(box, x, y, w, h)) SELECT session_id, t_idx, box, round(sum(value) / count(*), 6) AS density FROM g JOIN b ON px >= x AND px < x + w AND py >= y AND py < y + h GROUP BY ALL")
def box_density(t: Tables) -> DataFrame:
    """Mean heat in boxes on the 8 x 8 grid of a frame: boxes are exploded to cells, so the join is an equi-join."""
    boxes = t.spark.createDataFrame([("a", 0, 0, 4, 4), ("b", 2, 2, 3, 5), ("c", 5, 1, 9, 2)], "box string, x int, y int, w int, h int")
    cells = J.box_cells(boxes, "x", "y", "w", "h", 8, 8).select("box", (F.col("cell_y") * 8 + F.col("cell_x")).cast("long").alias("vertex"))
    return t.activation().join(F.broadcast(cells), "vertex").groupBy("session_id", "t_idx", "box").agg(r6(F.avg("value"), "density"))


@query("""WITH e AS (SELECT p_partkey, p_name, lower(p_type) AS pt FROM part), c AS (SELECT s_suppkey AS row_no, 'part#' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') AS selector, lower(p_type) AS txt, s_suppkey AS clicks FROM supplier JOIN part ON p_partkey = s_suppkey),
m AS (SELECT p_partkey, row_no, CASE WHEN lower(p_name) = selector THEN 1 WHEN contains(selector, lower(p_name)) OR contains(lower(p_name), selector) THEN 2 WHEN pt = txt THEN 3 END AS tier FROM e, c), k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, row_no) AS k FROM m WHERE tier IS NOT NULL) SELECT e.p_partkey, k.row_no, k.tier FROM e LEFT JOIN (SELECT * FROM k WHERE k = 1) k USING (p_partkey)""")
def fuzzy_match_priority(t: Tables) -> DataFrame:
    """Elements against a small click table: the same selector, a selector within the other, the same text; first wins."""
    e = t.part.select("p_partkey", F.lower("p_name").alias("name"), F.lower("p_type").alias("pt"))
    c = t.supplier.join(t.part, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("row_no"), F.concat(F.lit("part#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0")).alias("selector"), F.lower("p_type").alias("txt"))
    rules = [("same", "name", "selector"), ("within", "name", "selector"), ("same", "pt", "txt")]
    return J.first_match(e, c, "p_partkey", rules, "row_no").select("p_partkey", "row_no", "tier")


@query("SELECT coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') AS section, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY ALL")
def group_by_url_path(t: Tables) -> DataFrame:
    path = F.coalesce(F.nullif(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/"))
    return t.pages.groupBy(path.alias("section")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query("WITH s AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL) SELECT c_custkey, CAST(round_even(greatest(0, least(100, 0.8 * (c_acctbal / 100) + 0.2 * coalesce(s.n, 50))), 0) AS INT) AS score FROM customer LEFT JOIN s ON k = c_custkey")
def left_join_blend(t: Tables) -> DataFrame:
    s = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    x = t.customer.join(s, F.col("c_custkey") == F.col("o_custkey"), "left")
    return x.select("c_custkey", S.clip_score(0.8 * (F.col("c_acctbal") / 100) + F.coalesce("n", F.lit(50)) / F.lit(5.0)).alias("score"))  # a fifth, exact before it is rounded once: 0.2 * n would miss halves


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_defaults(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query(f"WITH {ACT}, p AS (SELECT session_id, t_idx, parcel, avg(value) AS v FROM act GROUP BY ALL), z AS (SELECT *, CASE WHEN stddev_pop(v) OVER w < 1e-6 THEN v - avg(v) OVER w ELSE (v - avg(v) OVER w) / stddev_pop(v) OVER w END AS z FROM p WINDOW w AS (PARTITION BY session_id, parcel)), c AS (SELECT session_id % 3 AS cluster, t_idx, parcel, avg(z) AS z, count(DISTINCT session_id) AS members FROM z GROUP BY ALL) SELECT cluster, t_idx, parcel, round(avg(z) OVER (PARTITION BY cluster, parcel ORDER BY t_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS centroid, members FROM c")
def centroids(t: Tables) -> DataFrame:
    p = t.activation().groupBy("session_id", "t_idx", "parcel").agg(F.avg("value").alias("v"))
    w = W.partitionBy("session_id", "parcel")
    std = F.stddev_pop("v").over(w)
    z = p.withColumn("z", (F.col("v") - F.avg("v").over(w)) / F.when(std < 1e-6, F.lit(1.0)).otherwise(std))
    c = z.groupBy((F.col("session_id") % 3).alias("cluster"), "t_idx", "parcel").agg(F.avg("z").alias("z"), F.countDistinct("session_id").alias("members"))
    smooth = F.avg("z").over(W.partitionBy("cluster", "parcel").orderBy("t_idx").rowsBetween(-1, 1))
    return c.select("cluster", "t_idx", "parcel", r6(smooth, "centroid"), "members")


@query(f"WITH {EV}, s AS (SELECT session_id, count(*) AS n, round(avg(value), 3) AS m FROM ev GROUP BY session_id), top AS (SELECT session_id, channel, event_id, row_number() OVER (PARTITION BY session_id ORDER BY value DESC, event_id) AS k FROM ev) SELECT s.session_id, s.n, string_agg(channel || ':' || event_id, ';' ORDER BY k) AS payload FROM s JOIN top USING (session_id) WHERE k <= 10 GROUP BY ALL")
def narrative_payload(t: Tables) -> DataFrame:
    e = t.traces()
    top = R.top_k(e, ["session_id"], [F.desc("value"), F.asc("event_id")], 10, "k")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "channel", "event_id"))), lambda x: F.concat(x["channel"], F.lit(":"), x["event_id"].cast("string"))), ";")
    s = e.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return top.groupBy("session_id").agg(text.alias("payload")).join(s, "session_id").select("session_id", "n", "payload")


@query(f"WITH {ACT}, k AS (SELECT session_id, t_idx, vertex, value, row_number() OVER (PARTITION BY session_id, t_idx ORDER BY value DESC, vertex) - 1 AS rank FROM act) SELECT session_id, t_idx, rank, vertex, round(value, 6) AS value FROM k WHERE rank < 5")
def topk_per_group(t: Tables) -> DataFrame:
    """Within a frame the array is sorted and sliced: no shuffle beyond the one that numbers frames."""
    pairs = F.transform("vec", lambda x, i: F.struct((-x).alias("s"), i.cast("long").alias("vertex"), x.alias("value")))
    rows = t.frames().select("session_id", "t_idx", F.posexplode(F.slice(F.array_sort(pairs), 1, 5)).alias("rank", "x"))
    return rows.select("session_id", "t_idx", F.col("rank").cast("long").alias("rank"), "x.vertex", r6("x.value", "value"))


@query(f"WITH {ACT}, k AS (SELECT session_id, t_idx, vertex, value, row_number() OVER (PARTITION BY session_id, t_idx ORDER BY abs(value) DESC, vertex) AS k FROM act) SELECT session_id, t_idx, vertex, round(value, 6) AS value FROM k WHERE k <= 3")
def topk_abs(t: Tables) -> DataFrame:
    return R.top_k(t.activation(), ["session_id", "t_idx"], [F.desc(F.abs("value")), F.asc("vertex")], 3, "k").select("session_id", "t_idx", "vertex", r6("value", "value"))


@query(f"WITH {EV} SELECT session_id, arg_max(channel, s) AS channel, round(max(s), 6) AS score FROM (SELECT session_id, channel, round(sum(value), 6) AS s FROM ev GROUP BY ALL) GROUP BY session_id")
def argmax_channel(t: Tables) -> DataFrame:
    s = t.traces().groupBy("session_id", "channel").agg(F.round(F.sum("value"), 6).alias("s"))
    return s.groupBy("session_id").agg(F.max_by("channel", "s").alias("channel"), r6(F.max("s"), "score"))


SECTION = SIG + ", sc AS (SELECT *, least(t_idx * 3 // count(*) OVER (PARTITION BY session_id), 2) AS section FROM sig)"


def sections(t: Tables) -> DataFrame:
    """The display curve cut into temporal thirds."""
    n = F.count(F.lit(1)).over(W.partitionBy("session_id"))
    return signal(t).withColumn("section", F.least(F.floor(F.col("t_idx") * 3 / n), F.lit(2)))


@query(f"WITH {SECTION}, m AS (SELECT session_id, section, avg(display) AS m FROM sc GROUP BY ALL), k AS (SELECT *, min(m) OVER w AS lo, max(m) OVER w AS hi, row_number() OVER (PARTITION BY session_id ORDER BY round(m, 9) DESC, section) AS rank, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY session_id)) SELECT session_id, section, rank, CAST(round_even(CASE WHEN hi - lo < 1e-6 THEN 50 ELSE (m - lo) / (hi - lo) * 100 END, 0) AS INT) AS score, CASE WHEN n > 1 AND rank = 1 THEN 'strongest' WHEN n > 1 AND rank = n THEN 'weakest' END AS label FROM k")
def section_rank(t: Tables) -> DataFrame:
    m = sections(t).groupBy("session_id", "section").agg(F.avg("display").alias("m"))
    return R.rank_sections(m, ["session_id"], "section", "m").select("session_id", "section", "rank", "score", "label")


@query(f"WITH {EV}, s AS (SELECT session_id, round(avg(value) FILTER (channel = 'purchase' AND value > 40), 6) AS m FROM ev GROUP BY session_id) SELECT session_id, coalesce(m, 0) AS score, row_number() OVER (ORDER BY coalesce(m, 0) DESC, session_id) AS rank FROM s")
def session_rank(t: Tables) -> DataFrame:
    s = t.traces().groupBy("session_id").agg(F.coalesce(F.round(F.avg(F.when((F.col("channel") == "purchase") & (F.col("value") > 40), F.col("value"))), 6), F.lit(0.0)).alias("score"))
    return R.global_rank(s, [("score", True), "session_id"], "rank")


@query(f"WITH {SECTION}, p AS (SELECT session_id, section, min(t_idx) AS f, max(t_idx) AS l, min(t_idx) FILTER (m) AS p FROM (SELECT *, display = max(display) OVER (PARTITION BY session_id, section) AS m FROM sc) GROUP BY ALL), u AS (SELECT DISTINCT session_id, section, unnest([f, p, l]) AS t_idx FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY section, t_idx) AS k FROM u) SELECT session_id, section, t_idx FROM k WHERE k <= 7")
def sample_first_peak_last(t: Tables) -> DataFrame:
    return R.sample_sections(sections(t), ["session_id"], "section", "t_idx", "display", 3, 7)


@query(f"WITH {CLICK}, d AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY clickability DESC, p_partkey) AS k FROM ck WHERE NOT contains(dom_id, 'form') AND w * h >= 200) SELECT tag, k AS rank, dom_id, clickability FROM d WHERE k <= 5")
def candidate_rank(t: Tables) -> DataFrame:
    ok = clicked(t).where(~F.col("dom_id").contains("form") & (F.col("w") * F.col("h") >= 200))
    return R.top_k(ok, ["tag"], [F.desc("clickability"), F.asc("p_partkey")], 5, "k").select("tag", F.col("k").alias("rank"), "dom_id", "clickability")


@query("WITH c AS (SELECT event_id, event_type AS stratum, value, value < 15 AS neutral FROM events), a AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY stratum ORDER BY value DESC, event_id) AS k FROM c WHERE NOT neutral) WHERE k <= 12), b AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS k FROM c WHERE neutral) WHERE k <= 15) SELECT event_id FROM a UNION SELECT event_id FROM b")
def stratified_sample(t: Tables) -> DataFrame:
    c = t.events.select("event_id", "event_type", "value")
    a = R.top_k(c.where("value >= 15"), ["event_type"], [F.desc("value"), F.asc("event_id")], 12, "k")
    b = c.where("value < 15").orderBy("value", "event_id").limit(15)
    return a.select("event_id").union(b.select("event_id")).distinct()


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders), x AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice <= b THEN 1 WHEN o_totalprice <= c THEN 2 ELSE 3 END AS bin FROM orders, q), k AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY o_orderkey) AS k FROM x) SELECT bin, k AS pick, o_orderkey FROM k WHERE k <= 10")
def quartile_bins(t: Tables) -> DataFrame:
    return R.quartile_heads(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 10).select("bin", "pick", "o_orderkey")


@query(f"WITH {EV}, m AS (SELECT session_id, channel, count(*) AS n, sum(value) AS s FROM ev GROUP BY ALL), p AS (SELECT session_id, arg_max(channel, n * 1000 + ascii(channel)) AS a, arg_max(channel, round(s, 6)) AS b FROM m GROUP BY session_id) SELECT count(*) AS sessions, round(avg(CAST(a = b AS DOUBLE)), 6) AS top1 FROM p")
def top1_hit(t: Tables) -> DataFrame:
    m = t.traces().groupBy("session_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("s"))
    p = m.groupBy("session_id").agg((F.max_by("channel", F.col("n") * 1000 + F.ascii("channel")) == F.max_by("channel", "s")).alias("hit"))
    return p.agg(F.count(F.lit(1)).alias("sessions"), r6(F.avg(F.col("hit").cast("double")), "top1"))


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def paginate(t: Tables) -> DataFrame:
    return R.page(t.orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 25)


@query(f"WITH {EV} SELECT channel || '-' || CAST(floor(value / 10) AS BIGINT) AS dom_id, count(*) AS n, string_agg(session_id || ':' || t_idx, ',' ORDER BY session_id, t_idx) AS postings FROM ev GROUP BY ALL")
def inverted_index(t: Tables) -> DataFrame:
    e = t.traces().withColumn("dom_id", F.concat("channel", F.lit("-"), F.floor(F.col("value") / 10).cast("string")))
    posts = F.transform(F.sort_array(F.collect_list(F.struct("session_id", "t_idx"))), lambda p: F.concat_ws(":", p["session_id"].cast("string"), p["t_idx"].cast("string")))
    return e.groupBy("dom_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(posts, ",").alias("postings"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS label FROM events WHERE event_type NOT IN ('error', 'view')")
def anti_filter_remap(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "event_type").where(~F.col("event_type").isin("error", "view"))
    return J.dense_ids(e, "event_type", "label").select("event_id", "label")


@query("SELECT 'c' || c_custkey AS subject_id, c_nationkey AS site, c_acctbal AS age, c_mktsegment AS segment, 'customer' AS dataset FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier")
def union_all_sources(t: Tables) -> DataFrame:
    c = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("subject_id"), F.col("c_nationkey").alias("site"), F.col("c_acctbal").alias("age"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("dataset"))
    s = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("subject_id"), F.col("s_nationkey").alias("site"), F.col("s_acctbal").alias("age"), F.lit("supplier").alias("dataset"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def semi_intersect(t: Tables) -> DataFrame:
    c = t.customer.join(t.supplier, F.col("c_nationkey") == F.col("s_nationkey"), "left_semi")
    return c.join(t.orders.where("o_orderpriority LIKE '1%'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("WITH f AS (SELECT l_orderkey AS k, count(*) AS n, max(l_tax) AS tax FROM lineitem GROUP BY ALL) SELECT o_orderkey, CASE WHEN f.k IS NULL THEN 'missing' WHEN n < 2 THEN 'stale' WHEN tax > 0.07 THEN 'invalid' ELSE 'ok' END AS status FROM orders LEFT JOIN f ON k = o_orderkey")
def artifact_status(t: Tables) -> DataFrame:
    f = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_tax").alias("tax"))
    j = t.orders.select("o_orderkey").join(f, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.when(F.col("l_orderkey").isNull(), "missing").when(F.col("n") < 2, "stale").when(F.col("tax") > 0.07, "invalid").otherwise("ok").alias("status"))


@query("SELECT c_nationkey, count(*) AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY c_nationkey")
def anti_missing(t: Tables) -> DataFrame:
    done = t.orders.where("o_totalprice > 300000")
    return t.customer.join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("missing"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'act' WHEN 'signup' THEN 'act' WHEN 'view' THEN 'look' WHEN 'error' THEN 'fail' END AS merged FROM events")
def relabel_map(t: Tables) -> DataFrame:
    merge = {"act": ["click", "purchase", "signup"], "look": ["view"], "fail": ["error"]}
    return J.relabel(t.events.select("event_id", "event_type"), "event_type", merge, "merged").select("event_id", "merged")


@query(f"WITH {EV} SELECT session_id, channel, event_id, coalesce(nullif(floor(value / 50), 0), value) AS score FROM ev QUALIFY row_number() OVER (PARTITION BY session_id, channel ORDER BY t_idx) = 1")
def distinct_on_first(t: Tables) -> DataFrame:
    return J.distinct_on(t.traces(), ["session_id", "channel"], ["t_idx"]).select("session_id", "channel", "event_id", F.coalesce(F.nullif(F.floor(F.col("value") / 50).cast("double"), F.lit(0.0)), F.col("value")).alias("score"))


@query("WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT min(n) AS m FROM n), k AS (SELECT event_id, e.event_type, row_number() OVER (PARTITION BY e.event_type ORDER BY event_id) - 1 AS i, n.n, m.m FROM events e JOIN n ON n.event_type = e.event_type, m) SELECT event_id, event_type FROM k WHERE event_type <> 'view' OR n <= m OR floor((i + 1) * m / n) > floor(i * m / n)")
def balanced_downsample(t: Tables) -> DataFrame:
    return J.balance(t.events.select("event_id", "event_type"), "event_type", "view", "event_id").select("event_id", "event_type")


@query("WITH u AS (SELECT o_orderkey AS k, o_totalprice AS v, 0 AS gen FROM orders UNION ALL SELECT o_orderkey, o_totalprice + 1, 1 FROM orders WHERE o_orderkey % 4 = 0) SELECT k, v FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY gen DESC) = 1")
def merge_upsert_latest(t: Tables) -> DataFrame:
    old = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return J.upsert(old, old.where("k % 4 = 0").withColumn("v", F.col("v") + 1), ["k"])


@query(f"WITH {FR}, b AS (SELECT session_id, t_idx, row_number() OVER (ORDER BY session_id, t_idx) AS k FROM fr) SELECT session_id, t_idx FROM b WHERE k <= 100")
def baseline_union_limit(t: Tables) -> DataFrame:
    f = t.frames().select("session_id", "t_idx")
    parts = [f.where("session_id < 5"), f.where("session_id >= 5")]
    return J.stack_limit(parts, ["session_id", "t_idx"], 100)


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY split_part(p_type, ' ', 1), p_type) AS parcel_id FROM part")
def dense_id_assign(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.struct(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("a"), F.col("p_type").alias("b")).alias("key"))
    return J.dense_ids(p, "key", "parcel_id", start=1).select("p_partkey", "parcel_id")


@query("SELECT n.n_name, CASE WHEN starts_with(n_name, 'NATION') THEN r_name ELSE 'other' END AS coarse FROM nation n LEFT JOIN region ON r_regionkey = n_regionkey")
def prefix_map(t: Tables) -> DataFrame:
    j = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return j.select("n_name", F.when(F.startswith("n_name", F.lit("NATION")), F.col("r_name")).otherwise("other").alias("coarse"))


@query(f"WITH {BOXES}, a AS (SELECT p_partkey, x, y FROM inn WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS near, x AS bx, y AS by_ FROM inn WHERE p_partkey % 5 = 0), k AS (SELECT a.p_partkey, near, (x - bx) ** 2 + (y - by_) ** 2 AS d2 FROM a JOIN b ON abs(x - bx) <= 40 AND abs(y - by_) <= 40), f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d2, near) AS k FROM k WHERE d2 <= 1600) SELECT p_partkey, near, CAST(d2 AS BIGINT) AS d2 FROM f WHERE k = 1")
def nearest_neighbor_join(t: Tables) -> DataFrame:
    e = elements(t)
    a = e.where("p_partkey % 5 <> 0").select("p_partkey", "x", "y")
    b = e.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("near"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return J.nearest_point(a, b, "p_partkey", "near", ("x", "y"), ("bx", "by"), 40).select("p_partkey", "near", F.col("d2").cast("long").alias("d2"))


@query("SELECT lag, trim, stride FROM (VALUES (0), (2), (4), (6)) a(lag), (VALUES (0), (1), (2)) b(trim), (VALUES (1), (2), (3), (4)) c(stride)")
def cross_grid(t: Tables) -> DataFrame:
    return J.grid(t.spark, {"lag": [0, 2, 4, 6], "trim": [0, 1, 2], "stride": [1, 2, 3, 4]})


@query("WITH s AS (SELECT p_brand, avg(p_retailprice) FILTER (p_size > 40) AS m FROM part GROUP BY p_brand) SELECT p_brand, round(m, 6) AS m FROM s WHERE m IS NOT NULL ORDER BY round(m, 6) DESC, p_brand LIMIT 3")
def topk_nonnull(t: Tables) -> DataFrame:
    s = t.part.groupBy("p_brand").agg(r6(F.avg(F.when(F.col("p_size") > 40, F.col("p_retailprice"))), "m"))
    return s.where("m IS NOT NULL").orderBy(F.desc("m"), "p_brand").limit(3)


@query("SELECT round(avg(CAST((p_partkey % 7) = (p_size % 7) AS DOUBLE)), 6) AS agreement, count(*) AS n FROM part WHERE p_partkey % 7 > 0 AND p_size % 7 > 0")
def agreement_rate(t: Tables) -> DataFrame:
    both = t.part.where("p_partkey % 7 > 0 AND p_size % 7 > 0")
    return both.agg(r6(F.coalesce(F.avg((F.col("p_partkey") % 7 == F.col("p_size") % 7).cast("double")), F.lit(0.0)), "agreement"), F.count(F.lit(1)).alias("n"))
