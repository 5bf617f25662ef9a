"""Cohorts, calibration, models and event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as S
from ..operators import cohorts as C
from ..operators import stats
from ..operators.moments import POISSON
from ..operators.ranges import with_average_rank, with_position
from .base import EV, Tables, query
from .kernel import NOV, r6
from .series import pair

RULES = {"auto_5": {"c_mktsegment": "AUTOMOBILE"}, "build_low": {"c_mktsegment": "BUILDING", "c_nationkey": "3"}, "nation_7": {"c_nationkey": "7"}}


@query("WITH m AS (SELECT c_custkey, unnest(list_filter([CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'auto_5' END, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 3 THEN 'build_low' END, CASE WHEN c_nationkey = 7 THEN 'nation_7' END], lambda x: x IS NOT NULL)) AS cluster FROM customer) SELECT c_custkey, cluster, count(*) OVER (PARTITION BY cluster) AS n, count(*) OVER (PARTITION BY cluster) < 20 AS suppressed FROM m")
def cluster_assign(t: Tables) -> DataFrame:
    return C.assign_clusters(t.customer, RULES, "c_custkey", 20).select("c_custkey", "cluster", "n", "suppressed")


@query("WITH r AS (SELECT c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 50) + (count(*) OVER (PARTITION BY c_nationkey, c_custkey % 50) - 1) / 2.0 AS b FROM customer) SELECT c_nationkey, round(corr(a, b), 6) AS rho FROM r GROUP BY c_nationkey")
def spearman_avg(t: Tables) -> DataFrame:
    c = t.customer.select("c_nationkey", "c_acctbal", (F.col("c_custkey") % 50).alias("k"))
    c = with_average_rank(with_average_rank(c, ["c_nationkey"], "c_acctbal", "a"), ["c_nationkey"], "k", "b")
    return c.groupBy("c_nationkey").agg(r6(F.corr("a", "b"), "rho"))


@query("WITH r AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 50, c_custkey) AS b FROM customer) SELECT c_nationkey, round(corr(a, b), 6) AS rho FROM r GROUP BY c_nationkey")
def spearman_ordinal(t: Tables) -> DataFrame:
    rank = lambda *c: F.row_number().over(W.partitionBy("c_nationkey").orderBy(*c))
    c = t.customer.withColumns({"a": rank("c_acctbal", "c_custkey"), "b": rank(F.col("c_custkey") % 50, "c_custkey")})
    return c.groupBy("c_nationkey").agg(r6(F.corr("a", "b"), "rho"))


@query(f"WITH {NOV} SELECT session_id, round(corr(van, dmn), 5) AS r, count(*) AS n FROM nov GROUP BY session_id")
def pearson_targets(t: Tables) -> DataFrame:
    return pair(t).groupBy("session_id").agg(F.round(stats.guarded_corr("a", "b", 3), 5).alias("r"), F.count(F.lit(1)).alias("n"))


_POISSON = "[" + ", ".join(map(str, POISSON)) + "]"


@query(f"""
WITH w AS (SELECT c_nationkey, c_acctbal, r, len(list_filter({_POISSON}, lambda p: CAST('0x' || substr(md5(c_custkey || ':' || r), 1, 12) AS BIGINT) / 281474976710656.0 >= p)) AS w FROM customer, range(2000) x(r)),
m AS (SELECT c_nationkey, r, sum(c_acctbal * w) / sum(w) AS m FROM w WHERE w > 0 GROUP BY ALL),
b AS (SELECT c_nationkey, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, count(*) AS replicates FROM m GROUP BY ALL)
SELECT c_nationkey, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, replicates FROM b JOIN (SELECT c_nationkey, avg(c_acctbal) AS mean, count(*) AS n FROM customer GROUP BY ALL) USING (c_nationkey)
""")
def bootstrap_ci(t: Tables) -> DataFrame:
    return C.bootstrap_mean(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], "c_custkey", "c_acctbal", 2000).select("c_nationkey", "n", r6("mean", "mean"), r6("low", "low"), r6("high", "high"), "replicates")


def _permuted(site: str) -> str:
    """SQL of r and p by the order of md5 hashes, within a site."""
    return f"""
WITH rows AS (SELECT s_suppkey AS k, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y, {site} AS site FROM supplier),
     p AS (SELECT i, rows.* FROM rows, range(200) t(i)),
     a AS (SELECT i, site, x, row_number() OVER (PARTITION BY i, site ORDER BY k) AS n FROM p),
     b AS (SELECT i, site, y, row_number() OVER (PARTITION BY i, site ORDER BY CASE WHEN i > 0 THEN md5(i || ':' || k) END, k) AS n FROM p),
     r AS (SELECT i, corr(x, y) AS r FROM a JOIN b USING (i, site, n) GROUP BY i)
SELECT round((SELECT r FROM r WHERE i = 0), 6) AS r,
       round((count(*) FILTER (i > 0 AND r >= (SELECT r FROM r WHERE i = 0) - 1e-9) + 1) / 200.0, 6) AS p
FROM r
"""


@query(_permuted("0"))
def permutation_p(t: Tables) -> DataFrame:
    return C.permutation_p(t.supplier, "s_suppkey", "s_acctbal", "s_nationkey", 199).select(r6("r", "r"), r6("p", "p"))


@query(_permuted("s_suppkey % 4"))
def permutation_within_sites(t: Tables) -> DataFrame:
    rows = t.supplier.withColumn("site", F.col("s_suppkey") % 4)
    return C.permutation_p(rows, "s_suppkey", "s_acctbal", "s_nationkey", 199, "site").select(r6("r", "r"), r6("p", "p"))


@query("WITH l AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, sum(c_acctbal) AS s, sum(c_acctbal * c_acctbal) AS q FROM customer GROUP BY ALL) SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS n, round((sum(s * s / n) - sum(s) ** 2 / sum(n)) / nullif(sum(q) - sum(s) ** 2 / sum(n), 0), 6) AS r2 FROM l GROUP BY c_nationkey")
def r2_one_factor(t: Tables) -> DataFrame:
    return C.one_factor_r2(t.customer, "c_mktsegment", "c_acctbal", ["c_nationkey"]).select("c_nationkey", "n", r6("r2", "r2"))


@query("WITH g AS (SELECT i / 20.0 AS w FROM range(21) r(i)), s AS (SELECT w, round(corr(w * s_acctbal / 10000 + (1 - w) * s_nationkey / 25.0, s_suppkey), 9) AS r FROM supplier, g GROUP BY w) SELECT round(w, 6) AS w, round(r, 6) AS r FROM s ORDER BY r DESC, w LIMIT 1")
def grid_argmax(t: Tables) -> DataFrame:
    """All weights of the grid in one pass: a correlation is an aggregate for each."""
    grid = [i / 20.0 for i in range(21)]
    mix = lambda w: w * F.col("s_acctbal") / 10000 + (1 - w) * F.col("s_nationkey") / 25.0
    r = t.supplier.agg(F.array(*[F.struct(F.round(F.corr(mix(w), "s_suppkey"), 9).alias("r"), F.lit(-w).alias("n")) for w in grid]).alias("all"))
    return r.select(F.array_max("all").alias("m")).select(r6(-F.col("m.n"), "w"), r6("m.r", "r"))


CONF = "p AS (SELECT doc_id, quality AS y, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS yhat FROM labels)"


@query(f"WITH {CONF}, c AS (SELECT y AS label, count(*) AS support, count(*) FILTER (y = yhat) AS hit FROM p GROUP BY y), s AS (SELECT yhat AS label, count(*) AS said FROM p GROUP BY yhat), m AS (SELECT label, support, coalesce(hit / nullif(said, 0), 0) AS pr, hit / support AS re FROM c LEFT JOIN s USING (label)) SELECT label, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM m")
def confusion_f1(t: Tables) -> DataFrame:
    p = t.labels.select(F.col("quality").alias("y"), F.when(F.col("toxic") == 1, 0).otherwise(1).alias("yhat"))
    return C.class_metrics(p, "y", "yhat").select("label", "support", *[r6(c, c) for c in ("precision", "recall", "f1")])


@query(f"WITH {EV}, f AS (SELECT session_id, avg(value) AS m, count(*) FILTER (channel = 'error') AS e FROM ev GROUP BY session_id) SELECT session_id, round(1 / (1 + exp(-(-1.2 + 0.05 * m - 0.03 * e))), 4) AS p FROM f")
def logistic_score(t: Tables) -> DataFrame:
    f = t.traces().groupBy("session_id").agg(F.avg("value").alias("m"), F.count(F.when(F.col("channel") == "error", 1)).alias("e"))
    return f.select("session_id", F.round(S.sigmoid(-1.2 + 0.05 * F.col("m") - 0.03 * F.col("e")), 4).alias("p"))


@query("SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INT) AS is_building, CAST(c_mktsegment = 'FURNITURE' AS INT) AS is_furniture, CAST(c_mktsegment = 'HOUSEHOLD' AS INT) AS is_household, CAST(c_mktsegment = 'MACHINERY' AS INT) AS is_machinery FROM customer")
def one_hot(t: Tables) -> DataFrame:
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return C.one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", levels).drop("c_mktsegment")


@query("WITH d AS (SELECT lang, n_chars, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r FROM d), s AS (SELECT lang, sum(y) AS p, sum(1 - y) AS n, sum(r) FILTER (y = 1) AS rs FROM r GROUP BY lang) SELECT lang, CAST(p AS DOUBLE) AS n_pos, CAST(n AS DOUBLE) AS n_neg, round((rs - p * (p + 1) / 2) / (nullif(p, 0) * nullif(n, 0)), 6) AS auc FROM s")
def auc_ranksum(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", F.col("quality").alias("y")), "doc_id")
    return stats.auc(d, ["lang"], "n_chars", "y").select("lang", "n_pos", "n_neg", r6("auc", "auc"))


@query("WITH p AS (SELECT o_orderpriority AS g, o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS f FROM orders) SELECT g, round(1 - sum((y - f) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM p GROUP BY g")
def r2_metric(t: Tables) -> DataFrame:
    fit = F.avg("o_totalprice").over(W.partitionBy("o_orderpriority", "o_orderstatus"))
    p = t.orders.select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("y"), fit.alias("f"))
    return p.groupBy("g").agg(r6(1 - F.sum((F.col("y") - F.col("f")) ** 2) / (F.var_pop("y") * F.count(F.lit(1))), "r2"))


@query(None)
def ridge_oof(t: Tables) -> DataFrame:
    x = t.lineitem.select("l_suppkey", "l_quantity", "l_discount", "l_extendedprice")
    out = C.ridge_group_folds(x, "l_suppkey", ["l_quantity", "l_discount"], "l_extendedprice", 1.0, 5)
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("target", "predicted"), "r"))


@query(f"WITH {EV}, n AS (SELECT session_id, channel, value, coalesce(epoch_us(lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id)) - epoch_us(ts), 0) / 1000.0 AS ms FROM ev) SELECT session_id, channel, round(sum(ms * least(1, value / 100)), 3) AS visible_ms FROM n GROUP BY ALL")
def visible_duration(t: Tables) -> DataFrame:
    from ..streaming.visibility import visible_ms

    return visible_ms(t.traces(), ["session_id"], "channel", "ts", F.col("value") / 100, ["event_id"]).select("session_id", "channel", F.round("visible_ms", 3).alias("visible_ms"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(t: Tables) -> DataFrame:
    from ..streaming.windows import tumbling

    return tumbling(t.events, "ts", "1 day", ["event_type"], "value").select(F.col("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {EV}, s AS (SELECT DISTINCT session_id FROM ev), k AS (SELECT session_id, (row_number() OVER (ORDER BY session_id) - 1) // 8 AS chunk FROM s) SELECT chunk, min(session_id) AS first_id, max(session_id) AS last_id, count(*) AS n FROM k GROUP BY chunk")
def chunk_ranges(t: Tables) -> DataFrame:
    s = t.events.select(F.col("user_id").alias("session_id")).distinct()
    k = with_position(s, [], ["session_id"], "place").withColumn("chunk", F.floor(F.col("place") / 8))
    return k.groupBy("chunk").agg(F.min("session_id").alias("first_id"), F.max("session_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT session_id, channel, min(ts) AS first_ts, count(*) AS repeats FROM ev GROUP BY ALL")
def dedupe_key(t: Tables) -> DataFrame:
    return t.traces().groupBy("session_id", "channel").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("repeats"))


@query(f"WITH RECURSIVE {EV}, s AS (SELECT * FROM ev), r AS (SELECT session_id, t_idx, 5 AS budget, CAST('' AS VARCHAR) AS visited, CAST('start' AS VARCHAR) AS action FROM s WHERE t_idx = 0 UNION ALL SELECT s.session_id, s.t_idx, CASE WHEN r.budget > 0 AND NOT contains(r.visited, s.channel) THEN r.budget - 1 ELSE r.budget END, CASE WHEN r.budget > 0 AND NOT contains(r.visited, s.channel) THEN r.visited || s.channel || ';' ELSE r.visited END, CASE WHEN r.budget = 0 THEN 'stop' WHEN contains(r.visited, s.channel) THEN 'scroll' ELSE 'click' END FROM s JOIN r ON s.session_id = r.session_id AND s.t_idx = r.t_idx + 1) SELECT session_id, t_idx, budget, action FROM r")
def stream_state_policy(t: Tables) -> DataFrame:
    from ..streaming.policy import replay_policy

    return replay_policy(t.traces().select("session_id", "t_idx", "channel"), 5).select("session_id", "t_idx", F.col("budget").cast("int").alias("budget"), "action")
