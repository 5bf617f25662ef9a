"""Time series, windows and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as S
from ..operators import series as ts
from ..operators import stats
from .base import ACT, EV, Tables, query
from .kernel import NOV, PARCELS, SIG, parcels, r6, signal, track


def by_session(*order: str) -> object:
    w = W.partitionBy("session_id")
    return w.orderBy(*order) if order else w


@query(f"WITH {NOV} SELECT session_id, t_idx, round(novelty, 6) AS novelty FROM nov")
def novelty_l2(t: Tables) -> DataFrame:
    return ts.novelty(t.frames(), ["session_id"], "t_idx", "vec").select("session_id", "t_idx", r6("novelty", "novelty"))


@query(f"WITH {ACT}, x AS (SELECT session_id, t_idx, avg(abs(value)) AS raw FROM act GROUP BY ALL), b AS (SELECT count(*) AS n, avg(raw) AS m, stddev_pop(raw) AS s FROM x WHERE session_id = 0), z AS (SELECT x.*, CASE WHEN n >= 30 THEN (raw - b.m) / (b.s + 1e-8) ELSE (raw - avg(raw) OVER w) / (stddev_pop(raw) OVER w + 1e-8) END AS z, n >= 30 AS from_baseline FROM x, b WINDOW w AS (PARTITION BY session_id)) SELECT session_id, t_idx, round(raw, 6) AS raw, round(z, 6) AS z, CASE WHEN z > 1 THEN 'high_attention' WHEN z < -1 THEN 'low_attention' END AS label, from_baseline FROM z")
def activation_track(t: Tables) -> DataFrame:
    from ..operators.tracks import activation_track as op

    frames = t.frames()
    out = op(frames, frames.where("session_id = 0"), ["session_id"], "t_idx", "vec")
    return out.select("session_id", "t_idx", r6("raw", "raw"), r6("z", "z"), "label", "from_baseline")


@query(f"WITH {ACT}, b AS (SELECT vertex, median(value) AS m, greatest(1.4826 * mad(value), 1e-6) AS s FROM act WHERE session_id = 0 GROUP BY vertex), z AS (SELECT session_id, t_idx, network, (value - m) / s AS z FROM act JOIN b USING (vertex)), e AS (SELECT session_id, t_idx, avg(z) FILTER (network = 0) - avg(z) FILTER (network = 3) AS score FROM z GROUP BY ALL) SELECT session_id, t_idx, round(score, 6) AS score, CASE WHEN score > 1.5 THEN 'engaging' WHEN score < -1.5 THEN 'boring' END AS label FROM e")
def engagement_track(t: Tables) -> DataFrame:
    from ..operators.tracks import engagement_track as op

    a = t.activation()
    return op(a, a.where("session_id = 0"), ["session_id"], "t_idx", "vertex", "network", "value", 0, 3).select("session_id", "t_idx", r6("score", "score"), "label")


NORMZ = f"{ACT}, sub AS (SELECT session_id, t_idx, network, avg(v) AS value FROM (SELECT session_id, t_idx, network, parcel, avg(value) AS v FROM act GROUP BY ALL) GROUP BY ALL), nn AS (SELECT network, avg(value) AS m, greatest(stddev_pop(value), 1e-8) AS s FROM sub GROUP BY network), nz AS (SELECT session_id, t_idx, network, (value - m) / s AS z FROM sub JOIN nn USING (network)), eng AS (SELECT session_id, t_idx, max(z) FILTER (network = 0) - max(z) FILTER (network = 3) AS score FROM nz GROUP BY ALL)"


def norm_engagement(t: Tables) -> DataFrame:
    """z of the first network less that of the last, against the norms of all frames.

    Means go up the hierarchy within each frame's array; the norms, a row a network, become one row of arrays. So frames
    are shuffled once, to be numbered, and all that follows by session needs no further exchange.
    """
    frames = t.frames().select("session_id", "t_idx", S.block_means(S.block_means(F.col("vec"), 8), 2).alias("net"))
    norms = stats.norm_table(t.frames().select(F.posexplode(S.block_means(S.block_means(F.col("vec"), 8), 2)).alias("network", "value")), ["network"], "value", quantiles=False)
    table = norms.agg(F.map_from_entries(F.collect_list(F.struct("network", F.struct("mean", "std")))).alias("norm"))
    z = lambda i: (F.get("net", F.lit(i)) - F.col("norm")[i]["mean"]) / F.col("norm")[i]["std"]
    return frames.join(F.broadcast(table)).select("session_id", "t_idx", (z(0) - z(3)).alias("score"))  # a single row


@query(f"WITH {NORMZ} SELECT session_id, t_idx, round(score, 6) AS score, CASE WHEN score > 1.5 THEN 'engaging' WHEN score < -1.5 THEN 'boring' END AS label FROM eng")
def engagement_norm(t: Tables) -> DataFrame:
    return norm_engagement(t).select("session_id", "t_idx", r6("score", "score"), S.threshold_label(F.col("score"), 1.5, -1.5, "engaging", "boring").alias("label"))


MASK = "CASE WHEN n - 5 <= 1 THEN true ELSE t_idx >= 1 AND t_idx < n - CASE WHEN n * 1.0 > 8 THEN 5 ELSE 1 END END"


@query(f"WITH {EV}, x AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM ev) SELECT event_id, CASE WHEN n - CASE WHEN n > 8 THEN 5 ELSE 1 END <= 1 THEN true ELSE t_idx >= 1 AND t_idx < n - CASE WHEN n > 8 THEN 5 ELSE 1 END END AS valid FROM x")
def edge_mask(t: Tables) -> DataFrame:
    x = t.traces().withColumn("n", F.count(F.lit(1)).over(by_session()))
    return x.select("event_id", ts.edge_mask(F.col("t_idx"), F.col("n"), 1.0).alias("valid"))


MASKED = SIG + f", msk AS (SELECT *, {MASK} AS valid FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM sig)), mz AS (SELECT *, CASE WHEN es < 1e-8 THEN 0 ELSE (engagement - em) / es END AS ez, CASE WHEN ns < 1e-8 THEN 0 ELSE (novelty - nm) / ns END AS nz FROM (SELECT *, avg(engagement) FILTER (valid) OVER w AS em, stddev_pop(engagement) FILTER (valid) OVER w AS es, avg(novelty) FILTER (valid) OVER w AS nm, stddev_pop(novelty) FILTER (valid) OVER w AS ns FROM msk WINDOW w AS (PARTITION BY session_id)))"


def masked(t: Tables) -> DataFrame:
    """The display curve with the edge mask and the z of engagement (ez) and novelty (nz) by valid frames."""
    x = signal(t).withColumn("n", F.count(F.lit(1)).over(by_session()))
    x = x.withColumn("valid", ts.edge_mask(F.col("t_idx"), F.col("n"), 1.0))
    for c, name in (("engagement", "ez"), ("novelty", "nz")):
        x = stats.session_z(x, ["session_id"], c, least=1e-8, eps=0.0, valid=F.col("valid"), name=name)
    return x


@query(f"WITH {MASKED} SELECT session_id, t_idx, valid, round(ez, 6) AS ez, round(nz, 6) AS nz FROM mz")
def masked_z(t: Tables) -> DataFrame:
    return masked(t).select("session_id", "t_idx", "valid", r6("ez", "ez"), r6("nz", "nz"))


@query(f"WITH {MASKED}, d AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_idx) AS k FROM mz WHERE t_idx >= 1 AND valid AND ez < -0.65 AND nz < -0.20) SELECT session_id, t_idx, k AS drop_no, round(display, 6) AS display FROM d WHERE k <= 6")
def drop_moments(t: Tables) -> DataFrame:
    d = masked(t).where("t_idx >= 1 AND valid AND ez < -0.65 AND nz < -0.20").withColumn("k", F.row_number().over(by_session("t_idx")).cast("long"))
    return d.where("k <= 6").select("session_id", "t_idx", F.col("k").alias("drop_no"), r6("display", "display"))


@query(f"""WITH {MASKED}, v AS (SELECT *, avg(display) OVER (PARTITION BY session_id ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM mz WHERE valid),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(smooth, 9) DESC, t_idx) AS best, row_number() OVER (PARTITION BY session_id ORDER BY round(smooth, 9), t_idx) AS worst FROM v)
SELECT session_id, 'best' AS focus, t_idx AS center, round(smooth, 6) AS mean FROM k WHERE best = 1 UNION ALL SELECT session_id, 'worst', t_idx, round(smooth, 6) FROM k WHERE worst = 1""")
def focus_windows(t: Tables) -> DataFrame:
    from ..operators.tracks import focus_windows as op

    return op(masked(t).where("valid"), ["session_id"], "t_idx", "display", half=2).select("session_id", "focus", "center", r6("mean", "mean"))


@query(f"""WITH {MASKED}, v AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_idx) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS m FROM mz WHERE valid)
SELECT session_id, round((avg(display) FILTER (i < greatest(1, m // 4)) + 1e-6) / (avg(display) FILTER (i >= greatest(1, m // 4)) + 1e-6), 6) AS opening,
  round(CASE WHEN max(m) >= 3 THEN (avg(display) FILTER (i >= m - m // 3) + 1e-6) / (avg(display) FILTER (i < m // 3) + 1e-6) END, 6) AS sustain,
  round(CASE WHEN max(m) >= 3 THEN avg(CASE WHEN nz > 0.6 THEN 1.0 ELSE 0.0 END) END, 6) AS transition,
  round(CASE WHEN max(m) >= 2 AND avg(display) > 1e-8 THEN 1 / (1 + stddev_pop(display) / (avg(display) + 1e-8)) END, 6) AS stability,
  round(avg(display) / (quantile_cont(display, 0.9) + 1e-8), 6) AS density FROM v GROUP BY session_id""")
def session_metrics(t: Tables) -> DataFrame:
    from ..operators.tracks import session_metrics as op

    out = op(masked(t).where("valid"), ["session_id"], "t_idx", "display", "nz")
    return out.select("session_id", *[r6(c, c) for c in ("opening", "sustain", "transition", "stability", "density")])


@query(f"WITH {NORMZ}, m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_idx) AS p FROM eng), r AS (SELECT *, p - row_number() OVER (PARTITION BY session_id ORDER BY t_idx) AS g FROM m WHERE score > 0.5) SELECT session_id, min(t_idx) AS t_start, max(t_idx) AS t_end, count(*) AS n_frames, round(sum(score - 0.5), 6) AS excess FROM r GROUP BY session_id, g HAVING count(*) >= 2")
def threshold_hits(t: Tables) -> DataFrame:
    return ts.threshold_runs(norm_engagement(t), ["session_id"], "t_idx", "score", 0.5, 2).select("session_id", "t_start", "t_end", "n_frames", r6("excess", "excess"))


@query(f"""WITH {NORMZ}, m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_idx) AS p FROM eng), r AS (SELECT *, p - row_number() OVER (PARTITION BY session_id ORDER BY t_idx) AS g FROM m WHERE score > 0.5),
h AS (SELECT session_id, count(*) AS n_frames, sum(score - 0.5) * count(*) AS confidence FROM r GROUP BY session_id, g HAVING count(*) >= 2), s AS (SELECT session_id, count(*) AS hits, sum(n_frames) AS frames, sum(confidence) AS confidence FROM h GROUP BY session_id)
SELECT session_id, hits, CAST(frames AS BIGINT) AS frames, round(confidence, 6) AS confidence, row_number() OVER (ORDER BY round(confidence, 6) DESC, session_id) AS rank FROM s""")
def flagship(t: Tables) -> DataFrame:
    """Vectors to parcels to networks, z by norms, engagement, runs above a threshold, sessions ranked."""
    h = ts.threshold_runs(norm_engagement(t), ["session_id"], "t_idx", "score", 0.5, 2)
    s = h.groupBy("session_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("n_frames").alias("frames"), F.round(F.sum(F.col("excess") * F.col("n_frames")), 6).alias("confidence"))
    return s.withColumn("rank", F.row_number().over(W.orderBy(F.desc("confidence"), "session_id")).cast("long"))


PAIR = f"{NOV}, pr AS (SELECT session_id, t_idx, van AS a, dmn AS b FROM nov)"


def pair(t: Tables) -> DataFrame:
    mean = lambda a: F.aggregate(F.slice("vec", a, 16), F.lit(0.0), lambda s, x: s + x) / 16
    return t.frames().select("session_id", "t_idx", mean(1).alias("a"), mean(49).alias("b"))


@query(f"WITH {PAIR} SELECT session_id, t_idx, round(CASE WHEN count(*) OVER w < 3 THEN NULL WHEN stddev_pop(a) OVER w < 1e-8 OR stddev_pop(b) OVER w < 1e-8 THEN 0 ELSE corr(a, b) OVER w END, 5) AS r FROM pr WINDOW w AS (PARTITION BY session_id ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_corr(t: Tables) -> DataFrame:
    return pair(t).select("session_id", "t_idx", F.round(ts.rolling_corr("a", "b", ["session_id"], "t_idx", 3), 5).alias("r"))


@query(f"WITH {PAIR} SELECT session_id, t_idx, round(a, 6) AS amp, round(coalesce(a - lag(a) OVER w, 0), 6) AS delta, round(lag(a) OVER w, 6) AS lag1, round(b, 6) AS current FROM pr WINDOW w AS (PARTITION BY session_id ORDER BY t_idx)")
def lag_features(t: Tables) -> DataFrame:
    before = F.lag("a").over(by_session("t_idx"))
    return pair(t).select("session_id", "t_idx", r6("a", "amp"), r6(F.coalesce(F.col("a") - before, F.lit(0.0)), "delta"), r6(before, "lag1"), r6("b", "current"))


@query(f"WITH {PAIR} SELECT * FROM (SELECT session_id, t_idx, round(a, 6) AS x, round(lead(b, 2) OVER (PARTITION BY session_id ORDER BY t_idx), 6) AS y FROM pr) WHERE y IS NOT NULL")
def lead_align(t: Tables) -> DataFrame:
    return pair(t).select("session_id", "t_idx", r6("a", "x"), r6(F.lead("b", 2).over(by_session("t_idx")), "y")).where("y IS NOT NULL")


@query(f"WITH {PAIR}, g AS (SELECT lag, corr(a, y) AS r FROM (SELECT lag, a, CASE lag WHEN 0 THEN b WHEN 1 THEN lead(b, 1) OVER w WHEN 2 THEN lead(b, 2) OVER w WHEN 3 THEN lead(b, 3) OVER w END AS y FROM pr, range(4) AS l(lag) WINDOW w AS (PARTITION BY session_id, lag ORDER BY t_idx)) WHERE y IS NOT NULL GROUP BY lag) SELECT lag, round(r, 6) AS r, row_number() OVER (ORDER BY round(r, 9) DESC, lag) = 1 AS best FROM g")
def lag_search(t: Tables) -> DataFrame:
    """All lags from one pass: the leads are columns, not copies of the series."""
    w = by_session("t_idx")
    wide = pair(t).select("a", *[F.lead("b", k).over(w).alias(f"y{k}") for k in range(4)])
    r = wide.agg(*[F.corr(F.when(F.col(f"y{k}").isNotNull(), F.col("a")), f"y{k}").alias(f"r{k}") for k in range(4)])
    rows = r.select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"r{k}").alias("r")) for k in range(4)])).alias("x")).select("x.*")
    return rows.select("lag", r6("r", "r"), (F.row_number().over(W.orderBy(F.desc(F.round("r", 9)), "lag")) == 1).alias("best"))


@query("""WITH o AS (SELECT o_custkey AS k, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS d, avg(o_totalprice) AS v FROM orders GROUP BY ALL), g AS (SELECT k, unnest(range(0, 2400, 200)) AS d FROM (SELECT DISTINCT k FROM o)),
a AS (SELECT g.k, g.d, (SELECT max(o.d) FROM o WHERE o.k = g.k AND o.d <= g.d) AS p, (SELECT min(o.d) FROM o WHERE o.k = g.k AND o.d >= g.d) AS n FROM g)
SELECT a.k AS custkey, CAST(a.d AS DOUBLE) AS day, round(CASE WHEN p IS NULL THEN y.v WHEN n IS NULL THEN x.v WHEN p = n THEN x.v ELSE x.v + (a.d - p) * (y.v - x.v) / (n - p) END, 4) AS price FROM a LEFT JOIN o x ON x.k = a.k AND x.d = p LEFT JOIN o y ON y.k = a.k AND y.d = n""")
def interp_grid(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("custkey"), F.date_diff("o_orderdate", F.lit("1992-01-01")).alias("day")).agg(F.avg("o_totalprice").alias("price"))
    grid = o.select("custkey").distinct().select("custkey", F.explode(F.sequence(F.lit(0), F.lit(2399), F.lit(200))).alias("day"))
    return ts.interpolate(grid, o, ["custkey"], "day", "price").select("custkey", "day", F.round("price", 4).alias("price"))


@query(f"WITH {EV} SELECT event_id, coalesce(CAST(floor(value / 10) = lag(floor(value / 10)) OVER (PARTITION BY session_id ORDER BY t_idx) AS INT), 0) AS stopped FROM ev")
def lag_equal_flag(t: Tables) -> DataFrame:
    x = F.floor(F.col("value") / 10)
    return t.traces().select("event_id", F.coalesce((x == F.lag(x).over(by_session("t_idx"))).cast("int"), F.lit(0)).alias("stopped"))


@query(f"WITH {EV}, g AS (SELECT session_id, unnest(range(0, last + 3)) AS t_idx FROM (SELECT session_id, max(t_idx) AS last FROM ev GROUP BY session_id)), j AS (SELECT g.*, CASE WHEN ev.t_idx % 3 = 0 THEN ev.value END AS v FROM g LEFT JOIN ev USING (session_id, t_idx)) SELECT session_id, t_idx, last_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS value FROM j")
def forward_fill(t: Tables) -> DataFrame:
    e = t.traces()
    last = e.groupBy("session_id").agg(F.max("t_idx").cast("long").alias("last"))
    frames = last.select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") + 2)).alias("t_idx"))
    return ts.forward_fill(e.where("t_idx % 3 = 0"), ["session_id"], "t_idx", frames, ["value"])


@query(f"WITH {EV}, w AS (SELECT session_id, t_idx, t_idx - lag(t_idx, 3) OVER o AS d, avg(value) OVER f AS mean FROM (SELECT * FROM ev WHERE channel <> 'error') WINDOW o AS (PARTITION BY session_id ORDER BY t_idx), f AS (PARTITION BY session_id ORDER BY t_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_idx) - 1 AS i FROM w WHERE d = 3) SELECT session_id, t_idx - 3 AS t_start, t_idx AS t_end, round(mean, 6) AS mean FROM k WHERE i % 2 = 0")
def sliding_rows(t: Tables) -> DataFrame:
    w = ts.sliding(t.traces().where("channel <> 'error'"), ["session_id"], "t_idx", 4, 2, ["value"])
    return w.select("session_id", "t_start", F.col("t_idx").alias("t_end"), r6(F.aggregate("value_window", F.lit(0.0), lambda a, x: a + x) / 4, "mean"))


@query(f"WITH {EV} SELECT event_id, round(avg(value) OVER f, 6) AS mean, round(median(value) OVER f, 6) AS median, value - first_value(value) OVER f AS last_first, round(stddev_pop(value) OVER f, 6) AS std, round(CASE WHEN count(*) OVER f >= 2 THEN regr_slope(value, t_idx) OVER f END, 5) AS slope FROM ev WINDOW f AS (PARTITION BY session_id ORDER BY t_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def window_reducers(t: Tables) -> DataFrame:
    f = by_session("t_idx").rowsBetween(-4, 0)
    slope = F.when(F.count(F.lit(1)).over(f) >= 2, F.regr_slope("value", "t_idx").over(f))
    med = F.collect_list("value").over(f)
    n = F.size("xs")
    mid = (F.get(F.col("xs"), F.floor((n - 1) / 2).cast("int")) + F.get(F.col("xs"), F.floor(n / 2).cast("int"))) / 2
    return t.traces().select("event_id", "value", F.array_sort(med).alias("xs"), F.avg("value").over(f).alias("m"), F.first("value").over(f).alias("f"), F.stddev_pop("value").over(f).alias("s"), slope.alias("k")).select("event_id", r6("m", "mean"), r6(mid, "median"), (F.col("value") - F.col("f")).alias("last_first"), r6("s", "std"), F.round("k", 5).alias("slope"))


@query(f"WITH {EV} SELECT event_id, channel FROM (SELECT *, min(channel) OVER f = max(channel) OVER f AND count(*) OVER f = 2 AS same FROM ev WINDOW f AS (PARTITION BY session_id ORDER BY t_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) WHERE same")
def homogeneous_window(t: Tables) -> DataFrame:
    f = by_session("t_idx").rowsBetween(-1, 0)
    same = (F.min("channel").over(f) == F.max("channel").over(f)) & (F.count(F.lit(1)).over(f) == 2)
    return t.traces().withColumn("same", same).where("same").select("event_id", "channel")


@query(f"WITH {ACT}, n AS (SELECT session_id, max(t_idx) AS last FROM fr GROUP BY session_id) SELECT session_id, vertex, round(avg(value), 6) AS mean FROM act JOIN n USING (session_id) WHERE last < 4 OR (t_idx > 0 AND t_idx < last) GROUP BY ALL")
def trimmed_mean(t: Tables) -> DataFrame:
    f = t.frames().withColumn("last", F.max("t_idx").over(by_session())).where("last < 4 OR (t_idx > 0 AND t_idx < last)")
    return f.select("session_id", F.posexplode("vec").alias("v", "x")).groupBy("session_id", F.col("v").cast("long").alias("vertex")).agg(r6(F.avg("x"), "mean"))


@query(f"WITH {EV} SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY session_id ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS starts FROM ev")
def running_sum_excl(t: Tables) -> DataFrame:
    before = F.sum("value").over(by_session("t_idx").rowsBetween(W.unboundedPreceding, -1))
    return t.traces().select("event_id", F.round(F.coalesce(before, F.lit(0.0)), 4).alias("starts"))


@query("SELECT p_partkey, least(unnest(range(0, 1000 + p_size * 10 + 300, 300)), 1000 + p_size * 10) AS target FROM part")
def sequence_gen(t: Tables) -> DataFrame:
    limit = 1000 + F.col("p_size") * 10
    return t.part.select("p_partkey", F.explode(F.sequence(F.lit(0), limit + 299, F.lit(300))).alias("y"), limit.alias("top")).select("p_partkey", F.least("y", "top").cast("long").alias("target"))


@query(f"WITH RECURSIVE {EV}, q AS (SELECT session_id, t_idx, row_number() OVER (PARTITION BY session_id ORDER BY t_idx) AS i FROM ev WHERE value >= 15), r AS (SELECT session_id, t_idx, i, t_idx AS kept FROM q WHERE i = 1 UNION ALL SELECT q.session_id, q.t_idx, q.i, CASE WHEN q.t_idx - r.kept >= 3 THEN q.t_idx ELSE r.kept END FROM q JOIN r ON q.session_id = r.session_id AND q.i = r.i + 1) SELECT session_id, t_idx FROM r WHERE kept = t_idx")
def cooldown_dedupe(t: Tables) -> DataFrame:
    q = t.traces().where("value >= 15").groupBy("session_id").agg(F.sort_array(F.collect_list("t_idx")).alias("ts"))
    return q.select("session_id", F.explode(ts.cooldown(F.col("ts"), 3)).alias("t_idx"))


@query(f"WITH {EV}, l AS (SELECT * FROM ev WHERE channel = 'purchase'), s AS (SELECT * FROM ev WHERE channel = 'view'), k AS (SELECT l.event_id, s.event_id AS snapshot, s.t_idx AS snap_t, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(s.t_idx - l.t_idx), s.t_idx) AS k FROM l LEFT JOIN s USING (session_id)) SELECT event_id, snapshot, snap_t FROM k WHERE k = 1")
def asof_nearest(t: Tables) -> DataFrame:
    e = t.traces()
    left = e.where("channel = 'purchase'").select("session_id", "event_id", "t_idx")
    right = e.where("channel = 'view'").select("session_id", F.col("event_id").alias("snapshot"), F.col("t_idx").alias("snap_t"))
    return ts.nearest(left, right, ["session_id"], "t_idx", "snap_t", "snap_t", ["snapshot", "snap_t"]).select("event_id", "snapshot", "snap_t")


@query(f"WITH {EV} SELECT event_id, 'block' || CAST(floor((t_idx - 3) / 10.0) AS BIGINT) AS label FROM ev WHERE t_idx >= 3 AND (t_idx - 3) % 10 >= 2 AND (t_idx - 3) % 10 < 8")
def interval_label_join(t: Tables) -> DataFrame:
    """Lagged times that fall within blocks less their transitions; the block number is an equi-join key."""
    e = t.traces().withColumn("block", F.floor((F.col("t_idx") - 3) / 10.0))
    start = F.col("block") * 10 + 3
    blocks = e.where("block >= 0").select("block").distinct().select("block", (start + 2).alias("low"), (start + 8).alias("high"), F.concat(F.lit("block"), F.col("block").cast("string")).alias("label"))
    return e.join(blocks, "block").where("t_idx >= low AND t_idx < high").select("event_id", "label")


@query(f"WITH {EV}, c AS (SELECT channel, t_idx, avg(value) AS m FROM ev GROUP BY ALL), p AS (SELECT a.channel AS a, b.channel AS b, a.t_idx, row_number() OVER (PARTITION BY a.channel, b.channel ORDER BY a.t_idx) AS i, abs(a.m - b.m) >= 8 AS far FROM c a JOIN c b ON a.t_idx = b.t_idx AND a.channel < b.channel), g AS (SELECT *, i - row_number() OVER (PARTITION BY a, b ORDER BY t_idx) AS g FROM p WHERE far) SELECT a, b, min(t_idx) AS t_start, max(t_idx) AS t_end, count(*) AS n_frames FROM g GROUP BY a, b, g HAVING count(*) >= 2")
def pairwise_divergence(t: Tables) -> DataFrame:
    c = t.traces().groupBy("channel", "t_idx").agg(F.avg("value").alias("m"))
    p = c.select("t_idx", F.col("channel").alias("a"), F.col("m").alias("ma")).join(c.select("t_idx", F.col("channel").alias("b"), F.col("m").alias("mb")), "t_idx").where("a < b")
    runs = ts.islands(p, ["a", "b"], "t_idx", F.abs(F.col("ma") - F.col("mb")) >= 8)
    return runs.groupBy("a", "b", "run").agg(F.min("t_idx").alias("t_start"), F.max("t_idx").alias("t_end"), F.count(F.lit(1)).alias("n_frames")).where("n_frames >= 2").drop("run")


@query(f"WITH {EV}, z AS (SELECT session_id, t_idx, channel, value, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) AS z, stddev_pop(value) OVER w AS s FROM ev WINDOW w AS (PARTITION BY session_id, channel)) SELECT session_id, t_idx, 'engagement' AS trigger_type, channel, round(z, 6) AS value FROM z WHERE channel = 'purchase' AND abs(z) >= 2.0 AND s >= 1e-7 UNION ALL SELECT session_id, t_idx, 'emotion', channel, round(z, 6) FROM z WHERE channel <> 'purchase' AND z > 2.0 AND s >= 1e-7")
def trigger_union(t: Tables) -> DataFrame:
    z = stats.session_z(t.traces(), ["session_id", "channel"], "value")
    keep = lambda kind, where: z.where(where).select("session_id", "t_idx", F.lit(kind).alias("trigger_type"), "channel", r6("z", "value"))
    return keep("engagement", "channel = 'purchase' AND abs(z) >= 2.0").unionByName(keep("emotion", "channel <> 'purchase' AND z > 2.0"))


@query(f"WITH {PARCELS}, z AS (SELECT session_id, t_idx, parcel, (value - mean) / std AS z FROM par JOIN norm USING (parcel)), k AS (SELECT *, row_number() OVER (PARTITION BY session_id, t_idx ORDER BY round(abs(z), 9) DESC, parcel) AS k FROM z), n AS (SELECT session_id, t_idx, max(abs(z)) AS strength FROM z GROUP BY ALL) SELECT k.session_id, k.t_idx, string_agg(CAST(parcel AS VARCHAR), ',' ORDER BY k) AS top_parcels, round(max(n.strength), 6) AS strength FROM k JOIN n USING (session_id, t_idx) WHERE k <= 5 GROUP BY ALL")
def neural_moments(t: Tables) -> DataFrame:
    p = parcels(t)
    z = stats.z_against(p, stats.norm_table(p, ["parcel"], "value", quantiles=False), "parcel", "value")
    order = F.array_sort(F.collect_list(F.struct((-F.round(F.abs("z"), 9)).alias("s"), F.col("parcel").alias("p"))))
    g = z.groupBy("session_id", "t_idx").agg(F.slice(order, 1, 5).alias("top"), F.max(F.abs("z")).alias("strength"))
    return g.select("session_id", "t_idx", F.array_join(F.transform("top", lambda x: x["p"].cast("string")), ",").alias("top_parcels"), r6("strength", "strength"))


@query(f"WITH {NOV}, x AS (SELECT session_id, t_idx, CASE WHEN t_idx % 4 = 3 THEN NULL ELSE van - dmn END AS e, novelty AS a FROM nov), f AS (SELECT *, count(e) OVER w AS k, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY session_id)) SELECT session_id, t_idx, round(CASE WHEN k = n THEN e WHEN count(a) OVER (PARTITION BY session_id) = n THEN a ELSE coalesce(e, 0) END, 6) AS value, CASE WHEN k = n THEN 'engagement' WHEN count(a) OVER (PARTITION BY session_id) = n THEN 'activation' ELSE 'partial' END AS source FROM f")
def source_fallback(t: Tables) -> DataFrame:
    from ..operators.tracks import source_fallback as op

    x = track(t).withColumn("e", F.when(F.col("t_idx") % 4 != 3, F.col("engagement"))).withColumnRenamed("novelty", "a")
    return op(x, ["session_id"], [("engagement", "e"), ("activation", "a")], "partial").select("session_id", "t_idx", r6("value", "value"), "source")


