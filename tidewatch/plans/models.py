"""Models on moments: ridge with groups left out, resampled correlations, explained variance beyond a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import components as P
from ..functions.specs import FeatureSpec
from ..operators import decoders as D
from ..operators import features as X
from ..operators import moments as M
from ..operators import ridge as R
from ..operators import splits, stats
from .base import Tables, query
from .kernel import ACT, FR, PARCELS, parcels, r6

_SUMS = ("n", "a", "b", "y", "aa", "ab", "bb", "ay", "by_", "yy")
_ALPHAS = (1.0, 1000.0, 100000.0)


def _each(template: str) -> str:
    return ", ".join(f"{template.replace('#', c)} AS {c}" for c in _SUMS)


def _fit(source: str) -> str:
    """Slopes wa, wb and intercept w0 of a table with sums, for each penalty; two standardised features."""
    return f"""
SELECT q.*, alpha, wa, wb, (y - wa * a - wb * b) / n AS w0 FROM (
  SELECT p.*, alpha, ((n + alpha) * ca - cab * cb) / ((n + alpha) * (n + alpha) - cab * cab) / da AS wa, ((n + alpha) * cb - cab * ca) / ((n + alpha) * (n + alpha) - cab * cab) / db AS wb
  FROM (SELECT *, (ab - a * b / n) / (da * db) AS cab, (ay - a * y / n) / da AS ca, (by_ - b * y / n) / db AS cb
        FROM (SELECT *, sqrt(aa / n - (a / n) ** 2) AS da, sqrt(bb / n - (b / n) ** 2) AS db FROM {source})) p, al) q
"""


_ERROR = "{v}.yy - 2 * (w0 * {v}.y + wa * {v}.ay + wb * {v}.by_) + w0 * w0 * {v}.n + wa * wa * {v}.aa + wb * wb * {v}.bb + 2 * (w0 * wa * {v}.a + w0 * wb * {v}.b + wa * wb * {v}.ab)"


@query(f"""
WITH al AS (SELECT unnest([{', '.join(map(str, _ALPHAS))}]) AS alpha),
r AS (SELECT l_suppkey AS g, CAST('0x' || substr(md5(CAST(l_suppkey AS VARCHAR)), 1, 8) AS BIGINT) % 4 AS f, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, l_extendedprice / 1000.0 AS price, CAST(l_tax AS DOUBLE) AS tax FROM lineitem),
u AS (SELECT g, f, a, b, 'price' AS target, price AS y FROM r UNION ALL SELECT g, f, a, b, 'tax', tax FROM r),
s AS (SELECT target, g, f, CAST(count(*) AS DOUBLE) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy FROM u GROUP BY ALL),
t AS (SELECT target, {_each('sum(#)')} FROM s GROUP BY target),
k AS (SELECT target, f, {_each('sum(#)')} FROM s GROUP BY target, f),
v AS (SELECT s.target, s.g, k.f, {_each('k.# - CASE WHEN s.f = k.f THEN s.# ELSE 0 END')} FROM s JOIN k USING (target)),
tr AS (SELECT v.target, v.g, v.f, {_each('t.# - s.# - v.#')} FROM v JOIN s ON s.target = v.target AND s.g = v.g JOIN t ON t.target = v.target WHERE v.n > 0),
tf AS ({_fit('tr')}),
e AS (SELECT tf.target, tf.g, alpha, sum({_ERROR.format(v='v')}) AS sse FROM tf JOIN v ON v.target = tf.target AND v.g = tf.g AND v.f = tf.f GROUP BY ALL),
c AS (SELECT target, g, arg_min(alpha, sse) AS alpha FROM e GROUP BY ALL),
rest AS (SELECT s.target, s.g, {_each('t.# - s.#')} FROM s JOIN t USING (target)),
w AS (SELECT m.target, m.g, m.alpha, w0, wa, wb FROM ({_fit('rest')}) m JOIN c ON c.target = m.target AND c.g = m.g AND c.alpha = m.alpha),
o AS (SELECT u.target, u.y, w0 + wa * u.a + wb * u.b AS p FROM u JOIN w ON w.target = u.target AND w.g = u.g)
SELECT target, n, groups, r, mse, mean_log_alpha
FROM (SELECT target, count(*) AS n, round(corr(y, p), 6) AS r, round(avg((y - p) ** 2), 6) AS mse FROM o GROUP BY target)
JOIN (SELECT target, count(*) AS groups, round(avg(log10(alpha)), 6) AS mean_log_alpha FROM w GROUP BY target) USING (target)
""")
def ridge_nested(t: Tables) -> DataFrame:
    """Suppliers left out one by one; penalties chosen on folds of the others."""
    rows = t.lineitem.select("l_suppkey", F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), (F.col("l_extendedprice") / 1000.0).alias("price"), F.col("l_tax").alias("tax"))
    models = R.leave_group_out(rows, "l_suppkey", ["a", "b"], ["price", "tax"], _ALPHAS, 4)
    return R.ridge_report(models).select("target", "n", "groups", *[r6(c, c) for c in ("r", "mse", "mean_log_alpha")])


_STEPS = "[" + ", ".join(map(str, M.POISSON)) + "]"


@query(f"""
WITH s AS (SELECT l_returnflag, l_suppkey AS g, CAST(count(*) AS DOUBLE) AS n, sum(l_extendedprice) AS sx, sum(l_quantity) AS sy, sum(l_extendedprice * l_extendedprice) AS sxx, sum(l_quantity * l_quantity) AS syy, sum(l_extendedprice * l_quantity) AS sxy FROM lineitem GROUP BY ALL),
w AS (SELECT g, b, len(list_filter({_STEPS}, lambda p: CAST('0x' || substr(md5(g || ':' || b), 1, 12) AS BIGINT) / 281474976710656.0 >= p)) AS w FROM (SELECT DISTINCT g FROM s), range(200) r(b)),
d AS (SELECT l_returnflag, b, sum(w * n) AS n, sum(w * sx) AS sx, sum(w * sy) AS sy, sum(w * sxx) AS sxx, sum(w * syy) AS syy, sum(w * sxy) AS sxy FROM s JOIN w USING (g) WHERE w > 0 GROUP BY ALL),
r AS (SELECT l_returnflag, (sxy / n - sx / n * (sy / n)) / sqrt((sxx / n - (sx / n) ** 2) * (syy / n - (sy / n) ** 2)) AS r FROM d)
SELECT l_returnflag, x.n, round(x.r, 6) AS r, round(quantile_cont(r.r, 0.025), 6) AS low, round(quantile_cont(r.r, 0.975), 6) AS high
FROM r JOIN (SELECT l_returnflag, count(*) AS n, corr(l_extendedprice, l_quantity) AS r FROM lineitem GROUP BY ALL) x USING (l_returnflag) GROUP BY ALL
""")
def bootstrap_r(t: Tables) -> DataFrame:
    """The correlation of price and quantity by return flag, suppliers drawn anew 200 times."""
    rows = t.lineitem.select("l_returnflag", "l_suppkey", "l_extendedprice", "l_quantity")
    out = M.bootstrap_correlation(rows, ["l_returnflag"], "l_suppkey", "l_extendedprice", "l_quantity", 200)
    return out.select("l_returnflag", "n", *[r6(c, c) for c in ("r", "low", "high")])


@query("""
WITH r AS (SELECT c_nationkey AS s, CAST(c_mktsegment = 'BUILDING' AS INT) AS a, CAST(c_mktsegment = 'MACHINERY' AS INT) AS b, CAST(c_acctbal AS DOUBLE) AS y FROM customer),
d AS (SELECT a - avg(a) OVER () AS a, b - avg(b) OVER () AS b, y - avg(y) OVER () AS y, a - avg(a) OVER w AS wa, b - avg(b) OVER w AS wb, y - avg(y) OVER w AS wy FROM r WINDOW w AS (PARTITION BY s)),
m AS (SELECT count(*) AS n, sum(y * y) AS yy, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_,
        sum(wy * wy) AS wyy, sum(wa * wa) AS waa, sum(wa * wb) AS wab, sum(wb * wb) AS wbb, sum(wa * wy) AS way, sum(wb * wy) AS wby FROM d),
x AS (SELECT n, 1 - wyy / yy AS site, (bb * ay * ay - 2 * ab * ay * by_ + aa * by_ * by_) / (aa * bb - ab * ab) / yy AS demo,
        1 - (wyy - (wbb * way * way - 2 * wab * way * wby + waa * wby * wby) / (waa * wbb - wab * wab)) / yy AS both_ FROM m)
SELECT 'balance' AS target, n, round(greatest(0, site), 6) AS r2_site, round(greatest(0, demo), 6) AS r2_features, round(greatest(0, both_ - site), 6) AS r2_beyond FROM x
""")
def r2_beyond_site(t: Tables) -> DataFrame:
    """What the market segment explains of balances beyond the nation's mean."""
    rows = t.customer.select("c_nationkey", *M.dummies("c_mktsegment", ["", "BUILDING", "MACHINERY"]), F.col("c_acctbal").alias("balance"))
    out = M.explained_beyond(rows, "c_nationkey", ["c_mktsegment_BUILDING", "c_mktsegment_MACHINERY"], ["balance"])
    return out.select("target", "n", *[r6(c, c) for c in ("r2_site", "r2_features", "r2_beyond")])


_SPLIT = """
WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey AS g, {label} AS c FROM lineitem),
o AS (SELECT g, row_number() OVER (ORDER BY md5('42:' || g)) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM r)),
h AS (SELECT *, least(greatest(1, CAST(floor({fraction} * n + 0.5) AS BIGINT)), n - 1) AS held FROM o),
k AS (SELECT DISTINCT c, place, n, held FROM r JOIN h USING (g) WHERE c IS NOT NULL),
s AS (SELECT s.s, c, count(*) FILTER ((place - s.s + n) % n >= held) AS outside, count(*) FILTER ((place - s.s + n) % n < held) AS inside FROM k, (SELECT place AS s FROM o) s GROUP BY ALL),
f AS (SELECT s, min(outside) > 0 AS train, min(inside) > 0 AS held FROM s GROUP BY s),
b AS (SELECT {start} AS start FROM f)
SELECT l_orderkey, l_linenumber, coalesce((place - start + n) % n < held, false) AS held_out FROM r JOIN h USING (g), b
"""


@query(_SPLIT.format(label="CASE WHEN l_extendedprice > 90000 OR l_orderkey % 977 = 0 THEN 'rare' ELSE l_returnflag END", fraction=0.2, start="coalesce(min(s) FILTER (train), 0)"))
def validation_split(t: Tables) -> DataFrame:
    """A fifth of the suppliers held out, every class left in the rest."""
    rare = (F.col("l_extendedprice") > 90000) | (F.col("l_orderkey") % 977 == 0)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.when(rare, "rare").otherwise(F.col("l_returnflag")).alias("class"))
    return splits.split_groups(rows, "l_suppkey", "class", 0.2).select("l_orderkey", "l_linenumber", "held_out")


@query(_SPLIT.format(label="CAST(l_orderkey % 311 = 0 AS INT)", fraction=0.1, start="coalesce(min(s) FILTER (train AND held), min(s) FILTER (train))"))
def calibration_split(t: Tables) -> DataFrame:
    """A tenth of the suppliers held out, both classes on both sides."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_orderkey") % 311 == 0).cast("int").alias("class"))
    return splits.split_groups(rows, "l_suppkey", "class", 0.1, both=True).select("l_orderkey", "l_linenumber", "held_out")


def _power(source: str, name: str) -> str:
    """SQL: the first eigenvector of a matrix of lists by 80 steps, its largest loading positive."""
    return f"""
{name}_i AS (SELECT 0 AS k, list_transform(range(64), lambda i: 1.0 / (1 + i)) AS v UNION ALL
  SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y))))
  FROM (SELECT k, list_transform(m, lambda r: list_inner_product(r, v)) AS w FROM {name}_i, {source} WHERE k < 80)),
{name} AS (SELECT list_transform(v, lambda x: x * sign(v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))])) AS v FROM {name}_i WHERE k = 80)"""


@query(f"""
WITH RECURSIVE x AS (SELECT vec_id, list_transform(range(64), lambda i: CAST(embedding[i + 1] AS DOUBLE) / (1 + i)) AS v FROM embeddings),
l AS (SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM x),
u AS (SELECT i, avg(x) AS mean FROM l GROUP BY i),
d AS (SELECT vec_id, i, x - mean AS x FROM l JOIN u USING (i)),
e AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / ((SELECT count(*) FROM x) - 1) AS c FROM d a JOIN d b USING (vec_id) GROUP BY ALL),
c1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM e GROUP BY i)),
{_power('c1', 'p1')},
c2 AS (SELECT list_transform(range(64), lambda i: list_transform(range(64), lambda j: m[i + 1][j + 1] - v[i + 1] * v[j + 1] * list_inner_product(list_transform(m, lambda r: list_inner_product(r, v)), v))) AS m FROM c1, p1),
{_power('c2', 'p2')}
SELECT vec_id, round(sum(x * p1.v[i + 1]), 5) AS first, round(sum(x * p2.v[i + 1]), 5) AS second FROM d, p1, p2 GROUP BY vec_id
""")
def principal_scores(t: Tables) -> DataFrame:
    """Coordinates along the first two principal components of vectors whose dimensions fade."""
    rows = t.embeddings.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x / (1 + i)).alias("v"))
    scores = P.project(rows, "v", P.principal_components(rows, "v", 2), "y")
    return scores.select("vec_id", F.round(F.col("y")[0], 5).alias("first"), F.round(F.col("y")[1], 5).alias("second"))


def parcel_frames(t: Tables) -> DataFrame:
    """session_id, t_idx, vec: the means of each frame's eight parcels."""
    return t.frames().select("session_id", "t_idx", S.block_means(F.col("vec"), 8).alias("vec"))


def parcel_model(t: Tables) -> D.LinearModel:
    """Parcels standardised by their norms, weighed by each session's mean; a session is a class."""
    p = parcels(t)
    norms = stats.norm_table(p, ["parcel"], "value", quantiles=False)
    weights = p.groupBy(F.col("session_id").cast("string").alias("class"), F.col("parcel").cast("int").alias("pos")).agg(F.avg("value").alias("weight"))
    classes = t.embeddings.select(F.col("label").cast("string").alias("class"), F.col("label").alias("place"), F.lit(0.5).alias("intercept")).where("class IS NOT NULL").distinct()
    return D.LinearModel(norms.select(F.col("parcel").cast("int").alias("pos"), "mean", F.col("std").alias("scale")), weights, classes)


_TRACK = f"""{PARCELS}, wt AS (SELECT session_id AS class, parcel, avg(value) AS w FROM par GROUP BY ALL),
tk AS (SELECT par.session_id, t_idx, class, 0.5 + sum(w * (value - mean) / std) AS score FROM par JOIN norm USING (parcel) JOIN wt USING (parcel) GROUP BY ALL)"""


@query(f"WITH {_TRACK} SELECT session_id, t_idx, CAST(class AS VARCHAR) AS class, round(score, 6) AS score, round(greatest(0, least(1, score)), 6) AS probability FROM tk")
def emotion_track(t: Tables) -> DataFrame:
    """A fitted pipeline of tables over all frames."""
    track = D.apply_linear(parcel_frames(t), "vec", parcel_model(t))
    rows = track.select("session_id", "t_idx", F.explode(F.arrays_zip("names", "scores", "probabilities")).alias("x"))
    return rows.select("session_id", "t_idx", F.col("x.names").alias("class"), r6("x.scores", "score"), r6("x.probabilities", "probability"))


@query(f"""WITH {_TRACK},
te AS (SELECT class, sqrt(sum(w * w)) AS n FROM wt GROUP BY class),
co AS (SELECT par.session_id, t_idx, class, greatest(-1, least(1, sum(w * value) / (sqrt(sum(value * value)) + 1e-8) / any_value(te.n))) AS score FROM par JOIN wt USING (parcel) JOIN te USING (class) GROUP BY ALL),
a AS (SELECT 'decoder' AS asked, 'decoder' AS mode, 'asked' AS reason, session_id, t_idx, score FROM tk
      UNION ALL SELECT 'decoder', 'template', 'missing subcortical', session_id, t_idx, score FROM co UNION ALL SELECT 'template', 'template', 'asked', session_id, t_idx, score FROM co)
SELECT asked, mode, reason, session_id, count(DISTINCT t_idx) AS frames, round(max(score), 6) AS best FROM a GROUP BY ALL""")
def emotion_track_modes(t: Tables) -> DataFrame:
    """Decoder, decoder without what it needs, templates: what each of them ran as, and why."""
    frames, model = parcel_frames(t), parcel_model(t)
    means = parcels(t).groupBy("session_id", "parcel").agg(F.avg("value").alias("y")).groupBy(F.col("session_id").cast("string").alias("class"))
    templates = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("parcel", "y"))), lambda s: s["y"]).alias("vec"))
    tracks = [D.track_by_mode(frames, "vec", *how) for how in (("decoder", model, templates), (" Decoder", model, templates, ["subcortical"]), ("template", model, templates))]
    rows = [x.select("asked", "mode", "reason", "session_id", "t_idx", F.array_max("scores").alias("s")) for x in tracks]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return both.groupBy("asked", "mode", "reason", "session_id").agg(F.countDistinct("t_idx").alias("frames"), r6(F.max("s"), "best"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus, o_totalprice, p_brand, p_size FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey")
def strict_training_join(t: Tables) -> DataFrame:
    """Every line with its order and part; a line without one, or with two, fails the job."""
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice")
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    rows = X.strict_join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), orders, ["l_orderkey"], "order")
    return X.strict_join(rows, parts, ["l_partkey"], "part").drop("l_partkey")


@query("WITH f AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN f ON o_custkey = c_custkey")
def first_match(t: Tables) -> DataFrame:
    """Customers with orders, and their first."""
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    return X.first_match_join(t.customer.select("c_custkey"), orders, ["c_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(f"""
WITH {ACT},
s AS (SELECT session_id, t_idx, parcel, count(value) AS n, sum(value) AS s, sum(value * value) AS q, sum(abs(value)) AS a, max(abs(value)) AS m, max(value) AS high, min(value) AS low FROM act GROUP BY ALL),
v AS (SELECT session_id, t_idx, parcel, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(a) OVER w AS a, max(m) OVER w AS m, max(high) OVER w AS high, min(low) OVER w AS low FROM s WINDOW w AS (PARTITION BY session_id, parcel ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
f AS (SELECT session_id, t_idx, parcel * 6 + i AS i, [s / n, sqrt(greatest(q / n - (s / n) * (s / n), 0)), a / n, m, high, low][i + 1] AS x FROM v, range(6) r(i)),
e AS (SELECT session_id, t_idx, 48 + network AS i, avg(value) AS x FROM act WHERE t_idx > 0 GROUP BY ALL UNION ALL SELECT session_id, t_idx, 48 + i, 0 FROM fr, range(4) r(i) WHERE t_idx = 0),
b AS (SELECT * FROM f UNION ALL SELECT * FROM e)
SELECT session_id, t_idx, count(*) AS n_features, round(sum((i + 1) * x), 5) AS weighted, round(max(x) FILTER (i = 0), 6) AS first, round(max(x) FILTER (i = 13), 6) AS inner_, round(max(x) FILTER (i = 51), 6) AS last FROM b GROUP BY ALL
""")
def feature_matrix(t: Tables) -> DataFrame:
    """Six reducers of eight parcels over five frames, and the four networks' means, which the first frame lacks."""
    spec = FeatureSpec("parcels", ("mean", "std", "mean_abs", "max_abs", "max", "min"), "networks", 4, 5)
    extra = t.frames().where("t_idx > 0").select("session_id", "t_idx", S.block_means(F.col("vec"), 16).alias("sub"))
    out = X.feature_matrix(t.activation(), ["session_id"], "t_idx", "parcel", "value", spec, extra)
    weighted = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    at = lambda i, name: r6(F.col("features")[i], name)
    return out.select("session_id", "t_idx", F.size("features").cast("long").alias("n_features"), F.round(weighted, 5).alias("weighted"), at(0, "first"), at(13, "inner_"), at(51, "last"))


@query(f"""
WITH {FR}, s AS (SELECT session_id, count(*) AS n_t, max(len(vec)) AS n_v, min(list_min(vec)) AS low, max(list_max(vec)) AS high, max(t_idx) AS last FROM fr GROUP BY ALL),
p AS (SELECT s.*, t_idx, unnest(range(64)) AS vertex, unnest(vec) AS value FROM s JOIN fr ON fr.session_id = s.session_id AND t_idx = least(30, last))
SELECT session_id, n_t, n_v, round(low, 6) AS low, round(high, 6) AS high, t_idx, CAST(row_number() OVER (PARTITION BY session_id ORDER BY value DESC, vertex DESC) AS INT) AS rank, CAST(vertex AS INT) AS vertex, round(value, 6) AS value FROM p QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY value DESC, vertex DESC) <= 10
""")
def inspect_frames(t: Tables) -> DataFrame:
    """Each session's shape and extremes, and the ten largest values of frame 30, or of the last one."""
    out = X.inspect_frames(t.frames(), ["session_id"], "t_idx", "vec", 30, 10)
    return out.select("session_id", "n_t", "n_v", r6("low", "low"), r6("high", "high"), "t_idx", "rank", "vertex", r6("value", "value"))
