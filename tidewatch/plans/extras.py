"""Priors of elements, small conversions, coarse norms, window features, joins of training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as S
from .base import ACT, Tables, query
from .kernel import r6

#: A window of 1000 x 800 with a box for each part.
_BOX = "p_partkey * 37 % 900 AS x, p_partkey * 91 % 700 AS y, p_size * 2 AS w, p_size AS h"


@query(f"""
WITH b AS (SELECT p_partkey, {_BOX} FROM part),
     c AS (SELECT p_partkey, (x + w / 2.0) / 1000 AS cx, (y + h / 2.0) / 800 AS cy FROM b)
SELECT p_partkey,
       round(0.62 * (1 - least(1, sqrt((cx - 0.5) * (cx - 0.5) + (cy - 0.42) * (cy - 0.42)) / 0.72)) + 0.38 * (1 - least(1, cy * 0.72)), 6) AS score
FROM c
""")
def position_prior(t: Tables) -> DataFrame:
    box = t.part.selectExpr("p_partkey", *_BOX.split(", "))
    x, y = F.col("x"), F.col("y")
    return box.select("p_partkey", r6(S.position_score(x, y, x + F.col("w"), y + F.col("h"), 1000, 800), "score"))


@query("""
SELECT p_partkey,
       CAST(CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 1.0
            WHEN p_partkey % 3 = 0 THEN 0.92
            WHEN p_partkey % 4 = 1 THEN 0.8
            WHEN p_partkey % 4 = 2 THEN 0.45 ELSE 0.3 END AS DOUBLE) AS score
FROM part
""")
def type_prior(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    tag = F.when(k % 4 == 1, "a").when(k % 4 == 2, "H1").otherwise("DIV")
    role = F.when(k % 5 == 0, "Button")
    dom_id = F.when(k % 7 == 0, "main-CTA").otherwise("box")
    text = F.when(k % 3 == 0, "Get Started now").otherwise("words")
    return t.part.select("p_partkey", S.type_score(tag, role, dom_id, text, {"A": 0.8, "H1": 0.45}).alias("score"))


@query("""
SELECT event_id,
       round(least(1, greatest(0, (value - 1) / 8)), 6) AS rating,
       greatest(1, CAST(ceil(value / 1.5) AS BIGINT)) AS steps,
       round(CASE WHEN event_id % 10 <= 4 THEN 1 ELSE (event_id % 100) / (event_id % 10 - 4.0) END, 6) AS scrolled,
       CASE WHEN event_id % 3 = 0 OR value <= 0 THEN 0 ELSE greatest(0, CAST(floor(20 / (value / (event_id % 3) * 2.5 / 3600)) AS BIGINT) - 5) END AS items
FROM events
""")
def small_conversions(t: Tables) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    return t.events.select(
        "event_id",
        r6(S.likert_unit(v), "rating"),
        S.expected_steps(v, F.lit(1.5)).alias("steps"),
        r6(S.scroll_fraction(k % 100, k % 10, F.lit(4)), "scrolled"),
        S.items_for_budget(v, k % 3, F.lit(20.0), F.lit(2.5), F.lit(5)).alias("items"),
    )


@query(f"""
WITH {ACT},
     p AS (SELECT session_id, t_idx, parcel, network, avg(value) AS value FROM act GROUP BY ALL),
     n AS (SELECT parcel, network, avg(value) AS mean, greatest(stddev_pop(value), 1e-8) AS std, count(*) AS n FROM p GROUP BY ALL)
SELECT CASE network WHEN 0 THEN 'Vis' WHEN 1 THEN 'SomMot' ELSE 'net_' || (network + 1) END AS name,
       round(avg(mean), 6) AS mean, round(avg(std), 6) AS std, avg(n) AS n_samples
FROM n GROUP BY network
""")
def coarse_norms(t: Tables) -> DataFrame:
    """Norms of fine groups as the plain means of their coarse group; names by number, 'net_' and the number for unknown ones."""
    fine = t.activation().groupBy("session_id", "t_idx", "parcel", "network").agg(F.avg("value").alias("value"))
    norms = fine.groupBy("parcel", "network").agg(F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(1e-8)).alias("std"), F.count(F.lit(1)).alias("n"))
    names = {1: "Vis", 2: "SomMot"}
    number = F.col("network") + 1
    name = F.concat(F.lit("net_"), number.cast("string"))
    for k, v in names.items():
        name = F.when(number == k, v).otherwise(name)
    return norms.groupBy("network").agg(r6(F.avg("mean"), "mean"), r6(F.avg("std"), "std"), F.avg("n").alias("n_samples")).select(name.alias("name"), "mean", "std", "n_samples")


@query(f"""
WITH {ACT}, f AS (SELECT session_id, t_idx, parcel, sum(value) AS s, sum(abs(value)) AS a, count(*) AS n FROM act GROUP BY ALL)
SELECT session_id, t_idx, parcel,
       round(sum(s) OVER w / sum(n) OVER w, 6) AS mean, round(sum(a) OVER w / sum(n) OVER w, 6) AS mean_abs
FROM f WINDOW w AS (PARTITION BY session_id, parcel ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
""")
def window_features(t: Tables) -> DataFrame:
    """Group reducers over a centred window of five frames, shorter at the ends: sums by frame, then over frames."""
    frames = t.activation().groupBy("session_id", "t_idx", "parcel").agg(F.sum("value").alias("s"), F.sum(F.abs("value")).alias("a"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("session_id", "parcel").orderBy("t_idx").rowsBetween(-2, 2)
    n = F.sum("n").over(w)
    return frames.select("session_id", "t_idx", "parcel", r6(F.sum("s").over(w) / n, "mean"), r6(F.sum("a").over(w) / n, "mean_abs"))


@query(f"""
WITH {ACT}, g AS (SELECT session_id, parcel, stddev_pop(value) AS std FROM act GROUP BY ALL)
SELECT session_id, round(avg(std), 6) AS mean_std, round(min(std), 6) AS min_std, round(max(std), 6) AS max_std FROM g GROUP BY ALL
""")
def within_group_std(t: Tables) -> DataFrame:
    groups = t.activation().groupBy("session_id", "parcel").agg(F.stddev_pop("value").alias("std"))
    return groups.groupBy("session_id").agg(r6(F.avg("std"), "mean_std"), r6(F.min("std"), "min_std"), r6(F.max("std"), "max_std"))


@query("""
SELECT d.doc_id, l.quality, e.label AS cluster, round(list_sum(CAST(e.embedding AS DOUBLE[])), 6) AS feature_sum
FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id
WHERE len(list_filter(e.embedding, lambda x: NOT isfinite(x))) = 0
""")
def training_join(t: Tables) -> DataFrame:
    """Rows of a manifest that have ratings and finite features."""
    features = t.embeddings.where(~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    features = features.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"), r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), "feature_sum"))
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id").join(features, "doc_id")


@query("""
WITH h AS (SELECT page_id, page_id % 5 AS session, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), ''), NULL) AS host FROM pages),
     s AS (SELECT session, arg_min(host, page_id) AS own FROM h WHERE host IS NOT NULL GROUP BY session)
SELECT session, own, arg_min(host, page_id) FILTER (host <> own) AS other FROM h JOIN s USING (session) GROUP BY session, own
""")
def host_mismatch(t: Tables) -> DataFrame:
    """Of each session its first host, and the first other one, if any."""
    host = F.nullif(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit(""))
    rows = t.pages.select("page_id", (F.col("page_id") % 5).alias("session"), host.alias("host")).where("host IS NOT NULL")
    own = rows.groupBy("session").agg(F.min_by("host", "page_id").alias("own"))
    pairs = rows.join(own, "session")
    return pairs.groupBy("session", "own").agg(F.min_by(F.when(F.col("host") != F.col("own"), F.col("host")), F.when(F.col("host") != F.col("own"), F.col("page_id"))).alias("other"))


@query(f"""
WITH {ACT},
     f AS (SELECT session_id, t_idx, network, parcel, exp(avg(value)) AS e FROM act GROUP BY ALL),
     q AS (SELECT *, e / sum(e) OVER (PARTITION BY session_id, t_idx, network) AS fine, sum(e) OVER (PARTITION BY session_id, t_idx, network) / sum(e) OVER (PARTITION BY session_id, t_idx) AS coarse FROM f)
SELECT session_id, t_idx, parcel, round(fine * coarse, 6) AS p FROM q
""")
def coarse_times_fine(t: Tables) -> DataFrame:
    """The probability of a class as that of its coarse class times its own within it."""
    e = t.activation().groupBy("session_id", "t_idx", "network", "parcel").agg(F.exp(F.avg("value")).alias("e"))
    frame = W.partitionBy("session_id", "t_idx")
    inner = F.sum("e").over(W.partitionBy("session_id", "t_idx", "network"))
    return e.select("session_id", "t_idx", "parcel", r6(F.col("e") / inner * (inner / F.sum("e").over(frame)), "p"))
