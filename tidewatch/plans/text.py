"""Copy, URLs, JSON and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import reshape as R
from .base import EV, FR, Tables, query
from .kernel import r6

GOAL = "the best onther and reand ention for thing"

SENT = r"snt AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS word_count, list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: trim(s) <> '') AS s FROM documents), len AS (SELECT *, CASE WHEN len(s) > 0 THEN list_sum(list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')))) / len(s) ELSE 0.0 END AS sentence FROM snt)"
CLEAR = SENT + ", clr AS (SELECT *, (CASE WHEN sentence <= 15 THEN 100.0 WHEN sentence >= 40 THEN 40.0 ELSE 100.0 - (sentence - 15) / 25.0 * 60.0 END) * CASE WHEN word_count < 10 THEN 0.6 WHEN word_count > 500 THEN 0.45 ELSE 1.0 END AS clarity FROM len)"
URGENT = "least(100.0, 16.0 * (" + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INT)" for w in T.CTA_VERBS + T.URGENCY_TERMS) + "))"
_GOAL_WORDS = "['" + "', '".join(w for w in dict.fromkeys(GOAL.split()) if w not in T.STOP_WORDS) + "']"
FIT = rf"least(100.0, 200.0 * len(list_intersect({_GOAL_WORDS}, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+'))) / len({_GOAL_WORDS}))"


def copy(t: Tables) -> DataFrame:
    """doc_id, word_count, sentence, clarity, urgency, goal_fit, copy_score, flags."""
    text = F.col("text")
    d = t.documents.select("doc_id", "text", F.size(T.words(text)).alias("word_count"), T.sentence_length(text).alias("sentence"), T.urgency(text).alias("urgency"), T.goal_fit(text, F.lit(GOAL)).alias("goal_fit"))
    d = d.withColumn("clarity", T.clarity(F.col("word_count"), F.col("sentence")))
    return d.withColumns({"copy_score": T.copy_score(F.col("clarity"), F.col("urgency"), F.col("goal_fit")), "flags": T.copy_flags(F.col("word_count"), F.col("urgency"))})


@query(f"WITH {SENT} SELECT doc_id, CAST(word_count AS BIGINT) AS word_count, round(sentence, 6) AS sentence FROM len")
def text_sentence_stats(t: Tables) -> DataFrame:
    return copy(t).select("doc_id", F.col("word_count").cast("long").alias("word_count"), r6("sentence", "sentence"))


@query(f"WITH {CLEAR} SELECT doc_id, round(clarity, 6) AS clarity FROM clr")
def text_clarity(t: Tables) -> DataFrame:
    return copy(t).select("doc_id", r6("clarity", "clarity"))


@query(f"SELECT doc_id, CAST({URGENT} AS DOUBLE) AS urgency FROM documents")
def text_urgency(t: Tables) -> DataFrame:
    return copy(t).select("doc_id", "urgency")


@query(f"SELECT doc_id, round({FIT}, 6) AS goal_fit FROM documents")
def text_goal_fit(t: Tables) -> DataFrame:
    return copy(t).select("doc_id", r6("goal_fit", "goal_fit"))


@query(f"WITH {CLEAR} SELECT doc_id, round(0.5 * clarity + 0.3 * {URGENT} + 0.2 * {FIT}, 6) AS copy_score FROM clr")
def text_copy_score(t: Tables) -> DataFrame:
    return copy(t).select("doc_id", r6("copy_score", "copy_score"))


@query(f"WITH {SENT} SELECT doc_id, concat_ws(',', CASE WHEN word_count < 10 THEN 'sparse_content' END, CASE WHEN word_count > 400 THEN 'wall_of_text' END, CASE WHEN {URGENT} > 70 THEN 'strong_cta' END) AS flags FROM snt")
def flags_array(t: Tables) -> DataFrame:
    return copy(t).select("doc_id", F.array_join("flags", ",").alias("flags"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), ''), 'unknown') AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') || CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '\\?([^#]*)', 1) ELSE '' END AS path FROM pages")
def url_parts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.host(F.col("url")).alias("host"), T.url_path(F.col("url")).alias("path"))


#: Links from a page at https://shop.test/a and whether they stay on it.
ORIGINS = [("/a/b", True), ("b?c=1", True), ("https://shop.test/x", True), ("https://sub.shop.test/", True), ("https://myshop.test/", False), ("https://elsewhere.test/", False), ("//elsewhere.test/", False), ("javascript:alert(1)", False), ("https:///x", False), ("mailto:a@shop.test", False)]


def _cases(t: Tables, cases: list[tuple[str, bool]]) -> Column:
    """The case of each page, by its id."""
    return F.get(F.array(*[F.lit(c) for c, _ in cases]), (F.col("page_id") % len(cases)).cast("int"))


def _expected(cases: list[tuple[str, bool]]) -> str:
    return f"page_id % {len(cases)} IN ({', '.join(str(i) for i, (_, ok) in enumerate(cases) if ok)})"


@query(f"SELECT page_id, {_expected(ORIGINS)} AS same, false AS without_base FROM pages")
def url_same_origin(t: Tables) -> DataFrame:
    absolute = F.lit("https:///y")
    return t.pages.select("page_id", T.same_origin(_cases(t, ORIGINS), F.lit("https://shop.test/a")).alias("same"), T.same_origin(absolute, F.lit("no address")).alias("without_base"))


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(url, '(logout|signout|delete|\\.pdf|[13579]$)')")
def regex_deny(t: Tables) -> DataFrame:
    return t.pages.where(~F.col("url").rlike(r"(logout|signout|delete|\.pdf|[13579]$)")).select("page_id")


#: Addresses and whether a crawler may fetch them.
FETCHES = [
    ("https://example.org/a", True), ("http://93.184.216.34:8080/", True), ("http://172.15.0.1/", True), ("http://172.32.0.1/", True), ("http://[2606:2800:220:1::1]/", True),
    ("ftp://example.org/", False), ("http://user:pw@example.org/", False), ("http:///x", False), ("http://localhost/", False), ("http://a.localhost:80/", False),
    ("http://127.0.0.1/", False), ("http://127.9.9.9/", False), ("http://10.1.2.3/", False), ("http://172.16.0.1/", False), ("http://172.31.255.255/", False), ("http://192.168.1.1/", False),
    ("http://169.254.169.254/latest", False), ("http://100.100.100.200/", False), ("http://0.0.0.0/", False), ("http://224.0.0.1/", False), ("http://[::1]/", False), ("http://[::]/", False),
    ("http://[fe80::1]/", False), ("http://[fd00::1]/", False), ("http://[::ffff:127.0.0.1]/", False), ("http://[::ffff:7f00:1]/", False), ("http://[64:ff9b::7f00:1]/", False), ("http://[2002:7f00:1::]/", False), ("http://[::7f00:1]/", False), ("http://127.0.0.1%2f/", False), ("http://①②⑦.0.0.1/", False), ("http://example.org\\@127.0.0.1/", False), ("http://2130706433/", False), ("http://0x7f.0.0.1/", False), ("file:///etc/passwd", False), ("http://300.1.1.1/", False),
]


@query(f"SELECT page_id, {_expected(FETCHES)} AS allowed FROM pages")
def url_guard(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.url_allowed(_cases(t, FETCHES)).alias("allowed"))


@query("SELECT page_id, length(regexp_replace(html, '<script', '<!-- script', 'gi')) AS safe_length, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_length FROM pages")
def html_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length(F.regexp_replace("html", "(?i)<script", "<!-- script")).cast("long").alias("safe_length"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("text_length"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("SELECT event_id, key AS name, CAST(value AS VARCHAR) AS value FROM (SELECT event_id, unnest(map_keys(m)) AS key, unnest(map_values(m)) AS value FROM (SELECT event_id, CAST(CAST(props AS JSON) AS MAP(VARCHAR, BIGINT)) AS m FROM events))")
def json_map_explode(t: Tables) -> DataFrame:
    return R.json_rows(t.events, ["event_id"], "props", "name", "value")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 10 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 5 AS extra FROM events")
def map_merge(t: Tables) -> DataFrame:
    old = F.from_json("props", "map<string,bigint>")
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.col("event_id") % 10, F.lit("extra"), F.col("event_id") % 5)).otherwise(F.create_map(F.lit("extra"), F.col("event_id") % 5))
    return t.events.select("event_id", R.merge_maps(old, new).alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["extra"].alias("extra"))


@query(f"WITH {FR} SELECT session_id, t_idx, CAST(i AS INT) AS parcel, round(list_avg(vec[i * 8 + 1:i * 8 + 8]), 6) AS value FROM fr, range(8) AS r(i)")
def melt_long(t: Tables) -> DataFrame:
    wide = t.frames().select("session_id", "t_idx", *[(F.aggregate(F.slice("vec", i * 8 + 1, 8), F.lit(0.0), lambda a, x: a + x) / 8).alias(str(i)) for i in range(8)])
    return R.melt(wide, ["session_id", "t_idx"], [str(i) for i in range(8)], "parcel", "value").select("session_id", "t_idx", F.col("parcel").cast("int").alias("parcel"), r6("value", "value"))


@query(f"WITH {EV} SELECT session_id, t_idx, value AS score, CASE WHEN value > 50 THEN 'high' END AS label FROM ev")
def zip_posexplode(t: Tables) -> DataFrame:
    e = t.traces().groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("t_idx", "value"))).alias("x"))
    arrays = e.select("session_id", F.transform("x", lambda s: s["value"]).alias("score"), F.transform("x", lambda s: F.when(s["value"] > 50, "high")).alias("label"))
    return R.zip_rows(arrays, ["session_id"], "t_idx", ["score", "label"])


@query(f"WITH {EV} SELECT session_id, t_idx // 5 AS block, coalesce(max(value) FILTER (channel = 'click'), 0) AS click, coalesce(max(value) FILTER (channel = 'view'), 0) AS look, coalesce(max(value) FILTER (channel = 'error'), 0) AS error FROM ev GROUP BY ALL")
def pivot_channels(t: Tables) -> DataFrame:
    e = t.traces().withColumn("block", F.floor(F.col("t_idx") / 5))
    return R.pivot_map(e, ["session_id", "block"], "channel", "value", {"click": "click", "view": "look", "error": "error"}, 0.0)


@query("SELECT event_id, '{\"channel\":\"' || event_type || '\",\"user\":' || user_id || '}' AS payload FROM events")
def to_json_rows(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.to_json(F.struct(F.col("event_type").alias("channel"), F.col("user_id").alias("user"))).alias("payload"))


@query(f"WITH {FR} SELECT session_id, t_idx, round(list_avg(vec), 6) AS mean, round(list_min(vec), 6) AS low, round(list_max(vec), 6) AS high, round(list_avg(list_transform(vec, lambda x: abs(x))), 6) AS mean_abs FROM fr")
def timestep_summary(t: Tables) -> DataFrame:
    return R.frame_summary(t.frames(), ["session_id", "t_idx"], "vec").select("session_id", "t_idx", *[r6(c, c) for c in ("mean", "low", "high", "mean_abs")])


@query("WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey * 37 % 1500 END AS clicks, s_suppkey * 11 % 300 AS sessions FROM supplier), n AS (SELECT s_suppkey, coalesce(clicks, 0) AS clicks, CASE WHEN sessions > 0 THEN round(least(1, coalesce(clicks, 0) / sessions), 6) END AS rate FROM c) SELECT s_suppkey, clicks, rate, round(100.0 * clicks / max(clicks) OVER (), 6) AS norm FROM n WHERE clicks > 0 OR rate IS NOT NULL")
def clicks_normalize(t: Tables) -> DataFrame:
    from ..sources.clicks import normalize_clicks

    k = F.col("s_suppkey")
    told = F.when(k % 7 == 0, "n/a").otherwise(F.format_number(k * 37 % 1500, 0))
    raw = t.supplier.select("s_suppkey", told.alias("Total Clicks"), (k * 11 % 300).cast("string").alias("SESSIONS"))
    return normalize_clicks(raw, ["s_suppkey"]).select("s_suppkey", "clicks", r6("rate", "rate"), r6("norm", "norm"))


@query("SELECT event_id, epoch_us(ts) // 1000 % 100000 / 1000.0 AS t_sec, CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE greatest(0, least(1, value / 80)) END AS interest FROM events")
def coerce_clip_labels(t: Tables) -> DataFrame:
    from ..sources.labels import label_series

    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) % 100000
    raw = t.events.select("event_id", ms.cast("string").alias("Timestamp (milliseconds)"), F.when(F.col("event_id") % 13 == 0, "bad").otherwise((F.col("value") / 80).cast("string")).alias("interest"))
    return label_series(raw, ["interest"], keep=["event_id"]).select("event_id", "t_sec", "interest")


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'domain' ELSE 'outside' END AS state FROM customer")
def domain_validate(t: Tables) -> DataFrame:
    allowed = t.spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "c_mktsegment string").withColumn("state", F.lit("domain"))
    return t.customer.join(F.broadcast(allowed), "c_mktsegment", "left").select("c_custkey", F.coalesce("state", F.lit("outside")).alias("state"))


@query(f"WITH {EV}, n AS (SELECT session_id, count(*) AS n, 60 + session_id % 12 AS expected FROM ev GROUP BY ALL) SELECT session_id, CASE WHEN n = expected THEN 'exact' WHEN abs(n - expected) <= 5 THEN 'tolerated' WHEN n > expected THEN 'clamped' ELSE 'invalid' END AS status FROM n")
def alignment_check(t: Tables) -> DataFrame:
    n = t.traces().groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).withColumn("expected", 60 + F.col("session_id") % 12)
    return n.select("session_id", R.alignment(F.col("n"), F.col("expected"), 5).alias("status"))


@query(f"WITH {FR} SELECT session_id, t_idx, round(list_sum(vec[17:24]), 6) AS slice_sum FROM fr")
def array_slice(t: Tables) -> DataFrame:
    return t.frames().select("session_id", "t_idx", r6(F.aggregate(F.slice("vec", 17, 8), F.lit(0.0), lambda a, x: a + x), "slice_sum"))


@query("SELECT n_nationkey, sha256(n_nationkey || '|' || n_name || '|' || n_regionkey) AS digest FROM nation")
def row_hash(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).cast("binary"), 256).alias("digest"))


@query("SELECT p_partkey, regexp_extract(p_brand, '#(\\d)', 1) AS maker, regexp_extract(p_brand, '#\\d(\\d)', 1) AS line, regexp_extract(p_name, '(\\d+)$', 1) AS number FROM part")
def regex_fields(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.regexp_extract("p_brand", r"#(\d)", 1).alias("maker"), F.regexp_extract("p_brand", r"#\d(\d)", 1).alias("line"), F.regexp_extract("p_name", r"(\d+)$", 1).alias("number"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user_chars FROM conversations")
def ordered_turns(t: Tables) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.length("text").cast("long")), ignorenulls=True).over(w).alias("last_user_chars"))
