"""Contracts of tables, rules by host, columns by name, exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import contracts as C
from ..operators import hosts as H
from ..operators.series import frame_no
from ..sources.dimensions import site_sections
from ..streaming import explore as X
from .base import Tables, query

_ROW = "CAST('0x' || substr(md5(concat_ws('|', {})), 1, 15) AS BIGINT)"


def _text(*columns: str) -> str:
    """SQL of a row's text for its number."""
    return ", ".join(f"coalesce(replace(replace(CAST({c} AS VARCHAR), chr(92), repeat(chr(92), 2)), '|', chr(92) || '|'), chr(92) || '0')" for c in columns)


_ORDERS = C.Contract(
    types={"o_orderkey": "bigint", "o_orderstatus": "string"},
    required=("o_custkey", "o_clerk"),
    enums={"o_orderstatus": ("F", "O"), "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")},
    ranges={"o_totalprice": (1000.0, 300000.0)},
    finite=("o_totalprice",),
    unique=("o_custkey", "o_orderdate"),
    summed=("o_orderkey", "o_orderstatus", "o_custkey"),
)


@query(f"""
WITH o AS (SELECT *, {_ROW.format(_text('o_orderkey', 'o_orderstatus', 'o_custkey'))} AS h FROM orders),
b AS (SELECT count(*) FILTER (o_custkey IS NULL) AS cust, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS status,
        count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) AS prio,
        count(*) FILTER (NOT o_totalprice BETWEEN 1000 AND 300000) AS price, count(*) FILTER (o_totalprice IS NULL OR NOT isfinite(o_totalprice)) AS fin,
        CAST(sum(h) AS VARCHAR) || ':' || CAST(bit_xor(h) AS VARCHAR) AS mark FROM o),
d AS (SELECT sum(n - 1) AS doubled FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate))
SELECT x.rule, x.expected, x.found, x.ok FROM (SELECT unnest([
  {{'rule': 'required o_custkey', 'expected': '0', 'found': CAST(cust AS VARCHAR), 'ok': cust = 0}},
  {{'rule': 'enum o_orderstatus', 'expected': '0', 'found': CAST(status AS VARCHAR), 'ok': status = 0}},
  {{'rule': 'enum o_orderpriority', 'expected': '0', 'found': CAST(prio AS VARCHAR), 'ok': prio = 0}},
  {{'rule': 'range o_totalprice', 'expected': '0', 'found': CAST(price AS VARCHAR), 'ok': price = 0}},
  {{'rule': 'finite o_totalprice', 'expected': '0', 'found': CAST(fin AS VARCHAR), 'ok': fin = 0}},
  {{'rule': 'type o_orderkey', 'expected': 'bigint', 'found': 'bigint', 'ok': true}},
  {{'rule': 'type o_orderstatus', 'expected': 'string', 'found': 'string', 'ok': true}},
  {{'rule': 'column o_clerk', 'expected': 'there', 'found': 'missing', 'ok': false}},
  {{'rule': 'checksum', 'expected': mark, 'found': mark, 'ok': true}},
  {{'rule': 'unique o_custkey, o_orderdate', 'expected': '0', 'found': CAST(doubled AS VARCHAR), 'ok': doubled = 0}}]) AS x FROM b, d)
""")
def table_contract(t: Tables) -> DataFrame:
    """A contract of the orders, some of whose rules do not hold."""
    return C.check(t.orders, _ORDERS)


@query("""
WITH r AS (SELECT event_id, event_type, CAST('0x' || substr(md5('42:' || event_id), 1, 15) AS BIGINT) AS h FROM events WHERE event_type IS NOT NULL),
n AS (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS total FROM r GROUP BY event_type),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) - 1 AS p FROM r),
k AS (SELECT event_id, p.event_type, h, total FROM p JOIN n USING (event_type) WHERE p < CASE WHEN total <= 777 THEN n.n ELSE least(n.n, greatest(1, CAST(round_even(777 * n.n / total, 0) AS BIGINT))) END)
SELECT event_id, event_type FROM k QUALIFY row_number() OVER (ORDER BY h, event_id) <= 777 OR total <= 777
""")
def stratified_subsample(t: Tables) -> DataFrame:
    return C.stratified_subsample(t.events.select("event_id", "event_type"), "event_type", ["event_id"], 777)


#: Rules that overlap: hosts within hosts, selectors within selectors.
SITES = """
sites:
  example.com:
    sections:
      - id: promotion
        selectors: [".ad", "#promotion"]
      - id: heading
        selectors: ["h1", "title"]
      - id: navigation
        selectors: ["nav", "ul", "li", "a"]
  blog.tiontion.example.com:
    sections:
      - id: post
        selectors: ["article"]
  example.net:
    sections:
      - id: copy
        selectors: ["p"]
      - id: links
        selectors: ["a"]
  ww.ththhe.example.com:
    sections: []
  thther.example.org:
    default_script: x.yaml
    sections:
      - id: main
        selectors: ["article", "#main", ""]
"""
_HOST = "h AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), ''), 'unknown') AS host FROM pages), r AS (SELECT unnest(['example.com', 'blog.tiontion.example.com', 'example.net', 'thther.example.org']) AS rule), m AS (SELECT page_id, host, arg_max(rule, length(rule)) AS rule_host FROM h LEFT JOIN r ON host = rule OR ends_with(host, '.' || rule) GROUP BY ALL)"


@query(f"WITH {_HOST} SELECT page_id, host, rule_host FROM m")
def host_rules(t: Tables) -> DataFrame:
    """The most specific host with rules for each page."""
    pages = t.pages.select("page_id", T.host(F.col("url")).alias("host"))
    return H.match_hosts(pages, "host", site_sections(t.spark, SITES).select("rule_host").distinct(), "rule_host")


@query(f"""
WITH {_HOST},
l AS (SELECT page_id, rule_host, list_transform(regexp_extract_all(html, '<[a-z][a-z0-9]*(?: class="[^"]*")?'), lambda x: replace(replace(replace(x, '<', ''), ' class="', '.'), '"', '')) AS l FROM m JOIN pages USING (page_id) WHERE rule_host IS NOT NULL),
d AS (SELECT page_id, rule_host, i AS place, l[i + 1] AS dom FROM (SELECT *, unnest(range(len(l))) AS i FROM l)),
s AS (SELECT unnest(['example.com', 'example.com', 'example.com', 'example.com', 'example.com', 'example.com', 'example.com', 'example.com', 'blog.tiontion.example.com', 'example.net', 'example.net', 'thther.example.org', 'thther.example.org']) AS h,
  unnest(['promotion', 'promotion', 'heading', 'heading', 'navigation', 'navigation', 'navigation', 'navigation', 'post', 'copy', 'links', 'main', 'main']) AS s, unnest([0, 0, 1, 1, 2, 2, 2, 2, 0, 0, 1, 0, 0]) AS p,
  unnest(['.ad', '#promotion', 'h1', 'title', 'nav', 'ul', 'li', 'a', 'article', 'p', 'a', 'article', '#main']) AS x)
SELECT page_id, CAST(place AS INT) AS place, arg_min(s.s, s.p) AS section FROM d JOIN s ON s.h = rule_host AND (contains(dom, s.x) OR ends_with(dom, replace(s.x, '.', ''))) GROUP BY ALL
""")
def manual_sections(t: Tables) -> DataFrame:
    """The section of each tag of a page that the rules of the page's host name."""
    rules = site_sections(t.spark, SITES)
    pages = H.match_hosts(t.pages.select("page_id", "html", T.host(F.col("url")).alias("host")), "host", rules.select("rule_host").distinct(), "rule_host")
    tags = F.regexp_extract_all("html", F.lit(r'<[a-z][a-z0-9]*(?: class="[^"]*")?'), F.lit(0))
    doms = F.transform(tags, lambda x: F.replace(F.replace(F.replace(x, F.lit("<"), F.lit("")), F.lit(' class="'), F.lit(".")), F.lit('"'), F.lit("")))
    elements = pages.where("rule_host IS NOT NULL").select("page_id", "rule_host", F.posexplode(doms).alias("place", "dom"))
    return H.match_selectors(elements, ["page_id"], "dom", rules, "place")


@query("""
WITH w AS (SELECT DISTINCT p_type AS name FROM part), c AS (SELECT row_number() OVER (ORDER BY n_name) - 1 AS place, n_name AS c FROM nation),
cols AS (SELECT 0 AS place, 'STANDARD' AS c UNION ALL SELECT 1, 'ECONOMY_1' UNION ALL SELECT 2, 'ECONOMY_2' UNION ALL SELECT 3 + place, c FROM c),
n AS (SELECT name, upper(split_part(name, ' ', 1)) AS k FROM w),
f AS (SELECT name, 1 AS tier, place, c FROM n JOIN cols ON c = k
      UNION ALL SELECT name, 2, place, c FROM n JOIN cols ON c <> k AND (starts_with(c, k || '_') OR starts_with(k, c || '_'))
      UNION ALL SELECT name, 3, place, c FROM n JOIN cols ON c = 'NATION_' || lpad(CAST(length(k) AS VARCHAR), 2, '0'))
SELECT name, arg_min(c, tier * 1000 + place) AS "column", CAST(min(tier) AS INT) AS tier FROM w LEFT JOIN f USING (name) GROUP BY name
""")
def rule_columns(t: Tables) -> DataFrame:
    """Names of parts resolved among column names, by themselves, by what they begin with, by number."""
    names = t.part.select("p_type").distinct().select(F.upper(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("name"), "p_type")
    nations = t.nation.select((F.dense_rank().over(W.orderBy("n_name")) + 2).alias("place"), F.col("n_name").alias("column"))
    fixed = t.spark.createDataFrame([(0, "STANDARD"), (1, "ECONOMY_1"), (2, "ECONOMY_2")], "place int, column string")
    ids = names.select("name").distinct().withColumn("column", F.concat(F.lit("NATION_"), F.lpad(F.length("name").cast("string"), 2, "0")))
    return H.resolve_columns(names, fixed.unionByName(nations), ids).select(F.col("p_type").alias("name"), "column", "tier")


#: Snapshots by event: a button, a link of a navigation, a link off the site, a link that may be half hidden.
_SNAPSHOTS = """e AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, event_id, value, event_id * 7919 % 101 AS k FROM events),
s AS (SELECT session_id, n, event_id, 'https://shop.test/p' || (k % 4) AS url, '/p' || (k % 4) AS path, CAST(floor(value * 20) AS DOUBLE) AS ypos, greatest(0, 500 + event_id % 3 * 500 - 720) * 1.0 AS most,
  list_filter([{'o': 0, 'sel': '#cta-' || (k % 3), 'link': false, 'path': '', 'base': 0.7 + 0.25 + 0.2 * greatest(0, 1 - (value * 10 + 20.0) / 720), 'f': 1.0},
   {'o': -1, 'sel': '#nav-' || (k % 5), 'link': true, 'path': '/p' || (k % 6), 'base': 0.55 + 0.15 + 0.2 * greatest(0, 1 - 30.0 / 720), 'f': 0.9},
   {'o': -3, 'sel': '.more', 'link': true, 'path': '/p' || (k % 7) || '.html', 'base': 0.55 + 0.25 + 0.2 * greatest(0, 1 - (800 + 10.0) / 720), 'f': CASE WHEN k % 5 = 0 THEN 1.0 ELSE greatest(0.2, k % 5 / 5.0) END}], lambda x: x.o <> -1 OR k % 11 <> 0) AS c
  FROM e)"""


@query(f"""
WITH RECURSIVE {_SNAPSHOTS},
r AS (
  SELECT session_id, CAST(-1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS event_id, 0 AS clicks, CAST([] AS VARCHAR[]) AS pages, CAST([] AS VARCHAR[]) AS actions, '' AS action, '' AS sel, '' AS reason FROM s WHERE n = 0
  UNION ALL
  SELECT session_id, n, event_id, clicks + CAST(reason IN ('element_score', 'fallback_click') AS INT), pages, CASE WHEN reason IN ('element_score', 'fallback_click') THEN list_append(actions, url || '|' || top.sel) ELSE actions END,
    CASE reason WHEN 'below_fold_content' THEN 'scroll_down' WHEN 'page_end_no_actions' THEN 'stop' ELSE 'click' END, CASE WHEN reason IN ('element_score', 'fallback_click') THEN top.sel ELSE '' END, reason
  FROM (
    SELECT *, CASE WHEN able AND (most <= 0 OR ypos >= most OR ypos / most >= 0.92 OR fresh) AND top.score >= CASE WHEN fresh THEN 0.35 ELSE 0.5 END THEN 'element_score'
      WHEN ypos < most THEN 'below_fold_content' WHEN able AND (NOT list_contains(pages, top.path) OR top.score >= 0.35) THEN 'fallback_click' ELSE 'page_end_no_actions' END AS reason
    FROM (
      SELECT *, top IS NOT NULL AND clicks < 4 AS able, top IS NOT NULL AND top.path <> '' AND NOT list_contains(pages, top.path) AS fresh
      FROM (
        SELECT * EXCLUDE (c), list_max(list_transform(list_filter(c, lambda x: NOT list_contains(actions, url || '|' || x.sel) AND NOT (x.link AND len(pages) >= 5 AND NOT list_contains(pages, x.path))),
          lambda x: {{'score': (x.base + CASE WHEN x.link AND NOT list_contains(pages, x.path) THEN 0.4 ELSE 0 END) * x.f, 'o': x.o, 'sel': x.sel, 'path': x.path}})) AS top
        FROM (
          SELECT s.session_id, s.n, s.event_id, r.clicks, CASE WHEN list_contains(r.pages, s.path) THEN r.pages ELSE list_append(r.pages, s.path) END AS pages, r.actions, s.url, s.ypos, s.most, s.c
          FROM r JOIN s ON s.session_id = r.session_id AND s.n = r.n + 1 WHERE s.n < 10)))))
SELECT session_id, n, event_id, action, sel AS selector, reason FROM r WHERE n >= 0
UNION ALL SELECT session_id, n, event_id, 'stop', '', 'budget_exhausted' FROM s WHERE n >= 10
""")
def explore_sessions(t: Tables) -> DataFrame:
    """What an explorer does at each event of a session, with ten frames, four clicks and five pages."""
    e = t.events.withColumn("n", frame_no(["user_id"], "ts", "event_id")).select(F.col("user_id").alias("session_id"), "n", "event_id", "value", (F.col("event_id") * 7919 % 101).alias("k"))
    name = lambda x, of: F.concat(F.lit(x), (F.col("k") % of).cast("string"))
    seen = F.when(F.col("k") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("k") % 5 / 5.0)
    element = lambda *x: F.struct(*[(c if not isinstance(c, (str, float, bool)) else F.lit(c)).alias(n) for n, c in zip(("dom_id", "tag", "role", "text", "href", "y", "h", "visibility_ratio", "is_intersecting_viewport"), x, strict=True)])
    elements = F.array(
        element(name("#cta-", 3), "BUTTON", "", "Start", "", F.col("value") * 10, 40.0, 1.0, True),
        element(name("nav-", 5), "A", "", "Features", name("/p", 6), 20.0, 20.0, 0.9, F.col("k") % 11 != 0),
        element("#off", "A", "", "Try", "https://other.test/x", 0.0, 10.0, 1.0, True),
        element(".more", "a", "", "Learn more", F.concat(name("p", 7), F.lit(".html?x=1")), 800.0, 20.0, seen, True),
    ).cast(f"array<{X.ELEMENT}>")
    cfg = X.ExploreConfig(max_frames=10, max_clicks=4, max_pages=5)
    rows = e.select("session_id", F.struct("n", "event_id").alias("at"), name("https://shop.test/p", 4).alias("page_url"), F.floor(F.col("value") * 20).alias("scroll_y"), (500 + F.col("event_id") % 3 * 500).alias("scroll_height"), F.lit(720).alias("client_height"), X.candidates(elements, F.lit("https://shop.test/index.html"), cfg=cfg).alias("options"))
    return X.replay(rows, "session_id", "at", cfg).select("session_id", "at.n", "at.event_id", "action", "selector", "reason")
