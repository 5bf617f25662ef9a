"""DuckDB SQL for the queries of this subpackage."""

#: Measures, rules, beta prior by moments, host verdicts.
OP3_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, list_slice(w, i, i + 4) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM h CROSS JOIN range(5) AS k(k) GROUP BY r),
m AS (
  SELECT w.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    len(l) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN c ON w.r = c.r),
f AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repetitive, n_symbols > 0.1 * n_words AS symbols, n_dup_lines > 0.3 * n_lines AS dup_lines FROM m),
u AS (UNPIVOT (SELECT source, short, repetitive, symbols, dup_lines FROM f WHERE source IS NOT NULL) ON short, repetitive, symbols, dup_lines INTO NAME rule VALUE failed),
hosts AS (SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(failed AS INT)) AS DOUBLE) AS x FROM u GROUP BY ALL),
p AS (SELECT rule, sum(n) AS n, sum(n * n) AS nn, count(*) AS k, (sum(x) + 0.5) / (sum(n) + 1.0) AS m, sum(x * x / n) AS sq FROM hosts GROUP BY rule),
s AS (
  SELECT rule, m, CASE WHEN k > 1 AND n > k AND n * n > nn THEN (greatest(sq - n * m * m, 0) - (k - 1) * m * (1 - m)) / (n - nn / n) ELSE 0 END AS spread FROM p),
prior AS (SELECT rule, m, CASE WHEN spread > 0 THEN least(1000, greatest(2, m * (1 - m) / spread - 1)) ELSE 1000 END AS weight FROM s),
bad AS (SELECT source FROM hosts JOIN prior USING (rule) GROUP BY source HAVING max((x + m * weight) / (n + weight)) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
  NOT (short OR repetitive) AND bad.source IS NULL AS kept
FROM f LEFT JOIN bad ON f.source = bad.source
"""


def _draw(path: str, key: str, weight: int) -> str:
    return f"-ln((CAST('0x' || substr(md5({path} || ':' || {key}), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0) / {weight}.0"


def _pick(children: list[str], key: str, weights: list[int]) -> str:
    """Index of the child with the smallest draw."""
    draws = ", ".join(_draw(c, key, w) for c, w in zip(children, weights, strict=True))
    return f"(list_position([{draws}], least({draws})) - 1)"


def _op7(shards: int) -> str:
    """Region, rack and shard of the tree of 4 regions, 2 racks and 5 shards, and of single shards after 40."""
    extra = shards - 40
    region = _pick([f"'root/{i}'" for i in range(4 + extra)], "k", [10] * 4 + [1] * extra)
    rack = _pick([f"'r' || g || '/{i}'" for i in range(2)], "k", [5, 5])
    shard = _pick([f"'r' || g || '/' || a || '/{i}'" for i in range(5)], "k", [1] * 5)
    return f"SELECT r, CAST(CASE WHEN g < 4 THEN g * 10 + a * 5 + {shard} ELSE 36 + g END AS INT) AS s FROM (SELECT *, {rack} AS a FROM (SELECT *, {region} AS g FROM d))"


#: crc32 by its definition, over a table of 256 made by rule.
OP7_SHARDING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce(text, '') AS t FROM documents),
tab AS (SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(i AS BIGINT)) ORDER BY i) AS tab FROM range(256) AS x(i)),
c AS (
  SELECT r, xor(list_reduce(list_transform(range(1, strlen(t) + 1), lambda i: CAST('0x' || substr(hex(encode(t)), 2 * i - 1, 2) AS BIGINT)),
    lambda c, b: xor(c // 256, tab[1 + xor(c % 256, b)]), 4294967295), 4294967295) AS crc
  FROM d, tab),
a AS ({_op7(40)}),
b AS ({_op7(41)})
SELECT d.doc_id, CAST(strlen(t) + 16 AS BIGINT) AS size, c.crc AS text_crc32, 'key' AS law, a.s AS shard, b.s AS grown_shard,
  row_number() OVER (PARTITION BY a.s ORDER BY CAST('0x' || substr(md5('slot:' || k), 1, 4) AS BIGINT) % 64, d.doc_id NULLS FIRST, strlen(t), c.crc) - 1 AS slot
FROM d JOIN c USING (r) JOIN a USING (r) JOIN b USING (r)
"""

#: All scores of all anchors; rows are told apart by their place in the table.
OP12_NEGATIVES = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT min(r) AS a, vec_id, label, v FROM e WHERE vec_id % 50 = 0 GROUP BY vec_id, label, v),
s AS (
  SELECT a.a, a.vec_id AS anchor_id, e.r, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM a JOIN e ON len(a.v) = len(e.v)),
p AS (
  SELECT a, anchor_id, r AS p, vec_id AS positive_id, score AS positive_score FROM s
  WHERE same AND vec_id IS DISTINCT FROM anchor_id QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.vec_id NULLS LAST)
QUALIFY row_number() OVER w <= 3
"""
