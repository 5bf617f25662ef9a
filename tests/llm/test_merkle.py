from __future__ import annotations

import hashlib

import regex
from pyspark.sql import functions as F

from tidewatch.llm import merkle as M


def test_query(spark, small, documents):
    out = {r["doc_id"]: r for r in M.op9_fingerprints(spark, small).collect()}
    rows = sorted(documents.select("doc_id", "text").collect(), reverse=True)
    roots = {}
    for i, (d, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        assert out[d]["n_chars"] == len(text) and out[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (out[d]["edited_fingerprint"] == out[d]["fingerprint"]) == (edited == text)
        assert roots.setdefault(text, out[d]["fingerprint"]) == out[d]["fingerprint"]
        assert 0 <= out[d]["near_edited"] <= 1 and 0 <= out[d]["near_next"] <= 1
    assert len(set(roots.values())) == len(roots)
    long = [out[d] for d, text in rows if len(text) > 400]
    assert sum(r["near_edited"] > r["near_next"] for r in long) >= 0.99 * len(long)


def test_next_over_buckets(documents):
    rows = sorted(documents.select("doc_id", "text").collect(), reverse=True)
    got = {r["doc_id"]: r["next_text"] for r in M.with_next(documents, rows_per_bucket=30).collect()}
    assert all(got[d] == rows[(i + 1) % len(rows)][1] for i, (d, _) in enumerate(rows))


def test_crowded_id(documents):
    crowd = documents.select(F.when(F.col("doc_id") % 3 == 0, 7).otherwise(F.col("doc_id")).alias("doc_id"), "text")
    out = M.with_next(crowd, rows_per_bucket=30)
    texts = sorted(r["text"] for r in crowd.collect())
    assert sorted(r["next_text"] for r in out.collect()) == texts


def test_edits_are_located(spark):
    """A changed, an inserted and a deleted paragraph, wherever they are."""
    lines = [f"Paragraph number {i} says something." for i in range(120)]
    cases = [([*lines[:17], "Another thing altogether.", *lines[18:]], [17], [17])]
    cases += [([*lines[:k], "A new paragraph.", *lines[k:]], [k], []) for k in (0, 60, 120)]
    cases += [([*lines[:30], *lines[31:]], [], [30]), (lines, [], [])]
    df = spark.createDataFrame([(i, "\n".join(lines), "\n".join(c[0])) for i, c in enumerate(cases)], "i int, a string, b string")
    ta, tb = M.tree(F.col("a")), M.tree(F.col("b"))
    for r in df.select("i", M.edited_paragraphs(ta, tb).alias("added"), M.edited_paragraphs(tb, ta).alias("gone"), M.likeness(ta, tb).alias("l")).collect():
        assert (r["added"], r["gone"]) == cases[r["i"]][1:] and (0.9 < r["l"] < 1 or cases[r["i"]][0] == lines)


def plain_tree(text):
    """Root and leaves, by plain Python."""
    node = lambda tag, x: hashlib.sha256((tag + x).encode()).hexdigest()
    leaves, paragraphs = [], []
    for line in text.split("\n"):
        own = [node("leaf:", m[0]) for m in regex.finditer(M.PIECE, line)]
        leaves += own
        paragraphs.append(node("paragraph:", "".join(own)))
    sections, begin = [], 0
    for i, p in enumerate(paragraphs):
        if p[0] in "01" or i + 1 == len(paragraphs):
            sections.append(node("section:", "".join(paragraphs[begin : i + 1])))
            begin = i + 1
    return node("root:", "".join(sections)), set(leaves)


def test_roots_and_likenesses_against_plain_python(spark, small, documents):
    rows = sorted(documents.select("doc_id", "text").collect(), reverse=True)
    out = {r["doc_id"]: r for r in M.op9_fingerprints(spark, small).collect()}
    like = lambda a, b: 1.0 if a[0] == b[0] else 2 * len(a[1] & b[1]) / max(len(a[1]) + len(b[1]), 1)
    for i, (d, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        a, b, c = plain_tree(text), plain_tree(text[: len(text) - k] + following[:k]), plain_tree(following)
        assert (out[d]["fingerprint"], out[d]["edited_fingerprint"]) == (a[0], b[0])
        assert abs(out[d]["near_edited"] - like(a, b)) < 1e-12 and abs(out[d]["near_next"] - like(a, c)) < 1e-12


def test_finer_buckets_and_string_ids(documents):
    rows = sorted(documents.select("doc_id", "text").collect(), reverse=True)
    got = {r["doc_id"]: r["next_text"] for r in M.with_next(documents, rows_per_bucket=10, max_cuts=7).collect()}
    assert all(got[d] == rows[(i + 1) % len(rows)][1] for i, (d, _) in enumerate(rows))
    named = documents.select(F.concat(F.lit("doc-"), "doc_id").alias("doc_id"), "text")
    rows = sorted(named.collect(), reverse=True)
    got = {r["doc_id"]: r["next_text"] for r in M.with_next(named, rows_per_bucket=30).collect()}
    assert all(got[d] == rows[(i + 1) % len(rows)][1] for i, (d, _) in enumerate(rows))


def test_repeated_rows_are_counted(documents):
    docs = documents.select("doc_id", "text").where("doc_id < 500")
    hot = docs.where("doc_id = 77").crossJoin(docs.sparkSession.range(2500)).select("doc_id", "text")
    out = M.with_next(docs.union(hot), rows_per_bucket=100).collect()
    rows = sorted(docs.union(hot).collect(), reverse=True)
    assert len(out) == len(rows)
    want = sorted((r["doc_id"], r["text"], rows[(i + 1) % len(rows)]["text"]) for i, r in enumerate(rows))
    assert sorted(map(tuple, out)) == want


def test_very_long_texts(spark):
    texts = ["word " * 300_000, "x" * 1_000_000, " " * 1_000_000, "a\n" * 300_000]
    rows = M.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r["fingerprint"] for r in rows}) == 4


def test_edges(edges, empty):
    rows = M.fingerprint_documents(edges).collect()
    assert len(rows) == edges.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] and by[6]["fingerprint"] == by[9]["fingerprint"]
    assert M.fingerprint_documents(empty).count() == 0
    one = M.fingerprint_documents(edges.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0
