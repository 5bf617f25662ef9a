from __future__ import annotations

import re
from collections import Counter

from tidewatch.llm import quality as M


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures(spark, small, documents):
    out = {r["doc_id"]: r for r in M.op3_quality(spark, small).collect()}
    for r in documents.select("doc_id", "text").collect():
        got = out[r["doc_id"]]
        want = brute(r["text"])
        assert tuple(got[n] for n in NAMES) == want
        assert got["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got["kept"] and got["base_failed"])


def test_edges(edges, empty):
    rows = M.score_quality(edges).collect()
    assert len(rows) == edges.count()
    texts = {r["doc_id"]: r["text"] for r in edges.collect()}
    assert all(tuple(r[n] for n in NAMES) == brute(texts[r["doc_id"]]) for r in rows)
    assert M.score_quality(empty).count() == 0
    kept = M.keep_good(edges)
    assert kept.columns == edges.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"])
    assert M.keep_good(empty).count() == 0


def test_bad_hosts_take_their_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "short" if i % 10 else f"{good} {i}", "spam") for i in range(200)]
    rows += [(1000 + i, f"{good} {i}" if i % 10 else "short", f"host{i % 5}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = M.score_quality(docs).collect()
    assert not any(r["kept"] for r in out if r["doc_id"] < 1000)
    assert all(r["kept"] != r["base_failed"] for r in out if r["doc_id"] >= 1000)
    hosts = {r["source"]: r for r in M.host_verdicts(M.measure(docs, M.QualityConfig(), ["source"]), M.QualityConfig()).collect()}
    assert hosts["spam"]["rejected"] and 0.1 < hosts["host1"]["short_rate"] + 0.1 < 0.4
