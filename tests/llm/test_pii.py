from __future__ import annotations

import hashlib
import math
import re
import time
from collections import Counter
from itertools import product

import numpy as np
import pytest
import regex

from tidewatch.llm import pii as M


def brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


LINES = [
    "a@b.c_x@y.z", "x..@a-b.co.uk.", "+1 (555) 123-4567 and 555-123-4567 call (212) 555-1234", "4111 1111 1111 1111 5",
    "4111-1111-1111-1111", "1.2.3.4.5.6.7.8", "999.1.1.1", "0000001.002.3.255", "é@a.b ü+49 30 1234567", "",
    "card 3782 822463 10005 x", "mail bob [at] site [dot] com now", "😀 a@b.cc 😀 10.0.0.1", "a@b.c" * 300, "1" * 3000,
    "a" * 5000 + "@x.y", "1-1 " * 2000, "a." * 3000 + "@a" + ".b" * 3000, "+1" * 500, None,
]


@pytest.mark.parametrize("which", ["lines", "documents", "edges"])
def test_base_spans(request, spark, which):
    docs = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string") if which == "lines" else request.getfixturevalue(which)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    found = M.find_pii(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert base == brute(texts[r["doc_id"]])
        assert all(0 <= s["start"] < s["end"] <= len(texts[r["doc_id"]]) for s in r["spans"])


def test_query(spark, small, documents):
    texts = dict(documents.select("doc_id", "text").collect())
    for r in M.op6_pii(spark, small).collect():
        base = brute(texts[r["doc_id"]])
        names = [f"{M.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in M.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]
        assert set(names) <= set(r["spans"].split(",")) | {""}


def test_loose_spans_are_added_where_votes_agree(spark):
    rows = [(i, f"write to user{i}@mail.example.com or call +1 (212) 555-0{i % 1000:03d} today") for i in range(400)]
    rows += [(1000, "please call (212) 555-0100 now"), (1001, "order 123-456-7890x build 111-111-1111"), (1002, "phone: 212-555-0199")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r["doc_id"]: r["spans"] for r in M.find_pii(docs).where("doc_id >= 1000").collect()}
    assert len(by[1000]) == 1 and len(by[1002]) == 1 and not by[1001]


def plain_candidates(text):
    """(kind, start, end, base, votes, features) of base spans and of looser ones that overlap none."""
    text = text or ""
    base = [(k, a, b, True) for k, a, b in brute(text)]
    needs = {"email": r"[\[(]at[\])]", "ip": ":", "card": r"[0-9]", "phone": r"[0-9]{4}"}
    loose = [(i, *m.span(), False) for i, k in enumerate(M.KINDS) if re.search(needs[k], text) for m in regex.finditer(M.LOOSE[k], text)]
    spans = base + [x for x in loose if not any(b[1] < x[2] and x[1] < b[2] for b in base)]
    out = []
    for k, a, b, strict in spans:
        kind, v = M.KINDS[k], text[a:b]
        same = [e for kk, _, e, s in base + loose if kk == k and s == strict and e <= a]
        before = text[max([0, a - 40, *same]) : a]
        if strict and kind in ("ip", "phone", "card"):
            before = text[max([0, a - 40, *[e for e in strict_ends(kind, text) if e <= a]]) : a]
        after = text[b : b + 1]
        digits = re.sub(r"[^0-9]", "", v)
        luhn = sum(d - 9 if d > 9 else d for d in (int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1]))) % 10 == 0
        shape = {"email": len(v) <= 254, "ip": ":" in v or (kind == "ip" and all(int(x) <= 255 for x in v.split("."))), "phone": 8 <= len(digits) <= 15, "card": 13 <= len(digits) <= 19 and luhn}[kind]
        if kind == "email":
            m = re.search(r"([A-Za-z]+)$", v)
            known = (m[1].lower() if m else "") in M.HOST_ENDINGS
        elif kind == "ip":
            known = None if ":" in v else v.split(".")[0] not in M.DEAD_OCTETS
        elif kind == "card":
            known = bool(re.search(M.CARD_ISSUERS, digits))
        else:
            known = bool(re.search(r"^[2-9][0-9]{2}[2-9]", digits) if len(digits) == 10 else re.search(r"^[1-9]", digits))
        context = -1 if re.search(M.COUNTER_CUES, before, re.ASCII) else int(bool(re.search(M.CUES[kind], before, re.ASCII)))
        votes = (int(strict), 0 if known is None else 2 * known - 1, context, 2 * shape - 1)
        word = r"[\p{L}\p{N}_]"
        features = (not regex.search(word + "$", before), not regex.search(word, after), bool(re.search(r"(?:^|\n)[\x20\t]*$", before)), len(v) >= 14, bool(regex.search(r"\p{L}", v)), bool(re.search(r"[\x20()-]", v)))
        out.append((k, a, b, strict, votes, tuple(map(int, features))))
    return out


def strict_ends(kind, text):
    """Ends of all matches of a base pattern, those that fail its check, too."""
    pattern = {"ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "card": M.BASE["card"]}[kind]
    return [m.end() for m in regex.finditer(pattern, text)]


def plain_em(counts):
    """P(vote | class) by labeler from counted votes, and the posterior of votes at even odds."""
    rel = [{v: list(p) for v, p in M.VOTE_PRIOR.items()} for _ in M.LABELERS]

    def posterior(votes, share=0.5):
        odds = math.log(share / (1 - share)) + sum(math.log(rel[k][v][0] / rel[k][v][1]) for k, v in enumerate(votes))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))

    share, total = 0.5, sum(counts.values())
    for _ in range(60):
        q = {votes: posterior(votes, share) for votes in counts}
        true = sum(n * q[v] for v, n in counts.items())
        share = (true + 1) / (total + 2)
        for k in range(len(rel)):
            for v, prior in M.VOTE_PRIOR.items():
                yes = sum(n * q[x] for x, n in counts.items() if x[k] == v)
                no = sum(n * (1 - q[x]) for x, n in counts.items() if x[k] == v)
                rel[k][v] = [(yes + M.PRIOR_SPANS * prior[0]) / (true + M.PRIOR_SPANS), (no + M.PRIOR_SPANS * prior[1]) / (total - true + M.PRIOR_SPANS)]
    return rel, posterior


def test_added_spans_against_plain_python(spark, small, documents):
    """Candidates, EM, the classifier (its gradient is zero) and the spans that it accepts."""
    texts = dict(documents.select("doc_id", "text").collect())
    found = {d: plain_candidates(t) for d, t in texts.items()}
    every = [c for cands in found.values() for c in cands]
    rel, posterior = plain_em(Counter(c[4] for c in every))
    model = M.fit_spans(documents)
    for k, name in enumerate(M.LABELERS):
        for v in (-1, 0, 1):
            assert np.allclose(model.reliability[name][v], rel[k][v], atol=1e-6)
    rows = [(c[0], c[4], c[5], (1 - M.MADE_UP) / len(every)) for c in every]
    rows += [(k, v, (0.5,) * len(M.FEATURES), M.MADE_UP / 324) for k, *v in product(range(4), *[(1, 0, -1)] * 4)]
    x = np.array([[1, *v, *(k == i for i in range(4)), *f] for k, v, f, _ in rows], float)
    w = np.array([model.bias, *model.weights, *model.kinds, *model.features])
    p = 1 / (1 + np.exp(-x @ w))
    target = np.array([posterior(tuple(v)) for _, v, _, _ in rows])
    gradient = x.T @ (np.array([r[3] for r in rows]) * (p - target)) + 1e-3 * w * (np.arange(len(w)) > 0)
    assert np.abs(gradient).max() < 1e-6
    accept = lambda c: c[3] or 1 / (1 + math.exp(-float(np.dot(w, [1, *c[4], *(c[0] == i for i in range(4)), *c[5]])))) >= 0.5
    added = 0
    for r in M.op6_pii(spark, small).collect():
        want = sorted(c[:3] for c in found[r["doc_id"]] if accept(c))
        assert r["spans"] == ",".join(f"{M.KINDS[k]}:{a}:{b}" for k, a, b in want)
        added += sum(not c[3] and accept(c) for c in found[r["doc_id"]])
    assert added or not any(not c[3] for c in every)


LONG = {
    "digits": ("1" * 1_000_000 + ".", 0), "numbers": ("12 x " * 100_000, 0), "addresses": ("10.0.0.1 x " * 20_000, 20_000),
    "mails": ("a@b.cc " * 20_000, 20_000), "word": ("x" * 2_000_000, 0), "space": (" " * 2_000_000, 0), "lines": ("a\n" * 1_000_000, 0),
    "chain": ("1 " * 500_000, 0), "plus": ("+1 " * 300_000, 0), "mail at": ("a(at)" * 200_000, 0),
}


@pytest.mark.parametrize("name", LONG)
def test_very_long_texts(spark, name):
    """Time is linear: each takes seconds."""
    text, n = LONG[name]
    began = time.time()
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sum(s["base"] for s in M.find_pii(docs).first()["spans"]) == n
    out = M.redact(docs).first()["text"]
    assert time.time() - began < 60
    if name == "mails":
        assert out == "[EMAIL] " * 20_000
    if name == "addresses":
        assert out == "[IP] x " * 20_000


def test_redaction(spark, edges, empty):
    out = M.redact(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    by = {r["doc_id"]: r for r in out.collect()}
    was = next(r["text"] for r in edges.collect() if r["doc_id"] == 7)
    assert by[7]["text"] == was.replace("a@b.cc", "[EMAIL]").replace("10.0.0.1", "[IP]") and by[7]["n_chars"] == len(by[7]["text"])
    assert by[2]["text"] is None and by[3]["text"] == ""
    assert M.redact(empty).count() == 0
