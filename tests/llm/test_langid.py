from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import langid as M

CFG = M.LangConfig()


def plain_grams(text, n=3):
    """n-grams of small letters, within each stretch of letters and the boundaries around it."""
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split(" ")
    return Counter(f" {w} "[i : i + n] for w in words if w for i in range(len(w) + 3 - n))


def plain_vector(text, signs, cfg=CFG):
    out = [0] * cfg.dims
    for gram, count in plain_grams(text, cfg.n).items():
        if gram not in signs:
            parts = [[int(x) for x in M.letter_vector(ord(c), cfg)] for c in gram]
            shifted = [p[-s:] + p[:-s] if s else p for p, s in zip(parts, range(cfg.n - 1, -1, -1), strict=True)]
            signs[gram] = [math.prod(x) for x in zip(*shifted, strict=True)]
        out = [a + count * b for a, b in zip(out, signs[gram], strict=True)]
    return out


def unit(v):
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


def plain_predictions(rows, cfg=CFG):
    """rows: doc_id, text, lang. doc_id, held_out, lang_pred, cosine of each."""
    signs, sums = {}, {}
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 4 == 2
    vectors = [plain_vector(t, signs, cfg) for _, t, _ in rows]
    for (d, _, lang), v in zip(rows, vectors, strict=True):
        if lang is not None and not held(d):
            sums[lang] = [a + b for a, b in zip(sums.get(lang, [0] * cfg.dims), unit(v), strict=True)]
    langs = sorted(sums)
    own = [unit(sums[x]) for x in langs]
    mean = [sum(x) / len(own) for x in zip(*own, strict=True)]
    own = [unit([a - b for a, b in zip(v, mean, strict=True)]) for v in own] if len(own) > 1 else own
    for (d, _, _), v in zip(rows, vectors, strict=True):
        cosines = [sum(a * b for a, b in zip(unit(v), p, strict=True)) for p in own]
        known = bool(own) and any(v)
        best = max(range(len(own)), key=lambda k: (round(cosines[k], 9), -k), default=0)
        yield d, held(d), langs[best] if known else "und", cosines[best] if known else 0.0


def test_query(spark, tiny):
    """Every document of the table, against letters in loops."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang")
    got = sorted(M.op13_langid(spark, tiny).collect())
    want = sorted(plain_predictions([tuple(r) for r in docs.collect()]))
    assert [tuple(r)[:3] for r in got] == [w[:3] for w in want]
    assert all(abs(r["cosine"] - w[3]) < 1e-5 and 0 <= r["score"] <= 1 for r, w in zip(got, want, strict=True))


def test_held_out_accuracy(spark, small, documents):
    right = M.op13_langid(spark, small).where("held_out").join(documents.select("doc_id", "lang"), "doc_id")
    n, share = right.agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert n > 100 and share > 0.98


def test_partitioning_changes_nothing(spark, documents):
    held = M.bucket(F.col("doc_id"), 4) == 2
    a = M.identify_languages(documents.repartition(7, "n_chars"), held).collect()
    b = M.identify_languages(documents.coalesce(1), held, M.LangConfig(unit_chars=5000)).collect()
    assert sorted(a) == sorted(b)


def test_edges(spark, edges, empty):
    held = F.col("doc_id") == 1
    got = M.identify_languages(edges, held).collect()
    assert len(got) == edges.count() and M.identify_languages(empty, held).count() == 0
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    assert all(r["lang_pred"] in ("en", "de", "fr") for r in got if r["doc_id"] not in (2, 3, 4))
    assert next(r["held_out"] for r in got if r["doc_id"] == 1) is True
    none = M.identify_languages(edges.withColumn("lang", F.lit(None).cast("string")), held).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    with pytest.raises(ValueError):
        M.learn_prototypes(edges, M.LangConfig(max_languages=2))


def test_very_long_and_strange_texts(spark):
    """Parts of a long text add up to the whole; n-grams beyond a block; letters of many scripts."""
    many = "".join(chr(0x4E00 + i) for i in range(20_000))
    long = "the cat sat on the mat, " * 100_000
    docs = spark.createDataFrame([(1, long, "en"), (2, many, "zh"), (3, long[:24_000], None), (4, "İST 123 \U0001f600", None), (5, many[500:900], None)], "doc_id int, text string, lang string")
    got = {r["doc_id"]: r for r in M.identify_languages(docs, F.lit(False)).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 5)] == ["en", "zh", "en", "zh"]
    assert abs(got[1]["cosine"] - got[3]["cosine"]) < 1e-3
    cfg = M.LangConfig(dims=64, block_grams=512)  # products too small for threads of BLAS in the driver
    encoder = M.Encoder(cfg)
    assert (encoder.texts(["İST 123 \U0001f600"])[0] == plain_vector("İST 123 \U0001f600", {}, cfg)).all()
    assert (encoder.texts([many[:6000]])[0] == plain_vector(many[:6000], {}, cfg)).all()
