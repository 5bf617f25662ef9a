from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidewatch.llm import sentencepiece as M


@pytest.fixture(scope="module")
def vocab():
    return M.Vocabulary(M.PieceConfig())


def segmentations(vocab, text):
    """All segmentations of a text with their probabilities."""
    s = M.MARK + text.replace(" ", M.MARK)

    def go(i):
        if i == len(s):
            yield (), 0.0
        for j in range(i + 1, len(s) + 1):
            p = s[i:j]
            if p in vocab.id:
                ids, log = (vocab.id[p],), vocab.log[p]
            elif j == i + 1:
                raw = p.encode()
                ids, log = tuple(vocab.bytes[b] for b in raw), vocab.byte_log * len(raw)
            else:
                continue
            for rest, more in go(j):
                yield ids + rest, log + more

    found = dict(go(0))
    total = math.log(sum(map(math.exp, found.values())))
    return {k: math.exp(v - total) for k, v in found.items()}


def test_encoding_and_decoding(spark, small, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = {r["doc_id"]: r for r in M.op5_sentencepiece(spark, small).collect()}
    for d, text in documents.select("doc_id", "text").collect():
        ids = sp.encode(text)
        assert out[d]["n_pieces"] == len(ids) and out[d]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert out[d]["decoded_crc32"] == zlib.crc32(text.encode())
        digests = {(s["n_pieces"], s["ids_crc32"]) for s in out[d]["samples"]}
        assert len(digests) == len(out[d]["samples"]) == 2


@pytest.mark.parametrize("text", ["the", "ab cd", "é😀", "\n"])
def test_samples_follow_the_law_without_replacement(spark, vocab, text):
    n, p = 4000, segmentations(vocab, text)
    docs = spark.range(n).selectExpr("id as doc_id", "'x' as t").drop("t")
    from pyspark.sql import functions as F

    rows = M.encode_documents(docs.withColumn("text", F.lit(text)), M.PieceConfig(samples=3), with_ids=True).collect()
    first, second = Counter(), Counter()
    for r in rows:
        ids = [tuple(x) for x in r["sampled_ids"]]
        assert len(set(ids)) == len(ids) == min(3, len(p))
        assert [s["perturbed"] for s in r["samples"]] == sorted((s["perturbed"] for s in r["samples"]), reverse=True)
        assert all(abs(math.log(p[x]) - s["log_prob"]) < 1e-4 for x, s in zip(ids, r["samples"], strict=True))
        assert all(vocab.decode(list(x)) == text for x in ids)
        first[ids[0]] += 1
        if len(ids) > 1:
            second[ids[1]] += 1
    for x in p:
        assert abs(first[x] / n - p[x]) < 4 * math.sqrt(p[x] * (1 - p[x]) / n) + 1e-3
        if len(p) > 1:
            q = sum(p[y] * p[x] / (1 - p[y]) for y in p if y != x and p[y] < 1)
            assert abs(second[x] / n - q) < 4 * math.sqrt(max(q * (1 - q), 0) / n) + 2e-3
    if len(p) > 3:
        weights = [sum(math.exp(s["log_prob"]) / s["inclusion"] for s in r["samples"]) for r in rows]
        assert abs(np.mean(weights) - 1) < 0.05


def test_long_units_agree_with_short_ones(vocab):
    cfg = M.PieceConfig()
    unit = M.MARK + "lengthy" * 20
    a, b = M.Lattices(vocab, cfg), M.Lattices(vocab, cfg)
    d1, t1, i1, p1 = a._short([unit])
    d2, t2, i2, p2 = b._long(unit)
    own = lambda d, t, i, p: sorted(zip(np.repeat(np.arange(len(d)), d).tolist(), t.tolist(), i.tolist(), np.round(p, 6).tolist(), strict=True))
    assert own(d1, t1, i1, p1) == own(d2, t2, i2, p2)


def test_edges(edges, empty):
    rows = M.encode_documents(edges, with_ids=True)
    assert rows.count() == edges.count()
    texts = {r["doc_id"]: r["text"] for r in edges.collect()}
    for r in M.decode_ids(rows.select("doc_id", "ids", "samples"), "ids", "back").collect():
        assert r["back"] == (texts[r["doc_id"]] or "")
        assert bool(r["samples"]) == bool(texts[r["doc_id"]])
    assert M.encode_documents(empty).count() == 0


def test_words_are_cut_once_a_block(vocab):
    """Units of many texts are those of each text by itself, and each distinct word is cut once."""
    calls = []

    class Counting:
        def findall(self, s):
            calls.append(s)
            return vocab.units.findall(s)

    class Same:
        def __getattr__(self, name):
            return getattr(vocab, name)

    same = Same()
    same.units = Counting()
    odd = ["", "a", " a", "a ", "  a,b  c. ", "   ", "x▁y", "▁▁", "a.\nb", "a)\n b", "\n", ".\n", "é😀 ünï   text\r\nwith, it s", "a\0b c\0"]
    texts = odd + ["and so, it goes on. "] * 50
    lat = M.Lattices(same, M.PieceConfig())
    numbers, sizes = lat.cut(texts)
    names = list(lat.known)
    got, at = [], 0
    for n in sizes.tolist():
        got.append([names[i] for i in numbers[at : at + n].tolist()])
        at += n
    assert at == len(numbers)
    assert got == [vocab.units.findall(M.MARK + t.replace(" ", M.MARK)) if t else [] for t in texts]
    assert len(calls) == len(set(calls))


def test_crc_of_the_decoding_by_parts(vocab):
    for text in ["", " ", "  two", "é😀 and so on\n", "word " * 300]:
        ids = np.array(vocab.processor.encode(text), np.int64)
        assert {vocab.decoded_crc(ids, step) for step in (1, 7, 1 << 18)} == {zlib.crc32(text.encode())}


def test_numbers_of_one_and_many():
    x = [0, 1, 7919, 2**63 - 1, 2**64 - 1]
    assert M.uniform(np.array(x, np.uint64)).tolist() == [M.uniform_of(i) for i in x]
