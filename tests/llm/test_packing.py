from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from tidewatch.llm import packing as M


def check_packing(rows, docs):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d, text in docs:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
    return 1 - total / (2048 * max(len(sequences), 1))


def test_query(spark, small, documents):
    assert check_packing(M.op10_packing(spark, small).collect(), documents.select("doc_id", "text").collect()) < 0.02


def test_program_ends_beside_a_session(spark):
    """128 widths, so that a threaded product would be large enough to hang; the suite's limit ends the test then."""
    assert spark.range(1000).count() == 1000
    rng = np.random.default_rng(5)
    widths, demand = np.arange(1, 129), rng.integers(1, 500, 128)
    patterns, times = M.cutting_stock(widths, demand, 256, 400)
    assert ((patterns * times[:, None]).sum(axis=0) == demand).all()
    assert (patterns * widths).sum(axis=1).max() <= 256
    assert times.sum() <= 1.02 * (widths * demand).sum() / 256 + 1


def test_first_basis_is_inverted():
    rng = np.random.default_rng(6)
    widths = np.unique(rng.integers(1, 256, 60))
    demand = rng.integers(1, 90, len(widths))
    columns, _, made = M._first_columns(widths, demand, 256)
    inverse = M._inverse(columns, made)
    assert np.allclose((columns[:, :, None] * inverse[None]).sum(axis=1), np.eye(len(widths)))


def test_special_token_and_ids(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "plain"), (3, None)], "doc_id long, text string")
    rows = M.pack_documents(docs, with_ids=True).collect()
    check_packing(rows, docs.collect())
    assert all(len(r["input_ids"]) == r["length"] for r in rows)
    assert 50256 in next(r["input_ids"] for r in rows if r["doc_id"] == 1)


def test_words_are_cut_as_the_tokenizer_cuts_them():
    """On every character that the encoder lets through, in many places, and on all documents of a table."""
    encode = M.encoder(M.PackingConfig())
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"a{c}a 1{c}1 .{c}. {c} {c}{c}\n{c}" for c in map(chr, range(0x2100)) if not M.UNUSUAL.search(c)]
    texts += [f"'{x}{y}" for x in ("s", "S", "ll", "re", "x") for y in ("", " ", "a", "1")] + ["", " ", "  a", "a  ", " \n \n", "ſ K", "\x1c\x85\u3000a"]
    assert len(texts) > 500
    for text, ids, want in zip(texts, encode(texts), slow.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text


def test_ids_of_all_documents():
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()]
    encode = M.encoder(M.PackingConfig())
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(0, len(texts), 256):
        for ids, want in zip(encode(texts[i : i + 256]), slow.encode_batch_fast(texts[i : i + 256], add_special_tokens=False), strict=True):
            assert ids.tolist() == want.ids


def test_very_long_texts(spark):
    rows = list(enumerate([" " * 1_000_000, "\n" * 1_000_000, "x" * 1_000_000, "1" * 1_000_000, "ab " * 400_000, "é" * 400_000, "\u4e00" * 300_000, "a\n" * 1_000_000]))
    check_packing(M.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_short_pieces_fill_windows(spark):
    rows = [(i, "") for i in range(5000)] + [(5000 + i, "word " * (i % 60)) for i in range(3000)]
    assert check_packing(M.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows) < 0.02


def test_cutting_stock_meets_demand():
    rng = np.random.default_rng(1)
    for _ in range(15):
        m = int(rng.integers(1, 40))
        widths = np.sort(rng.choice(np.arange(1, 257), m, replace=False))
        demand = rng.integers(1, 500, m)
        patterns, times = M.cutting_stock(widths, demand, 256, 4000)
        assert (patterns.T @ times == demand).all() and (patterns @ widths <= 256).all()
        assert times.sum() <= 1.25 * np.ceil((widths * demand).sum() / 256) or (widths > 128).any()


def test_knapsack_against_enumeration():
    widths, values = np.array([2, 3, 5]), np.array([3.0, 4.5, 8.1])
    best = max(a * 3 + b * 4.5 + c * 8.1 for a in range(9) for b in range(6) for c in range(4) if 2 * a + 3 * b + 5 * c <= 16)
    value, pattern = M._knapsack(widths, values, 16)
    assert abs(value - best) < 1e-9 and abs(pattern @ values - best) < 1e-9 and pattern @ widths <= 16


def test_edges(edges, empty):
    unique = edges.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    check_packing(M.pack_documents(unique).collect(), unique.select("doc_id", "text").collect())
    rows = M.pack_documents(edges).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(r["start"] == 0 for r in rows) == edges.count()
    assert M.pack_documents(empty).count() == 0
