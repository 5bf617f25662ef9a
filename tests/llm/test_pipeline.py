from __future__ import annotations

import zlib

import corpus_pipeline as C
import numpy as np

from . import test_jaccard, test_lines, test_packing, test_pii, test_quality


def test_stages_against_brute_force(spark, small, documents):
    """Each stage is held against a plain version on what the stage before it kept."""
    kept, outs = documents, []
    for name, stage in C.STAGES:
        kept = stage(spark, kept, small).cache()
        outs.append(kept)
        if name != "packing":
            assert kept.columns == documents.columns
            assert kept.where("n_chars <> length(text)").count() == 0
    quality, lines, near, pii, packed = outs
    text = lambda df: dict(df.select("doc_id", "text").collect())
    before, after = text(documents), text(quality)
    good = set()
    for d, t in before.items():
        n, _, _, _, repeated = test_quality.brute(t)
        if n >= 10 and 100 * repeated <= 20 * n:
            good.add(d)
    assert set(after) == good and all(before[d] == t for d, t in after.items())
    assert text(lines) == test_lines.brute(list(after.items()))
    cut = text(lines)
    assert set(text(near)) == test_jaccard.brute(list(cut.items()))
    clean = text(pii)
    assert set(clean) == set(text(near))
    assert not any(test_pii.brute(t) for t in clean.values())
    pieces = packed.collect()
    assert test_packing.check_packing(pieces, list(clean.items())) < 0.02
    assert all(zlib.crc32(np.array(r["input_ids"], "<u4").tobytes()) == r["ids_crc32"] for r in pieces)


def test_run(spark, tiny):
    assert C.run(spark, tiny).count() > 0 and C.ORACLE_SQL is None


def test_empty_and_odd_tables(spark, edges, empty):
    for docs in (edges, empty):
        for _, stage in C.STAGES:
            docs = stage(spark, docs, "")
        docs.count()
