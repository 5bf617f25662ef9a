from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest

from tidewatch.llm import lines as M


def brute(rows, least=M.LineConfig().run_words):
    """Texts without the longest common runs of lines that have enough words and stood before: from every two equal lines on
    whose lines before differ, both go on while they agree."""
    flat, keys, gone = [], [], set()
    for d, text in sorted(rows):
        for i, line in enumerate(M.cut_lines(text or "")):
            flat.append((d, i, line))
            keys.append(tuple(line.split()))
    same = lambda p, q: q < len(flat) and keys[p] == keys[q]
    goes_on = lambda p, q: same(p, q) and flat[p][0] == flat[p - 1][0] and flat[q][0] == flat[q - 1][0]
    places = {}
    for q, key in enumerate(keys):
        for p in places.get(key, ()):
            if p and flat[p - 1][0] == flat[p][0] and flat[q - 1][0] == flat[q][0] and keys[p - 1] == keys[q - 1]:
                continue
            n = 1
            while goes_on(p + n, q + n):
                n += 1
            if sum(len(keys[q + k]) for k in range(n)) >= least:
                gone.update(flat[q + k][:2] for k in range(n))
        places.setdefault(key, []).append(q)
    return {d: "".join(line for i, line in enumerate(M.cut_lines(text or "")) if (d, i) not in gone) for d, text in rows}


@pytest.mark.parametrize("text", ["", "a", "a. b\nc.\n\nd", "x.y z!? w\n", "  \n . ", "3.14 is ok. Yes!\r\nno", "é. 😀.\n"])
def test_lines_make_up_the_text(text):
    assert "".join(M.cut_lines(text)) == text


def test_query(spark, small, documents):
    want = brute([tuple(r) for r in documents.select("doc_id", "text").collect()])
    rows = M.op8_lines(spark, small).collect()
    assert len(rows) == len(want) and any(r["n_spans"] for r in rows)
    for r in rows:
        assert r["kept_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()


def test_runs_in_all_places(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(60)]
    sentence = lambda n: " ".join(random.choice(vocabulary) for _ in range(n)) + random.choice([". ", "!\n", ".\n", "? "])
    passages = ["".join(sentence(random.randint(1, 30)) for _ in range(random.randint(1, 9))) for _ in range(25)]
    rows = []
    for i in range(250):
        text = "".join(random.choice(passages) if random.random() < 0.35 else sentence(random.randint(1, 25)) for _ in range(random.randint(0, 12)))
        rows.append((i, text + "x y. " * random.choice([0, 0, 0, 150])))
    want = brute(rows)
    got = dict(M.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect())
    assert got == want


def test_edges(edges, empty):
    out = M.dedup_lines(edges)
    assert out.columns[:-2] == edges.columns and out.count() == edges.count()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[2]["text"] is None and by[3]["text"] == "" and by[8]["text"] == "x" * 3000
    assert by[5]["n_chars"] == len(by[5]["text"])
    assert M.dedup_lines(empty).count() == 0


def longest_runs(rows, least=32):
    """Texts without all longest common runs of lines that have enough words and stood before, every two places compared."""
    texts = [(d, M.cut_lines(t)) for d, t in sorted(rows)]
    flat = [(d, i, x) for d, x in texts for i in range(len(x))]
    words = [x[i].split() for _, i, x in flat]
    gone = set()
    for q in range(len(flat)):
        for p in range(q):
            n = total = 0
            while q + n < len(flat) and flat[p + n][0] == flat[p][0] and flat[q + n][0] == flat[q][0] and words[p + n] == words[q + n]:
                total += len(words[q + n])
                n += 1
            if total >= least:
                gone.update((flat[q][0], flat[q][1] + k) for k in range(n))
    return {d: "".join(line for i, line in enumerate(x) if (d, i) not in gone) for d, x in texts}


def test_whole_common_runs_go(spark):
    """Runs go up to their last line, copies to their last word, and shorter ones stay."""
    line = lambda a, n: " ".join(f"{a}{i}" for i in range(n)) + ". "
    passage = line("a", 22) + line("b", 20) + line("c", 10)
    copy = line("d", 40) + line("e", 20) + "\n\n"
    rows = [(1, passage + line("f", 5)), (2, line("g", 4) + passage + line("h", 40)), (3, copy), (4, copy), (5, line("i", 31)), (6, line("i", 31) + line("j", 9))]
    random.seed(8)
    lines = [line(f"w{i}_", n) for i, n in enumerate([1, 3, 9, 10, 15, 18, 20, 31, 32])] + ["\n", " \n"]
    rows += [(i, "".join(random.choices(lines, k=random.randint(0, 9)))) for i in range(10, 70)]
    got = dict(M.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect())
    assert got[2] == line("g", 4) + line("h", 40) and got[4] == "" and got[6] == rows[5][1]
    assert got == longest_runs(rows)
    assert got == brute(rows)


def test_very_long_texts(spark):
    line = "word " * 40 + ". "
    texts = [line * 20_000, "x" * 2_000_000, " " * 2_000_000, "a\n" * 300_000]
    rows = M.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = {r["doc_id"]: r["text"] for r in rows}
    assert by[0] == line and by[1] == texts[1] and by[2] == texts[2] and len(by[3]) < 200


def test_many_texts_are_worked_on_at_once(monkeypatch):
    """Outlines are those of each text by itself, without a pass over arrays for every text."""
    random.seed(3)
    texts = [None, "", "a", "\n\n", "x " * 70] + ["".join(random.choice(["a b c. ", "d! ", "\n", "word " * 20 + ". ", "e f\n"]) for _ in range(random.randint(0, 60))) for _ in range(195)]
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(range(len(x))), pa.array(x, pa.string())], names=["doc_id", "th", "text"])
    outlines = lambda x: [r for b in M._analyse(M.LineConfig())(iter([batch(x)])) for r in b.drop_columns(["doc_id", "th"]).to_pylist()]
    alone = [outlines([t])[0] for t in texts]
    calls, inner = [], M._hash_spans
    monkeypatch.setattr(M, "_hash_spans", lambda *a: calls.append(1) or inner(*a))
    assert outlines(texts) == alone and len(calls) < 10
    monkeypatch.setattr(M, "_BLOCK", 300)
    assert outlines(texts) == alone


def test_equal_rows_count_as_one(spark):
    line = lambda a, n: " ".join(f"{a}{i}" for i in range(n)) + ". "
    rows = [(1, line("a", 40)), (1, line("a", 40)), (2, line("b", 40) + line("c", 3)), (3, line("b", 40)), (3, line("b", 40)), (None, line("d", 40)), (None, line("d", 40)), (4, line("e", 33)), (None, line("e", 33)), (5, line("f", 50) * 2), (5, line("f", 50) * 2), (6, line("g", 40)), (6, line("g", 40) + line("h", 2))]
    got = sorted(map(repr, M.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()))
    kept = [(d, "" if d in (3, 4) else line("f", 50) if d == 5 else t) for d, t in rows]
    assert [x for x in got if "doc_id=6" not in x] == sorted(f"Row(doc_id={d}, text={t!r})" for d, t in kept if d != 6)
    assert sum(line("g", 40) in x for x in got) == 1
