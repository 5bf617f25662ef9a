"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. An n-gram's vector binds (multiplies) its letters' vectors, each permuted by its
place; a document bundles (adds) its n-grams' vectors, and a language the documents that are known to be in it, each at
length one. A document's language is the one whose prototype, less the mean of all, has the largest cosine with it.

Learning and predicting are one pass over the texts each. Tasks work on a few hundred thousand letters at a time; of learning
they hand on one vector a language, in whole numbers, so that any partitioning gives the same prototypes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket


@dataclass(frozen=True)
class LangConfig:
    #: Signs in a vector.
    dims: int = 512
    #: Letters in an n-gram, a word's boundaries counted as letters; at most three.
    n: int = 3
    seed: int = 42
    #: Characters after which the texts gathered are worked on; a longer text is worked on alone, in parts.
    unit_chars: int = 400_000
    #: Different n-grams whose vectors are in memory at once.
    block_grams: int = 4096
    #: Sharpness of the score: cosines are multiplied by it before their shares are taken.
    sharpness: float = 20.0
    #: More languages than this are an error: the prototypes go to every task.
    max_languages: int = 5000


#: The whole number that stands for a length of one when documents are added up.
_ONE = 1 << 20


def letter_vector(point: int, cfg: LangConfig) -> np.ndarray:
    """The signs of a letter, from a hash of its code point; 0x20 is the boundary between words."""
    bits = np.frombuffer(hashlib.shake_256(f"{cfg.seed}:{point}".encode()).digest(-(-cfg.dims // 8)), np.uint8)
    return (1 - 2 * np.unpackbits(bits)[: cfg.dims].astype(np.int8)).astype(np.int8)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Small letters of the texts as code points, with one boundary around each stretch of letters, and whose they are.

    A text without a letter has none.
    """
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    points = np.frombuffer("".join(f"{t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    seen, inverse = _distinct(points)
    small = [c.lower() if (c := chr(int(x))).isalpha() else " " for x in seen]
    points = np.array([ord(c[0]) for c in small], np.int64)[inverse]
    owner = np.repeat(np.arange(len(texts)), lengths)
    space = points == 0x20
    first = np.r_[True, owner[1:] != owner[:-1]]
    keep = ~space | np.r_[False, ~space[:-1]]  # every text ends with a boundary; of a stretch of others, the first
    points, owner = points[keep], owner[keep]
    if len(points):  # and begins with one
        new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        points, owner = np.insert(points, new, 0x20), np.insert(owner, new, owner[new])
    return points, owner


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and of each value its number; by a table while values are small."""
    top = int(codes.max(initial=0)) + 1
    if top > 1 << 22:
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(top, bool)
    seen[codes] = True
    number = np.cumsum(seen) - 1
    return np.flatnonzero(seen), number[codes]


def gram_counts(texts: list[str], cfg: LangConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams as rows of code points, and of each occurrence its text and n-gram's number."""
    points, owner = _letters(texts)
    letters, number = _distinct(points)
    width = max(len(letters), 1)
    n = len(points) - cfg.n + 1
    if n <= 0:
        return np.zeros((0, cfg.n), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = sum(number[k : n + k] * width ** (cfg.n - 1 - k) for k in range(cfg.n))
    inside = owner[:n] == owner[cfg.n - 1 :]
    for k in range(1, cfg.n - 1):  # none reaches over a boundary into the next word
        inside &= points[k : n + k] != 0x20
    codes, owner = codes[inside], owner[:n][inside]
    seen, gram = _distinct(codes)
    parts = np.stack([seen // width ** (cfg.n - 1 - k) % width for k in range(cfg.n)], axis=1)
    return letters[parts] if len(seen) else np.zeros((0, cfg.n), np.int64), owner, gram


class Encoder:
    """Vectors of texts."""

    def __init__(self, cfg: LangConfig) -> None:
        self.cfg = cfg
        self._vectors: dict[int, np.ndarray] = {}

    def grams(self, grams: np.ndarray) -> np.ndarray:
        """Each letter's vector, shifted by its distance to the last, multiplied."""
        points, inverse = np.unique(grams, return_inverse=True)
        if len(self._vectors) > 20_000:
            self._vectors.clear()
        for p in points.tolist():
            if p not in self._vectors:
                self._vectors[p] = letter_vector(p, self.cfg)
        table = np.stack([self._vectors[p] for p in points.tolist()])
        inverse = inverse.reshape(grams.shape)
        out = np.ones((len(grams), self.cfg.dims), np.int8)
        for k in range(self.cfg.n):
            out *= np.roll(table, self.cfg.n - 1 - k, axis=1)[inverse[:, k]]
        return out

    def texts(self, texts: list[str]) -> np.ndarray:
        """One row of whole numbers for each text; zero for a text without a letter."""
        cfg, out = self.cfg, np.zeros((len(texts), self.cfg.dims))
        grams, owner, gram = gram_counts(texts, cfg)
        order = np.argsort(gram // cfg.block_grams, kind="stable") if len(grams) > cfg.block_grams else np.arange(len(gram))
        owner, gram = owner[order], gram[order]
        ends = np.searchsorted(gram // cfg.block_grams, np.arange(-(-len(grams) // cfg.block_grams)), "right")
        begin = 0
        for k, end in enumerate(ends.tolist()):
            block = grams[k * cfg.block_grams : (k + 1) * cfg.block_grams]
            cells = owner[begin:end] * len(block) + gram[begin:end] - k * cfg.block_grams
            counts = np.bincount(cells, minlength=len(texts) * len(block)).reshape(len(texts), len(block))
            # single precision is exact for these whole numbers up to 2^24 occurrences in a text
            kind = np.float32 if end - begin < 1 << 24 else np.float64
            out += counts.astype(kind) @ self.grams(block).astype(kind)
            begin = end
        return out


def _parts(text: str, size: int) -> list[str]:
    """A text in parts of about so many characters, cut where words end; a longer word is cut too."""
    parts, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and cut < at + 2 * size and text[cut].isalpha():
            cut += 1
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


#: Texts of a unit, at most.
_UNIT_TEXTS = 512


def _units(batches: Iterator[pa.RecordBatch], cfg: LangConfig) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in units, with the vectors of their texts. A text of several parts ends its unit."""
    encoder = Encoder(cfg)

    def vectors(texts: list[list[str]]) -> np.ndarray:
        found = encoder.texts([t[0] for t in texts])
        for part in texts[-1][1:]:
            found[-1] += encoder.texts([part])[0]
        return found

    for batch in batches:
        texts, begin, size = [], 0, 0
        for i, value in enumerate(batch["text"]):
            texts.append(_parts((value.as_py() or b"").decode("utf-8", "replace"), cfg.unit_chars))
            size += len(texts[-1][0])
            if size >= cfg.unit_chars or len(texts) == _UNIT_TEXTS or len(texts[-1]) > 1:
                yield batch.slice(begin, len(texts)), vectors(texts)
                texts, begin, size = [], i + 1, 0
        if texts:
            yield batch.slice(begin, len(texts)), vectors(texts)


def _unit_length(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1)


def _learn(cfg: LangConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, vectors in _units(batches, cfg):
            whole = np.rint(_unit_length(vectors) * _ONE).astype(np.int64)
            langs = np.array(rows["lang"].to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + whole[langs == lang].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "vector"])

    return run


def learn_prototypes(docs: DataFrame, cfg: LangConfig = LangConfig()) -> tuple[list[str], np.ndarray]:
    """Languages in order of their names, and their prototypes, of length one, less the mean of all.

    Rows without a language teach nothing. A row a language reaches the driver, max_languages of them at most.
    """
    texts = docs.where(F.col("lang").isNotNull()).select("lang", F.col("text").cast("binary").alias("text"))
    parts = texts.mapInArrow(_learn(cfg), "lang string, vector array<bigint>").select("lang", F.posexplode("vector").alias("dim", "x"))
    sums = parts.groupBy("lang", "dim").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v"))
    rows = sorted(sums.select("lang", "v.x").limit(cfg.max_languages + 1).collect())
    if len(rows) > cfg.max_languages:
        raise ValueError(f"more than {cfg.max_languages} languages")
    if not rows:
        return [], np.zeros((0, cfg.dims))
    vectors = _unit_length(np.array([r["x"] for r in rows], np.float64))
    return [r["lang"] for r in rows], _unit_length(vectors - vectors.mean(axis=0)) if len(rows) > 1 else vectors


def _predict(cfg: LangConfig, langs: list[str], prototypes: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, vectors in _units(batches, cfg):
            known = vectors.any(axis=1) & bool(langs)
            cosine = np.zeros((len(vectors), max(len(langs), 1)))
            for k in range(len(langs)):  # sums of one row at a time, so that they do not depend on the unit
                cosine[:, k] = (_unit_length(vectors) * prototypes[k]).sum(axis=1)
            best = np.argmax(np.round(cosine, 9), axis=1)
            top = cosine[np.arange(len(best)), best]
            share = 1 / np.exp(cfg.sharpness * (cosine - top[:, None])).sum(axis=1)
            names = [langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.clip(share, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["held_out"], pa.array(names, pa.string()), pa.array(score), pa.array(np.where(known, top, 0.0))], names=["doc_id", "held_out", "lang_pred", "score", "cosine"])

    return run


def identify_languages(docs: DataFrame, held_out: Column, cfg: LangConfig = LangConfig()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and cosine of every row of docs; rows held out, and rows without lang, teach nothing.

    score is the share of the predicted language among all, by cosines. lang_pred is und, with score 0, for a null text, a
    text without a letter, and all texts where nothing was learned. Of equal cosines the first language by name is taken;
    equal texts have equal results; an empty table gives no rows; very long texts are taken whole, in parts cut between words.
    Of docs the columns doc_id, text and lang are read, lang only to learn.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    langs, prototypes = learn_prototypes(docs.where(~held_out), cfg)
    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_predict(cfg, langs, prototypes), f"doc_id {kind}, held_out boolean, lang_pred string, score double, cosine double")


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify_languages(docs, bucket(F.col("doc_id"), 4) == 2)
