"""Quality rules with host verdicts.

Each text is held against fixed rules; failures are summed by host (the source column), each host's rates are
shrunk towards an empirical beta prior, and the verdict on a host is joined back to its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, materialize, words_of

SYMBOLS = "#*$%&|<>"
RULES = ("short", "repetitive", "symbols", "dup_lines")


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbols_per_word: float = 0.1
    max_dup_line_share: float = 0.3
    #: A host is rejected if the shrunk rate of any rule's failures is above this.
    max_host_rate: float = 0.5
    #: Least and most weight of the prior, in documents.
    prior_weight: tuple[float, float] = (2.0, 1000.0)
    #: Rejected hosts up to this number are broadcast; beyond it they are joined by a shuffle.
    broadcast_hosts: int = 20_000


def _windows(words: Column) -> Column:
    n = F.size(words)
    return F.when(n < 5, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)])))


def _covered(hashes: Column) -> Column:
    """Words in 5-word windows whose hash occurs twice or more."""

    def exact(h: Column) -> Column:
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + 5 - F.greatest(a["end"], p)).alias("n"), (p + 5).alias("end"))
        return F.aggregate(let(at, twins), start, step, lambda a: a["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h))).cast("long")


def _measures(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(lines, F.size).cast("long").alias("n_lines"),
            _covered(_windows(w)).alias("n_repeat_words"),
        )

    return let(words_of(text), of)


def _failures(m: Column, cfg: QualityConfig) -> dict[str, Column]:
    return {
        "short": m["n_words"] < cfg.min_words,
        "repetitive": 100 * m["n_repeat_words"] > cfg.max_repeat_percent * m["n_words"],
        "symbols": m["n_symbols"] > cfg.max_symbols_per_word * m["n_words"],
        "dup_lines": m["n_dup_lines"] > cfg.max_dup_line_share * m["n_lines"],
    }


def measure(docs: DataFrame, cfg: QualityConfig, keep: list[str]) -> DataFrame:
    """keep, and one struct __q of measures and rule failures; nothing is shuffled."""
    with_m = docs.select(*keep, _measures(F.col("text")).alias("__q"))
    return with_m.withColumn("__q", let(F.col("__q"), lambda m: F.struct(m.alias("m"), *[c.alias(k) for k, c in _failures(m, cfg).items()])))


def host_verdicts(measured: DataFrame, cfg: QualityConfig) -> DataFrame:
    """Per host (null hosts have no verdict): n, the shrunk rate of each rule, rejected.

    The prior of a rule is fitted by moments over all hosts: its mean is the overall rate, its weight follows from
    how far hosts vary beyond chance. Only those few numbers reach the driver.
    """
    hosts = measured.where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"__q.{r}").cast("long")).alias(r) for r in RULES])
    hosts = materialize(hosts, "host-sums")
    total = hosts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("k"), *[F.sum(r).alias(r) for r in RULES], *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_sq") for r in RULES]).first()
    rates = []
    for r in RULES:
        n, k = float(total["n"] or 0), int(total["k"] or 0)
        m = (float(total[r] or 0) + 0.5) / (n + 1.0)
        low, high = cfg.prior_weight
        weight = high
        if k > 1 and n > k:
            between = max(float(total[f"{r}_sq"]) - n * m * m, 0.0)
            spread = (between - (k - 1) * m * (1 - m)) / (n - float(total["nn"]) / n) if n * n > float(total["nn"]) else 0.0
            weight = min(high, max(low, m * (1 - m) / spread - 1)) if spread > 0 else high
        rates.append(((F.col(r) + m * weight) / (F.col("n") + weight)).alias(f"{r}_rate"))
    out = hosts.select("source", "n", *rates)
    return out.withColumn("rejected", F.greatest(*[F.col(f"{r}_rate") for r in RULES]) > cfg.max_host_rate)


def _with_verdict(rows: DataFrame, hosts: DataFrame, cfg: QualityConfig) -> DataFrame:
    """rows with __rejected: whether their host is; rejected hosts alone are joined."""
    bad = hosts.where("rejected").select(F.col("source").alias("__host"), F.lit(True).alias("__rejected"))
    few = bad.limit(cfg.broadcast_hosts + 1).count() <= cfg.broadcast_hosts
    return rows.join(F.broadcast(bad) if few else bad, F.col("source") == F.col("__host"), "left").withColumn("__rejected", F.coalesce("__rejected", F.lit(False))).drop("__host")


_FAILED = "(__q.short OR __q.repetitive)"


def score_quality(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """Per row: doc_id, the measures, base_failed, kept.

    Null and empty texts have no words and fail; repeated rows are scored alike; a null source has no host verdict.
    Only doc_id, text and source are read. Measures are computed once and written to the shared folder.
    """
    rows = materialize(measure(docs, cfg, ["doc_id", "source"]), "quality")
    rows = _with_verdict(rows, materialize(host_verdicts(rows, cfg), "hosts"), cfg)
    return rows.select("doc_id", *[f"__q.m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.expr(_FAILED).alias("base_failed"), F.expr(f"NOT {_FAILED} AND NOT __rejected").alias("kept"))


def keep_good(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents that score_quality keeps, all their columns. Two passes over the texts, which are not shuffled."""
    hosts = materialize(host_verdicts(measure(docs, cfg, ["source"]), cfg), "hosts")
    return _with_verdict(docs.where(_passes(cfg)), hosts, cfg).where("NOT __rejected").select(*[F.col(f"`{c}`") for c in docs.columns])


def _passes(cfg: QualityConfig) -> Column:
    """Whether a text passes the base rules: one expression, so that a filter computes the words once."""

    def of(w: Column) -> Column:
        m = {"n_words": F.size(w), "n_repeat_words": _covered(_windows(w))}
        short = m["n_words"] < cfg.min_words
        return ~short & (100 * m["n_repeat_words"] <= cfg.max_repeat_percent * m["n_words"])

    return let(words_of(F.col("text")), of)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
