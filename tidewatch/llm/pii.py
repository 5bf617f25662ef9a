"""Personal data by weak supervision.

Strict patterns give the base spans. Looser patterns give further candidates; four labelers (pattern, gazetteer,
context, shape) vote on all of them, expectation-maximisation estimates how reliable each labeler is, and a logistic
span classifier is trained on its posteriors, with features of the span that no labeler looks at. Candidates that the
classifier accepts join the base spans.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, pieces_of, with_scan

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "shape")
#: What the classifier sees of a span besides votes and kind, 0 or 1 each.
FEATURES = ("apart_left", "apart_right", "line_start", "long", "letters", "separated")

# Base patterns. Possessive groups and look-behinds keep matches as they are and time linear: a match of the e-mail
# pattern begins a run of its characters or follows a match, one of an address begins a run of digits, and one of the card
# pattern is a whole chain of digits, of which only those with 16 to 19 are matched here, as no other can hold.
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, only tried beside the base spans.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[(]at[\])]\x20?{_HOST}++(?:\x20?(?:\.|[\[(]dot[\])])\x20?{_HOST}++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9+.-])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9.-])",
    "phone": r"(?<![0-9+)-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "ip": ".", "card": r"[0-9]", "phone": "+"}

# Gazetteers and cues, fixed values: endings of mail hosts; issuer digits of cards; first octets never routed; words
# that stand before data of a kind; words that speak against it.
HOST_ENDINGS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "ca", "mx", "us")
CARD_ISSUERS = r"^(?:3[47]|4|5[1-5]|2[2-7]|6)"
DEAD_OCTETS = ("0", "127", "224", "239", "255")
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b[^\n]{0,24}$",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|adresse|login)\b[^\n]{0,24}$",
    "card": r"(?i)\b(?:card|visa|credit|karte|tarjeta|carte|account|konto)\b[^\n]{0,24}$",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|llame|appelez)\b[^\n]{0,24}$",
}
COUNTER_CUES = r"(?i)\b(?:version|isbn|issn|order|invoice|build|section|figure|page|id|no|nr)\b[^\n]{0,8}$"

def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    worth = F.transform(back, lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: d - F.when(d > 9, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + d) % 10 == 0


def _octets(value: Column) -> Column:
    """Whether all dot-separated parts are at most 255, however many zeros lead."""
    return F.forall(F.split(value, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda z: (F.length(z) <= 3) & (F.concat(F.lit("0"), F.substring(z, 1, 3)).cast("int") <= 255)))


def _shape(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "email":
        return F.length(value) <= 254
    if kind == "ip":
        return F.when(F.contains(value, F.lit(":")), F.lit(True)).otherwise(_octets(value))
    return n.between(8, 15) if kind == "phone" else n.between(13, 19) & luhn(_digits(value))


#: What a text must hold for a looser pattern to be tried.
_LOOSE_NEEDS = {"email": r"[\[(]at[\])]", "ip": ":", "card": r"[0-9]", "phone": r"[0-9]{4}"}


def _holds(s: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    v = s["value"]
    card = let(_digits(v), lambda d: F.length(d).between(16, 19) & luhn(d))
    return _by_kind(s["kind"], {"email": F.lit(True), "ip": _octets(v), "card": card, "phone": F.length(_digits(v)).between(8, 15)})


def _by_kind(kind: Column, of: dict[str, Column]) -> Column:
    out = of[KINDS[-1]]
    for i in range(len(KINDS) - 2, -1, -1):
        out = F.when(kind == i, of[KINDS[i]]).otherwise(out)
    return out


def _votes(s: Column) -> list[Column]:
    """1 for, -1 against, 0 no opinion, in the order of LABELERS."""
    v = s["value"]
    sign = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(-1))
    gazetteer = {
        "email": sign(F.lower(F.regexp_extract(v, r"([A-Za-z]+)$", 1)).isin(*HOST_ENDINGS)),
        "ip": F.when(F.contains(v, F.lit(":")), F.lit(0)).otherwise(sign(~F.split_part(v, F.lit("."), F.lit(1)).isin(*DEAD_OCTETS))),
        "card": sign(_digits(v).rlike(CARD_ISSUERS)),
        "phone": let(_digits(v), lambda d: sign(F.when(F.length(d) == 10, d.rlike(r"^[2-9][0-9]{2}[2-9]")).otherwise(d.rlike(r"^[1-9]")))),
    }
    context = F.when(s["before"].rlike(COUNTER_CUES), F.lit(-1)).when(_by_kind(s["kind"], {k: s["before"].rlike(c) for k, c in CUES.items()}), F.lit(1)).otherwise(F.lit(0))
    return [s["base"].cast("int"), _by_kind(s["kind"], gazetteer), context, _by_kind(s["kind"], {k: sign(_shape(k, v)) for k in KINDS})]


def _features(s: Column) -> list[Column]:
    """In the order of FEATURES."""
    flag = lambda c: c.cast("int")
    v = s["value"]
    return [flag(~s["before"].rlike(r"[\p{L}\p{N}_]$")), flag(~s["after"].rlike(r"[\p{L}\p{N}_]")), flag(s["before"].rlike(r"(?:^|\n)[\x20\t]*$")), flag(F.length(v) >= 14), flag(v.rlike(r"\p{L}")), flag(v.rlike(r"[\x20()-]"))]


def with_candidates(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with __c: the base spans of a text and the looser ones that overlap none of them, by start.

    Array of kind, start, end (code points), base, votes, features. Patterns' matches and the gaps between them give the
    places; a running sum of their lengths is taken block by block.
    """
    patterns = [(p[k], n[k]) for p, n in ((BASE, _NEEDS), (LOOSE, _LOOSE_NEEDS)) for k in KINDS]
    text, none = F.col("__text"), F.array().cast("array<string>")
    tried = lambda needs: F.contains(text, F.lit(needs)) if len(needs) == 1 else text.rlike(needs)
    found = [F.when(tried(needs), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for p, needs in patterns]
    df = docs.withColumn("__text", F.coalesce(column, F.lit(""))).withColumn("__m", F.array(*found))
    gaps = [F.when(F.size(F.get("__m", F.lit(i))) > 0, F.split(text, p, -1)).otherwise(none) for i, (p, _) in enumerate(patterns)]
    df = df.withColumn("__g", F.array(*gaps))

    def match(x: Column, i: Column, j: Column) -> Column:
        gap = lambda at: F.get(F.get("__g", i), at)
        kind = (i % len(KINDS)).cast("int").alias("kind"), (i < len(KINDS)).alias("base"), (j == 0).alias("first")
        return F.struct(*kind, F.length(gap(j)).alias("gap"), F.length(x).alias("n"), x.alias("value"), F.substring(gap(j), -40, 40).alias("before"), F.substring(gap(j + 1), 1, 1).alias("after"))

    df = df.withColumn("__x", F.flatten(F.transform("__m", lambda m, i: F.transform(m, lambda x, j: match(x, i, j)))))
    since = lambda a, x: F.when(x["first"], F.lit(0)).otherwise(a)
    df = with_scan(df, "__x", "__at", F.lit(0), lambda a, x: since(a, x) + x["gap"] + x["n"])

    def placed(x: Column, a: Column) -> Column:
        start = since(a, x) + x["gap"]
        return F.struct(start.alias("start"), (start + x["n"]).alias("end"), *[x[c].alias(c) for c in ("kind", "base", "value", "before", "after")])

    df = df.withColumn("__s", F.array_sort(F.filter(F.zip_with("__x", "__at", placed), lambda s: ~s["base"] | _holds(s))))
    # A looser span is free where no base span before it reaches into it and none behind it begins in it.
    df = with_scan(df, "__s", "__before", F.lit(0), lambda a, s: F.when(s["base"], F.greatest(a, s["end"])).otherwise(a))
    df = df.withColumn("__r", F.reverse("__s"))
    df = with_scan(df, "__r", "__behind", F.lit(2**31 - 1), lambda a, s: F.when(s["base"], F.least(a, s["start"])).otherwise(a))
    behind = lambda i: F.get("__behind", F.size("__s") - 1 - i)
    df = df.withColumn("__s", F.filter("__s", lambda s, i: s["base"] | ((F.get("__before", i) <= s["start"]) & (behind(i) >= s["end"]))))
    made = F.transform("__s", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "base")], F.array(*_votes(s)).alias("votes"), F.array(*_features(s)).alias("features")))
    return df.withColumn("__c", made).drop("__text", "__m", "__g", "__x", "__at", "__s", "__before", "__behind", "__r")


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities P(vote | class) by labeler, and the classifier: bias, weights by labeler, kind and feature."""

    reliability: dict[str, dict[int, tuple[float, float]]] = field(default_factory=dict)
    bias: float = 0.0
    weights: tuple[float, ...] = (1.0,) * len(LABELERS)
    kinds: tuple[float, ...] = (0.0,) * len(KINDS)
    features: tuple[float, ...] = (0.0,) * len(FEATURES)

    def probability(self, s: Column) -> Column:
        z = F.lit(self.bias) + _by_kind(s["kind"], {k: F.lit(b) for k, b in zip(KINDS, self.kinds, strict=True)})
        for name, weights in (("votes", self.weights), ("features", self.features)):
            for i, w in enumerate(weights):
                z = z + F.get(s[name], F.lit(i)) * F.lit(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


#: P(vote | true), P(vote | false) that count as PRIOR_SPANS observations: labelers are better than chance.
VOTE_PRIOR = {1: (0.6, 0.2), 0: (0.3, 0.4), -1: (0.1, 0.4)}
PRIOR_SPANS = 4
#: Share of the classifier's training weight that goes to made-up spans, one of each kind with each vote.
MADE_UP = 0.1


def _reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM over counted votes: P(vote | class) by labeler, vote + 1 and class (true, false). It estimates the share of true spans, too."""
    prior = np.array([VOTE_PRIOR[v] for v in (-1, 0, 1)])
    rel, share = np.repeat(prior[None], len(LABELERS), axis=0), 0.5
    for _ in range(rounds):
        q = _posterior(rel, votes, share)
        true = (n * q).sum()
        share = (true + 1) / (n.sum() + 2)
        for k in range(len(LABELERS)):
            for v in range(3):
                here = n * (votes[:, k] == v - 1)
                rel[k, v] = ((here * q).sum() + PRIOR_SPANS * prior[v, 0]) / (true + PRIOR_SPANS), ((here * (1 - q)).sum() + PRIOR_SPANS * prior[v, 1]) / (n.sum() - true + PRIOR_SPANS)
    return rel


def _posterior(rel: np.ndarray, votes: np.ndarray, share: float) -> np.ndarray:
    odds = np.full(len(votes), np.log(share / (1 - share)))
    for k in range(len(LABELERS)):
        p = rel[k, votes[:, k] + 1]
        odds += np.log(p[:, 0] / p[:, 1])
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _fit(patterns: Sequence[Row]) -> SpanModel:
    """EM over counted votes, then a logistic classifier on the posteriors. At most 4 * 3^4 * 2^6 patterns.

    The classifier is trained as if classes were equally likely, and a tenth of its weight are made-up spans with every
    vote, all features half: a corpus whose candidates are nearly all true would else teach it to accept anything.
    """
    table = lambda name, width: np.array([p[name] for p in patterns], np.int64).reshape(-1, width)
    kind, votes, features, n = table("kind", 1)[:, 0], table("votes", len(LABELERS)), table("features", len(FEATURES)), table("n", 1)[:, 0].astype(np.float64)
    rel = _reliabilities(votes, n)
    made = np.array(list(product(range(len(KINDS)), *[(1, 0, -1)] * len(LABELERS))), np.int64)
    kind, votes = np.concatenate([kind, made[:, 0]]), np.concatenate([votes, made[:, 1:]])
    features = np.concatenate([features, np.full((len(made), len(FEATURES)), 0.5)])
    share = MADE_UP if n.sum() else 1.0
    weight = np.concatenate([(1 - share) * n / max(n.sum(), 1), np.full(len(made), share / len(made))])
    target = _posterior(rel, votes, 0.5)
    x = np.column_stack([np.ones(len(kind)), votes, np.eye(len(KINDS))[kind], features])
    ridge = np.array([0.0] + [1e-3] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (weight * (p - target)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    parts = np.split(w, np.cumsum([1, len(LABELERS), len(KINDS)]))
    named = {name: {v - 1: tuple(rel[k, v].tolist()) for v in range(3)} for k, name in enumerate(LABELERS)}
    return SpanModel(named, float(w[0]), *(tuple(x.tolist()) for x in parts[1:]))


def _patterns(spans: DataFrame) -> list[Row]:
    """How many spans (a column c) have each kind, votes and features: a bounded table, which reaches the driver."""
    counted = spans.groupBy("c.kind", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n"))
    return sorted(counted.collect(), key=lambda p: (p["kind"], p["votes"], p["features"]))


def fit_spans(docs: DataFrame) -> SpanModel:
    """Candidates are counted by votes and features over all documents."""
    return _fit(_patterns(with_candidates(docs.select("text")).select(F.explode("__c").alias("c"))))


def _accepted(cands: Column, model: SpanModel) -> Column:
    kept = F.filter(cands, lambda s: s["base"] | (model.probability(s) >= 0.5))
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every row, by kind and start.

    Null and empty texts have none; repeated rows are treated alike; an empty table gives no rows; time is linear in a text's
    length, but for n * sqrt(n) steps over its n spans. Only doc_id and text are read; candidates with their votes are written
    to the shared folder when this is called, between fitting and deciding, texts are not shuffled.
    """
    rows = materialize(with_candidates(docs.select("doc_id", "text")).select("doc_id", F.col("__c").alias("c")), "pii")
    model = _fit(_patterns(rows.select(F.explode("c").alias("c"))))
    return rows.select("doc_id", _accepted(F.col("c"), model).alias("spans"))


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with accepted spans replaced by their kind in brackets; overlapping spans are replaced as one, by the first's kind.

    Null and empty texts stay; n_chars, where there is such a column, is that of the new text; an empty table gives no rows.
    The rows, with their candidates, are written to the shared folder when this is called, so that texts are searched once;
    they are not shuffled. Very long texts are cut block by block.
    """
    rows = materialize(with_candidates(docs, column), "candidates")
    model = _fit(_patterns(rows.select(F.explode("__c").alias("c"))))
    text = F.col(column)
    tag = lambda kind: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)), F.lit("]"))
    order = F.array_sort(F.transform(_accepted(F.col("__c"), model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = with_scan(rows.withColumn("__o", order), "__o", "__ends", F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    gaps = F.zip_with("__o", "__ends", lambda s, a: F.struct(a.alias("start"), s["start"].alias("end"), s["kind"].alias("kind")))
    out = out.withColumn("__gaps", F.filter(gaps, lambda g: g["start"] <= g["end"]))
    kept = F.array_join(F.zip_with(pieces_of(text, F.col("__gaps")), "__gaps", lambda p, x: F.concat(p, tag(x["kind"]))), "")
    rest = F.substr(text, F.array_max(F.transform("__o", lambda s: s["end"])) + 1, F.length(text))
    out = out.withColumn(column, F.when(F.size("__o") > 0, F.concat(kept, rest)).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(column).isNull(), F.col("n_chars")).otherwise(F.length(column)).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda i: F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.concat_ws(",", F.transform(base, name)).cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", name)).alias("spans"))
