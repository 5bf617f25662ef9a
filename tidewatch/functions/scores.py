"""Scores, labels and guards on single rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def clip_score(x: Column) -> Column:
    """A whole score from 0 to 100, halves to even."""
    return clip(F.bround(x, 0), 0, 100).cast("int")


def score_from_ratio(raw: Column, center: float, spread: float) -> Column:
    return clip_score(50 + 28 * (raw - center) / max(spread, 1e-6))


def safe_z(x: Column, mean: Column, std: Column, least: float = 1e-7, eps: float = 0.0) -> Column:
    """(x - mean) / (std + eps), 0 where std is below least."""
    return F.when(std < least, F.lit(0.0)).otherwise((x - mean) / (std + eps))


def minmax(x: Column, low: Column, high: Column, scale: float = 1.0, flat: float = 0.0, least: float = 1e-6) -> Column:
    return F.when(high - low < least, F.lit(float(flat))).otherwise((x - low) / (high - low) * scale)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def threshold_label(x: Column, high: float, low: float, above: str, below: str) -> Column:
    """Strict thresholds; null between them."""
    return F.when(x > high, F.lit(above)).when(x < low, F.lit(below))


def magnitude(z: Column, scale: float = 3.0) -> Column:
    """|z| / scale within 0..1; null and NaN are 0."""
    return F.when(z.isNull() | F.isnan(z), F.lit(0.0)).otherwise(clip(F.abs(z) / scale, 0, 1))


def brain_weight(engagement: Column, activation: Column, moment: Column | None = None) -> Column:
    base = 0.72 * magnitude(engagement) + 0.28 * magnitude(activation)
    if moment is None:
        return base
    m = magnitude(moment)
    return clip(F.when(m > 0, 0.65 * base + 0.35 * m).otherwise(base), 0, 1)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: what a lambda refers to from outside is computed anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _finite(xs: Column) -> Column:
    """Doubles; 0 for what is null, NaN or infinite."""
    number = lambda x: F.when(F.abs(x) < float("inf"), x).otherwise(0.0)
    return F.transform(xs, lambda x: number(x.cast("double")))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def probability_rows(xs: Column) -> Column:
    """An array's shares: nulls, NaN, infinite and negative values are 0; where nothing is left, all are alike."""
    clean = F.transform(_finite(xs), lambda x: F.greatest(x, F.lit(0.0)))
    shares = lambda v: once(total(v), lambda s: once(F.size(v), lambda n: F.transform(v, lambda x: F.when(s > 1e-12, x / s).otherwise(1.0 / n))))
    return once(clean, shares)


def softmax(xs: Column) -> Column:
    """Softmax of an array, in time linear in its length; nulls, NaN and infinite values count as 0."""
    powers = lambda v: once(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    return probability_rows(once(_finite(xs), powers))


def softmax_score(x: Column) -> Column:
    """The two classes' probabilities by one decision score."""
    return softmax(F.array(-x, x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def block_means(vec: Column, size: int) -> Column:
    """Means of an array's consecutive blocks: a level of a hierarchy whose members stand side by side."""
    starts = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int"))
    mean = lambda block: total(block) / F.size(block)
    return once(vec, lambda v: F.transform(starts(v), lambda i: mean(F.slice(v, i * size + 1, F.lit(size)))))


def bands(x: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Half-open bands [edge, next); below the first edge and above the last the outer bands go on."""
    out = F.lit(names[-1])
    for edge, name in zip(reversed(edges), reversed(names[:-1]), strict=True):
        out = F.when(x < edge, F.lit(name)).otherwise(out)
    return F.when(x.isNotNull(), out)


def range_midpoint(x: Column) -> Column:
    """'55-60' is 57.5, a number itself, anything else null."""
    low, high = (F.regexp_extract(x, r"^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*$", i) for i in (1, 2))
    return F.when(low != "", (low.try_cast("double") + high.try_cast("double")) / 2).otherwise(x.try_cast("double"))


# Role weights and terms of clickability.
ROLE_WEIGHTS = {"CTA": 1.0, "link": 0.74, "form": 0.70, "nav": 0.50, "image": 0.24, "headline": 0.18, "hero": 0.16, "body": 0.08, "component": 0.18}
CTA_TERMS = ("get started", "start", "try", "sign up", "signup", "book", "demo", "buy", "pricing", "contact", "learn more", "subscribe", "download")


def display_role(dom_id: Column, tag: Column, role: Column, text: Column) -> Column:
    """First rule that holds: call to action, headline, navigation, form, image, hero, body, link, component."""
    dom, low, txt = (F.lower(F.coalesce(c, F.lit(""))) for c in (dom_id, role, text))
    upper = F.upper(F.coalesce(tag, F.lit("")))
    has = lambda s: dom.contains(s)
    rules = [
        ("CTA", (upper == "BUTTON") | (low == "button") | has("cta") | has("btn")),
        ("headline", upper.isin("H1", "H2") | has("hero") | has("headline")),
        ("nav", (upper == "NAV") | (low == "navigation") | dom.startswith("nav")),
        ("form", (upper == "FORM") | (low == "form") | has("form")),
        ("image", (upper == "IMG") | (low == "img") | has("image") | has("img")),
        ("hero", upper.isin("HEADER", "SECTION", "MAIN") & (F.length(txt) > 40)),
        ("body", upper.isin("P", "SPAN", "ARTICLE") & (F.length(txt) > 20)),
        ("link", upper == "A"),
    ]
    out = F.lit("component")
    for name, rule in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def area_score(w: Column, h: Column) -> Column:
    return F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), w * h / 12000.0)), F.lit(0.35))


def fold_score(y: Column, h: Column, viewport_h: float) -> Column:
    return F.coalesce(clip(1 - (y + h / 2.0) / (1.6 * viewport_h), 0, 1), F.lit(0.5))


def clickability(dom_id: Column, tag: Column, role: Column, text: Column, y: Column, w: Column, h: Column, contrast: Column, viewport_h: float = 1080.0) -> Column:
    """0 to 100: how likely an element is meant to be clicked."""
    shown = display_role(dom_id, tag, role, text)
    weight = F.element_at(F.create_map(*[F.lit(v) for kv in ROLE_WEIGHTS.items() for v in kv]), shown)
    acts = F.upper(tag).isin("BUTTON", "A", "INPUT", "TEXTAREA", "SELECT") | F.lower(role).isin("button", "link", "textbox")
    says = F.lit(False)
    for term in CTA_TERMS:
        says = says | F.lower(text).contains(term) | F.lower(dom_id).contains(term)
    weight = F.when(F.coalesce(acts, F.lit(False)), F.greatest(weight, F.lit(0.78))).otherwise(weight)
    weight = F.when(F.coalesce(says, F.lit(False)), F.greatest(weight, F.lit(0.86))).otherwise(weight)
    return F.bround(clip(100 * (0.48 * weight + 0.20 * area_score(w, h) + 0.18 * fold_score(y, h, viewport_h) + 0.14 * contrast), 0, 100), 2)


def position_score(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> Column:
    """How near a box is to the visual centre, and how near to the top."""
    cx, cy = (x1 + x2) / 2 / max(width, 1), (y1 + y2) / 2 / max(height, 1)
    away = F.sqrt(F.pow(cx - 0.5, F.lit(2)) + F.pow(cy - 0.42, F.lit(2)))
    return 0.62 * (1 - F.least(F.lit(1.0), away / 0.72)) + 0.38 * (1 - F.least(F.lit(1.0), cy * 0.72))


#: Texts of an element that ask for an action, fixed values.
ACTION_TEXTS = ("get started", "try", "buy", "sign up", "start", "book", "demo")


def type_score(tag: Column, role: Column, dom_id: Column, text: Column, weights: dict[str, float]) -> Column:
    """The weight of a tag (0.3 for others), raised for buttons and for texts that ask for an action."""
    empty = lambda c: F.lower(F.coalesce(c, F.lit("")))
    base = F.lit(0.3)
    for name, weight in weights.items():
        base = F.when(F.upper(F.coalesce(tag, F.lit(""))) == name, F.lit(weight)).otherwise(base)
    button = (empty(role) == "button") | empty(dom_id).rlike("button|btn|cta")
    asks = empty(text).rlike("|".join(ACTION_TEXTS))
    return F.least(F.lit(1.0), F.greatest(base, F.when(button, 1.0).otherwise(0.0), F.when(asks, 0.92).otherwise(0.0)))


def visibility(ratio: Column) -> Column:
    """How visible an element counts as: its ratio within 0 to 1, whole where it is not known."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(1.0))))


def likert_unit(x: Column, low: float = 1.0, high: float = 9.0) -> Column:
    """A rating between low and high as 0 to 1."""
    return clip((x - low) / (high - low), 0, 1) if high > low else x


def expected_steps(duration: Column, interval: Column) -> Column:
    """Sampling steps that a duration takes, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(duration / interval))


def scroll_fraction(y: Column, scroll_height: Column, client_height: Column) -> Column:
    """How far a page is scrolled; 1 where it cannot be, or where a height is unknown."""
    room = scroll_height - client_height
    return F.when(F.coalesce(room, F.lit(0)) <= 0, F.lit(1.0)).otherwise(y / room)


def items_for_budget(probe_seconds: Column, probe_items: Column, budget: Column, rate_per_hour: Column, done: Column) -> Column:
    """Further items that a budget pays for at the probe's cost an item; none without a probe."""
    each = probe_seconds / probe_items * rate_per_hour / 3600
    able = F.floor(budget / each) - done
    return F.when((probe_items <= 0) | (probe_seconds <= 0) | (each <= 0), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), able))
