"""Exploration of a site, snapshot by snapshot: scroll, click or stop, within budgets of frames, clicks and pages.

What does not depend on what was done before, which elements can be acted on and what they score by themselves, is computed on
columns. What does is a small state a session: frames seen, clicks, pages and actions visited. It is folded over a finished
session, or kept by Spark over a stream, where a session that falls silent expires; both decide alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import same_origin
from ..operators.series import frame_no
from ..sources.manifest import selector as css_selector

# Terms that ask for an action, parts of links never followed.
CTA_TERMS = ("get started", "start", "try", "demo", "sign up", "subscribe", "pricing", "buy", "contact", "learn more", "free trial")
DENIED = ("logout", "delete", "checkout", "payment", "signout", "sign-out")


#: Sessions that a task holds as Python objects at once: an Arrow batch has thousands.
_SESSIONS = 64


@dataclass(frozen=True)
class ExploreConfig:
    max_frames: int = 24
    max_clicks: int = 12
    max_pages: int = 6
    click_threshold: float = 0.5
    unvisited_threshold: float = 0.35
    unvisited_bonus: float = 0.4
    scroll_before_clicks: bool = True
    scroll_fraction: float = 0.92
    navigate_while_scrolling: bool = True
    deny_links: tuple[str, ...] = ()
    deny_selectors: tuple[str, ...] = ()


#: An element of a snapshot.
ELEMENT = "struct<dom_id:string,tag:string,role:string,text:string,href:string,y:double,h:double,visibility_ratio:double,is_intersecting_viewport:boolean>"
#: What a snapshot's element can be: its selector, the path its link leads to ('' for none), its score by itself and the factor of visibility.
CANDIDATE = "struct<place:int,selector:string,link:boolean,path:string,base:double,factor:double>"


def _path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))


def _joined(base: Column, href: Column) -> Column:
    """The path that a link leads to: an absolute address' own, one from the root, or one beside the base's."""
    clean = F.regexp_replace(href, r"[?#].*$", "")
    beside = F.concat(F.regexp_replace(_path(base), r"[^/]*$", ""), clean)
    scheme = href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | F.startswith(href, F.lit("//"))
    absolute = F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("http:"), href)).otherwise(href)
    return F.when(scheme, _path(absolute)).when(F.startswith(clean, F.lit("/")), clean).when(clean == "", _path(base)).otherwise(beside)


def candidates(elements: Column, initial_url: Column, viewport_h: float = 720.0, cfg: ExploreConfig = ExploreConfig()) -> Column:
    """The elements of a snapshot that can be acted on, as CANDIDATE, in page order.

    elements: an array of structs with dom_id, tag, role, text, href, y, h, visibility_ratio, is_intersecting_viewport. Links off
    the site or denied, elements out of view or without a selector, and what is neither link nor button are left out. Links with a target
    have 0.55 and 0.15 more in a navigation, buttons 0.7; 0.25 more for a term that asks for an action, up to 0.2 for standing high.
    """

    def one(e: Column, place: Column) -> Column:
        text = lambda c: F.coalesce(e[c], F.lit(""))
        dom, role, said = F.lower(text("dom_id")), F.lower(text("role")), F.lower(text("text"))
        tag, href = F.upper(text("tag")), text("href")
        own = css_selector(e["dom_id"], e["tag"], e["href"])
        link = (tag == "A") & (href != "")
        denied = F.lit(False)
        for part in DENIED:
            denied = denied | F.contains(F.lower(href), F.lit(part))
        for pattern in cfg.deny_links:
            denied = denied | F.lower(href).rlike(f"(?i){pattern}")
        inside = ~F.startswith(href, F.lit("#")) & F.coalesce(same_origin(e["href"], initial_url), F.lit(False))
        button = (tag == "BUTTON") | (role == "button") | F.contains(dom, F.lit("cta"))
        barred = F.lit(False)
        for part in cfg.deny_selectors:
            barred = barred | F.contains(F.lower(own), F.lit(part.lower()))
        asks = F.lit(False)
        for term in CTA_TERMS:
            asks = asks | F.contains(said, F.lit(term)) | F.contains(dom, F.lit(term))
        navigation = F.contains(dom, F.lit("nav")) | (role == "navigation")
        high = F.coalesce(F.greatest(F.lit(0.0), 1 - (e["y"] + e["h"] / 2.0) / viewport_h), F.lit(0.5))
        base = F.when(link, 0.55 + F.when(navigation, 0.15).otherwise(0.0)).otherwise(0.7) + F.when(asks, 0.25).otherwise(0.0) + 0.2 * high
        seen = F.coalesce(F.nullif(e["visibility_ratio"].cast("double"), F.lit(0.0)), F.lit(1.0))
        able = F.coalesce(e["is_intersecting_viewport"], F.lit(True)) & (own != "") & ~barred & F.when(link, inside & ~denied).otherwise(button)
        row = F.struct(place.alias("place"), own.alias("selector"), link.alias("link"), F.when((href != "") & ~F.startswith(href, F.lit("#")), _joined(initial_url, href)).otherwise("").alias("path"), base.alias("base"), F.greatest(F.lit(0.2), seen).alias("factor"))
        return F.when(able, row)

    return F.filter(F.transform(F.coalesce(elements, F.array().cast(f"array<{ELEMENT}>")), one), lambda c: c.isNotNull())


def decide(state: dict[str, Any], page_url: str, path: str, scroll: tuple[float, float], options: list[Any], cfg: ExploreConfig) -> tuple[str, str, str]:
    """action, selector and reason of one snapshot; state (frames, clicks, pages, actions) moves on.

    scroll: where the page stands, and how far it goes. A page counts as visited from its first snapshot on.
    """
    frame = state["frames"]
    state["frames"] += 1
    if frame >= cfg.max_frames:
        return "stop", "", "budget_exhausted"
    if path not in state["pages"]:
        state["pages"].append(path)
    pages, full = state["pages"], len(state["pages"]) >= cfg.max_pages
    top, best = None, None
    for o in options:
        new = o["path"] != "" and o["path"] not in pages
        if f"{page_url}|{o['selector']}" in state["actions"] or (o["link"] and full and new):
            continue
        score = (o["base"] + (cfg.unvisited_bonus if o["link"] and new else 0.0)) * o["factor"]
        if best is None or score > best:
            top, best = o, score
    at, most = scroll
    able = top is not None and state["clicks"] < cfg.max_clicks
    if able:
        new = top["path"] != "" and top["path"] not in pages
        bottom = not cfg.scroll_before_clicks or most <= 0 or at >= most or at / most >= cfg.scroll_fraction
        if (bottom or (new and cfg.navigate_while_scrolling)) and best >= (cfg.unvisited_threshold if new else cfg.click_threshold):
            return _click(state, page_url, top, "element_score")
    if at < most:
        return "scroll_down", "", "below_fold_content"
    if able and (top["path"] not in pages or best >= cfg.unvisited_threshold):
        return _click(state, page_url, top, "fallback_click")
    return "stop", "", "page_end_no_actions"


def _click(state: dict[str, Any], page_url: str, top: Any, reason: str) -> tuple[str, str, str]:
    state["clicks"] += 1
    state["actions"].append(f"{page_url}|{top['selector']}")
    return "click", top["selector"], reason


def _fold(cfg: ExploreConfig, session: str, t: str, kinds: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SESSIONS):
                rows = []
                for own in batch.slice(start, _SESSIONS).to_pylist():
                    state = {"frames": 0, "clicks": 0, "pages": [], "actions": []}
                    for s in own["__s"]:
                        rows.append((own[session], s["t"], *decide(state, s["url"], s["path"], (s["at"], s["most"]), s["options"], cfg)))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (*kinds, pa.string(), pa.string(), pa.string()), strict=True)], names=[session, t, "action", "selector", "reason"])

    return run


def replay(df: DataFrame, session: str, t: str, cfg: ExploreConfig = ExploreConfig()) -> DataFrame:
    """session, t, action, selector, reason of finished sessions, in the order of t.

    df: page_url, scroll_y, scroll_height, client_height and options (an array of CANDIDATE) a snapshot. Snapshots beyond the budget of
    frames stop without a look at the state, so max_frames snapshots of a session come together at most, however long it is. Two
    snapshots of a session at one time count in any order.
    """
    rows = df.withColumn("__n", frame_no([session], t))
    late = rows.where(F.col("__n") >= cfg.max_frames).select(session, t, F.lit("stop").alias("action"), F.lit("").alias("selector"), F.lit("budget_exhausted").alias("reason"))
    step = F.struct("__n", F.col(t).alias("t"), F.coalesce("page_url", F.lit("")).alias("url"), _path(F.col("page_url")).alias("path"), _stands(), _room(), F.coalesce("options", F.array().cast(f"array<{CANDIDATE}>")).alias("options"))
    steps = rows.where(F.col("__n") < cfg.max_frames).groupBy(session).agg(F.array_sort(F.collect_list(step)).alias("__s"))
    kinds = tuple(df.schema[c].dataType for c in (session, t))
    schema = f"{session} {kinds[0].simpleString()}, {t} {kinds[1].simpleString()}, action string, selector string, reason string"
    return steps.mapInArrow(_fold(cfg, session, t, tuple(map(to_arrow_type, kinds))), schema).unionByName(late)


def _stands() -> Column:
    return F.coalesce(F.col("scroll_y").cast("double"), F.lit(0.0)).alias("at")


def _room() -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(F.col("scroll_height").cast("double") - F.col("client_height"), F.lit(0.0))).alias("most")


def explore_stream(df: DataFrame, session: str, t: str, cfg: ExploreConfig = ExploreConfig(), idle: str = "30 minutes") -> DataFrame:
    """The same on a stream, each session's state kept by Spark. Within a batch snapshots count in the order of t.

    A session without a snapshot for `idle` (processing time) is told to stop once more, with reason expired and a null t, and
    forgotten; what comes later begins a new one.
    """
    times = df.schema[t].dataType.simpleString()
    most_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        columns = [session, t, "action", "selector", "reason"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], None, "stop", "", "expired")], columns=columns)
            return
        frames, clicks, pages, actions = state.get if state.exists else (0, 0, [], [])
        own = {"frames": frames, "clicks": clicks, "pages": list(pages), "actions": list(actions)}
        for batch in batches:
            rows = []
            for r in batch.sort_values(t, kind="stable").to_dict("records"):
                options = r["options"] if r["options"] is not None else []
                rows.append((key[0], r[t], *decide(own, r["page_url"] or "", r["path"], (float(r["at"]), float(r["most"])), options, cfg)))
            yield pd.DataFrame(rows, columns=columns)
        state.update((own["frames"], own["clicks"], own["pages"], own["actions"]))
        state.setTimeoutDuration(most_ms)

    rows = df.select(session, t, "page_url", _path(F.col("page_url")).alias("path"), _stands(), _room(), "options")
    schema = f"{session} {df.schema[session].dataType.simpleString()}, {t} {times}, action string, selector string, reason string"
    return rows.groupBy(session).applyInPandasWithState(run, schema, "frames int, clicks int, pages array<string>, actions array<string>", "append", "ProcessingTimeTimeout")
