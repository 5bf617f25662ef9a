"""An exploration policy with state by session: a budget of clicks, and what has been visited."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, CLICK, SCROLL, STOP = "start", "click", "scroll", "stop"


def decide(budget: int, visited: list[str], target: str, first: bool) -> tuple[int, list[str], str]:
    """The next state and the action; a click costs one and happens once a target."""
    if first:
        return budget, visited, START
    if budget == 0:
        return budget, visited, STOP
    if target in visited:
        return budget, visited, SCROLL
    return budget - 1, [*visited, target], CLICK


def replay_policy(df: DataFrame, budget: int, session: str = "session_id", t: str = "t_idx", target: str = "channel") -> DataFrame:
    """The policy over finished sessions: a fold over each session's sorted steps, all in the JVM."""
    g = df.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(target).alias("x")))).alias("s"))
    kind = "array<struct<t:bigint,budget:int,action:string>>"
    start = F.struct(F.lit(budget).alias("budget"), F.array().cast("array<string>").alias("seen"), F.array().cast(kind).alias("out"))

    def step(a: Any, e: Any) -> Any:
        first = F.size(a["out"]) == 0
        known = F.array_contains(a["seen"], e["x"])
        click = ~first & (a["budget"] > 0) & ~known
        left = F.when(click, a["budget"] - 1).otherwise(a["budget"])
        action = F.when(first, START).when(a["budget"] == 0, STOP).when(known, SCROLL).otherwise(CLICK)
        row = F.struct(e["t"].alias("t"), left.alias("budget"), action.alias("action"))
        return F.struct(left.alias("budget"), F.when(click, F.concat(a["seen"], F.array(e["x"]))).otherwise(a["seen"]).alias("seen"), F.concat(a["out"], F.array(row)).alias("out"))

    rows = g.select(session, F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("r"))
    return rows.select(session, F.col("r.t").alias(t), "r.budget", "r.action")


def stream_policy(df: DataFrame, budget: int, session: str = "session_id", t: str = "t_idx", target: str = "channel") -> DataFrame:
    """The same on a stream: the budget and the visited targets are the state of each session."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        left, seen, begun = state.get if state.exists else (budget, [], False)
        seen = list(seen)
        for batch in batches:
            rows = []
            for step, x in batch.sort_values(t)[[t, target]].itertuples(index=False):
                left, seen, action = decide(left, seen, x, not begun)
                begun = True
                rows.append((key[0], step, left, action))
            yield pd.DataFrame(rows, columns=[session, t, "budget", "action"])
        state.update((left, seen, begun))

    schema = f"{session} long, {t} long, budget long, action string"
    return df.select(session, t, target).groupBy(session).applyInPandasWithState(run, schema, "budget long, seen array<string>, begun boolean", "append", "NoTimeout")
