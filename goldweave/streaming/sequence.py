"""The event fold as a stream: first time of each kind as state, actions as output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from goldweave.operators.sequence import FINAL, KINDS

OUTPUT = "key long, action string, at timestamp"
STATE = ", ".join(f"{k} double" for k in KINDS) + ", opted_out boolean, usable_email boolean"


def decide(first: dict[str, float | None], now: float, accept_s: float, timeout_s: float, opted_out: bool = False, usable_email: bool = True) -> str | None:
    """The action owed at ``now``, by the rules of the batch fold."""
    if first["halted"] is not None:
        return None
    if opted_out:
        return "halted"
    if any(first[k] is not None for k in FINAL):
        return None
    if first["invite"] is None:
        return "invite"
    if first["accepted"] is not None:
        return "email" if now >= first["accepted"] + accept_s else None
    if now >= first["invite"] + timeout_s:
        return "fallback_email" if usable_email else "stalled"
    return None


def due_stream(events: DataFrame, accept_days: float = 2, timeout_days: float = 5, lateness: str = "1 day") -> DataFrame:
    """(key, action, at) as event time passes.

    ``events`` streams (key, kind, at) and, if it has them, the facts opted_out and
    usable_email of the key (the last row's count). A key's state is six times and two
    facts, whatever its history. A timer in event time fires when an answer or the end of
    waiting falls due. An action that is owed at once is taken as done at the key's time.
    """
    accept_s, timeout_s = accept_days * 86400, timeout_days * 86400
    facts = {"opted_out": False, "usable_email": True}

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [*[None] * len(KINDS), *facts.values()]
        first, known = dict(zip(KINDS, held, strict=False)), dict(zip(facts, held[len(KINDS) :], strict=True))
        now = state.getCurrentWatermarkMs() / 1000
        for pdf in batches:
            if not len(pdf):
                continue
            seconds = pdf["at"].astype("datetime64[us]").astype("int64") / 1e6
            now = max(now, float(seconds.max()))
            for kind, t in seconds.groupby(pdf["kind"]).min().items():
                if kind in first and (first[kind] is None or t < first[kind]):
                    first[kind] = float(t)
            last = pdf.loc[seconds.idxmax()]
            known = {k: bool(last[k]) for k in facts}
        action = decide(first, now, accept_s, timeout_s, **known)
        if action:
            first[action] = now
        state.update((*(first[k] for k in KINDS), *known.values()))
        times = [first["accepted"] + accept_s if first["accepted"] else None, first["invite"] + timeout_s if first["invite"] else None]
        wait = next((t for t in times if t), None)
        if wait and decide(first, wait, accept_s, timeout_s, **known) and wait * 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(wait * 1000) + 1)
        if action:
            yield pd.DataFrame({"key": [key[0]], "action": [action], "at": [pd.Timestamp(now, unit="s")]})

    named = events.select("key", "kind", F.col("at").cast("timestamp").alias("at"), *(F.coalesce(F.col(k), F.lit(v)).alias(k) if k in events.columns else F.lit(v).alias(k) for k, v in facts.items()))
    return named.withWatermark("at", lateness).groupBy("key").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def counts_stream(events: DataFrame, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Events of each kind by tumbling window; late rows up to the watermark still count."""
    return events.withWatermark("at", lateness).groupBy(F.window("at", width), "kind").agg(F.count("*").alias("n"))
