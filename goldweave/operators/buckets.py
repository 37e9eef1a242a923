"""Composite token buckets by max-plus algebra: one key is worked by many tasks.

A request starts when it has come, no earlier than the request before it, not inside a
Retry-After of that one, and when every window has a token.  With the time at which a
window would be full again in place of its tokens, the state after a request is made of
maxima of sums of the state before it and of its own time: a max-plus linear map.  Blocks
of neighbouring requests of a key are maps of the same form.  They are found by many
tasks, composed in order, and then each block is run from its own entry state.  Times are
whole microseconds, so any way of composing gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators.sequence import number_groups
from goldweave.storage import materialize

#: Requests of a block.
BLOCK = 1024
NEVER = -(1 << 60)
MICROS = 1_000_000


def _spacings(windows: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the microseconds of one token, and of all tokens but one."""
    one = np.array([round(s * MICROS / c) for c, s in windows], np.int64)
    return one, one * np.array([c - 1 for c, _ in windows], np.int64)


def _run(state: np.ndarray, at: np.ndarray, pause: np.ndarray, windows: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """States (..., 1 + windows) behind one request of each row, and its start; first the earliest next start, then when windows are full."""
    one, slack = _spacings(windows)
    begin = np.maximum(np.maximum(state[..., 0], at), (state[..., 1:] - slack).max(axis=-1))
    full = np.maximum(begin[..., None], state[..., 1:]) + one
    out = np.concatenate([(begin + pause)[..., None], full], axis=-1)
    return np.where(out < NEVER // 2, NEVER, out), begin


def _in_step(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Lists as a table, and how long each is."""
    sizes = lists.map(len).to_numpy()
    out = np.zeros((len(lists), sizes.max(initial=0)), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out, sizes


def throttle(requests: DataFrame, key: str, at: str, order: str, windows: list[tuple[int, float]], retry_after: str | None = None, block: int = BLOCK) -> DataFrame:
    """(key, order, waited): seconds that each request waits for all windows (requests, seconds) of its key, first come first served.

    ``at`` is in seconds; ``retry_after``, where named, holds seconds for which the answer
    to a request blocks the next ones, or null.
    """
    pause = F.lit(0) if retry_after is None else F.greatest(F.coalesce(F.round(F.col(retry_after) * MICROS), F.lit(0)), F.lit(0))
    rows = requests.select(key, order, F.round(F.col(at) * MICROS).cast("long").alias("_at"), pause.cast("long").alias("_pause"))
    placed = number_groups(rows, [key], "_at", order)
    step = F.array_sort(F.collect_list(F.struct("place", "_at", "_pause", order)))
    grouped = placed.groupBy(key, F.floor((F.col("place") - 1) / block).alias("_block")).agg(step.alias("_s"))
    blocks = materialize(grouped.select(key, "_block", F.col("_s._at").alias("_ats"), F.col("_s._pause").alias("_pauses"), F.col(f"_s.{order}").alias("_orders")), "bucket-blocks")
    kinds = dict(requests.dtypes)
    n = 1 + len(windows)

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            (ats, sizes), (pauses, _) = _in_step(pdf["_ats"]), _in_step(pdf["_pauses"])
            # From each unit state, and from none: what the requests' own times give.
            units = np.full((n + 1, n), NEVER, np.int64)
            units[np.arange(n), np.arange(n)] = 0
            state = np.repeat(units[None], len(pdf), axis=0)
            for t in range(ats.shape[1]):
                live = np.flatnonzero(sizes > t)
                own = np.full((len(live), n + 1), NEVER, np.int64)
                own[:, n] = ats[live, t]
                state[live] = _run(state[live], own, pauses[live, t][:, None], windows)[0]
            yield pd.DataFrame({key: pdf[key], "_block": pdf["_block"], "_map": list(state.reshape(len(pdf), -1))})

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, parts in zip(pdf[key], pdf["_parts"], strict=True):
                state = np.full(n, NEVER, np.int64)
                for p in parts:
                    out.append((k, p["_block"], state.tolist()))
                    table = np.array(p["_map"], np.int64).reshape(n + 1, n)
                    state = np.maximum((table[:n] + state[:, None]).max(axis=0), table[n])
                    state = np.where(state < NEVER // 2, NEVER, state)
            yield pd.DataFrame(out, columns=[key, "_block", "_state"])

    def waits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            (ats, sizes), (pauses, _) = _in_step(pdf["_ats"]), _in_step(pdf["_pauses"])
            state, waited = np.array(pdf["_state"].tolist(), np.int64).reshape(len(pdf), n), np.zeros(ats.shape, np.int64)
            for t in range(ats.shape[1]):
                live = np.flatnonzero(sizes > t)
                state[live], begin = _run(state[live], ats[live, t], pauses[live, t], windows)
                waited[live, t] = begin - ats[live, t]
            orders = [o for x in pdf["_orders"] for o in x]
            yield pd.DataFrame({key: pdf[key].repeat(sizes), order: orders, "waited": np.concatenate([waited[i, :s] for i, s in enumerate(sizes)] or [np.zeros(0)]) / MICROS})

    found = blocks.select(key, "_block", "_ats", "_pauses").mapInPandas(maps, f"{key} {kinds[key]}, _block long, _map array<long>")
    chains = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_block", "_map"))).alias("_parts"))
    entries = chains.mapInPandas(compose, f"{key} {kinds[key]}, _block long, _state array<long>").withColumnRenamed(key, "_key").withColumnRenamed("_block", "_at_block")
    ready = blocks.join(entries, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at_block")))
    return ready.select(key, "_ats", "_pauses", "_orders", "_state").mapInPandas(waits, f"{key} {kinds[key]}, {order} {kinds[order]}, waited double")
