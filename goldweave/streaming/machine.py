"""The event fold with typed state and timers of its own: what waits, what is done, what is forgotten."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from goldweave.operators.sequence import FINAL, KINDS
from goldweave.streaming.sequence import OUTPUT, STATE, decide

FACTS = {"opted_out": False, "usable_email": True}
ENDS = (*FINAL, "halted")


def _seconds(at: datetime) -> float:
    return (at if at.tzinfo else at.astimezone()).timestamp()


class Sequence(StatefulProcessor):
    """A key is waiting (times of its kinds, facts), done (one flag) or forgotten (nothing)."""

    def __init__(self, accept_s: float, timeout_s: float, keep_s: float):
        self.accept_s, self.timeout_s, self.keep_s = accept_s, timeout_s, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", STATE)
        self.done = handle.getValueState("done", "at double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = max(timerValues.getCurrentWatermarkInMs() / 1000, 0.0)
        first, known = self._held()
        now, last = mark, None
        for row in rows:
            t = _seconds(row["at"])
            now = max(now, t)
            if row["kind"] in first and (first[row["kind"]] is None or t < first[row["kind"]]):
                first[row["kind"]] = t
            if last is None or t > last:
                last, known = t, {k: bool(row[k]) for k in FACTS}
        if self.done.exists():
            self._finish(now)
            return
        yield from self._act(key, first, known, now, mark)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        if self.done.exists():
            if now >= self.done.get()[0] + self.keep_s:
                self.done.clear()
            return
        if self.waiting.exists():
            yield from self._act(key, *self._held(), now, now)

    def _held(self) -> tuple[dict, dict]:
        held = tuple(self.waiting.get()) if self.waiting.exists() else (*[None] * len(KINDS), *FACTS.values())
        return dict(zip(KINDS, held, strict=False)), dict(zip(FACTS, held[len(KINDS) :], strict=True))

    def _act(self, key: tuple, first: dict, known: dict, now: float, mark: float) -> Iterator[Row]:
        action = decide(first, now, self.accept_s, self.timeout_s, **known)
        if action:
            first[action] = now
            yield Row(key=key[0], action=action, at=datetime.fromtimestamp(now, timezone.utc))
        if any(first[k] is not None for k in ENDS):
            self.waiting.clear()
            self._finish(now)
            return
        self.waiting.update((*(first[k] for k in KINDS), *known.values()))
        due = first["accepted"] + self.accept_s if first["accepted"] is not None else first["invite"] + self.timeout_s
        if due > mark:
            self.handle.registerTimer(int(due * 1000) + 1)

    def _finish(self, now: float) -> None:
        """A done key is known for a while, so that stragglers do not begin anew; each row puts that off."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.done.update((now,))
        self.handle.registerTimer(int((now + self.keep_s) * 1000) + 1)

    def close(self) -> None:
        pass


def due_machine(events: DataFrame, accept_days: float = 2, timeout_days: float = 5, lateness: str = "1 day", keep_days: float = 30) -> DataFrame:
    """(key, action, at) as event time passes, by the rules of the batch fold.

    ``events`` is as for ``due_stream``.  A key that has come to its end (answered, fallen
    back, stalled or halted) keeps one number for ``keep_days`` after its last row, then
    nothing; only a row that comes later than that begins anew.  Needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``).
    """
    day = 86400
    named = events.select("key", "kind", F.col("at").cast("timestamp").alias("at"), *(F.coalesce(F.col(k), F.lit(v)).alias(k) if k in events.columns else F.lit(v).alias(k) for k, v in FACTS.items()))
    keys = named.filter("at is not null").withWatermark("at", lateness).groupBy("key")
    return keys.transformWithState(Sequence(accept_days * day, timeout_days * day, keep_days * day), OUTPUT, "Append", "EventTime")
