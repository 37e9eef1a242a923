"""Repair of the turn structure of conversations by lazy weighted determinisation.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``.  The
cheapest edits that make it so (keep a row, change its role, delete it, insert an empty
turn) are paths of a small weighted automaton.  Read from the last row to the first, what
matters of all that follows is the cost of finishing from each of its four states: a
vector.  Vectors less their least cost become states of a deterministic automaton, made
when they first occur and kept in a transition table; a scan of that table gives the
costs, for all sequences of a batch in step.  A second scan, from the first row to the
last, follows the arcs that are tight and gives the edits; of tight arcs it takes the one
whose letter comes first.

Conversations are sequences of blocks of ``2 ** BLOCK_BITS`` neighbouring rows of one order
over all rows.  Where a conversation has several, each block is scanned from every state
by itself, and only the blocks' 4 x 4 cost matrices are composed, so that a conversation
with any share of all rows is worked by many tasks.  The digest of a repaired text needs
its rows in order; they stream through one task, never held together.

Defined results: a null role or text is one space; rows of equal turn follow each other by
role, then text; equal rows are neighbours; null conversation ids are one conversation;
rows without a turn come first; roles other than system, user and assistant (by their
first letter) can only be changed or deleted; blank and very long texts count like any
others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.llm.storage import materialize

DELETE, CHANGE, INSERT, CUT = 4, 3, 3, 3
#: Rows of a block, as a power of two.
BLOCK_BITS = 12
#: Characters of role and text by which rows of one turn may go to several tasks.
SPLIT_CHARS = 64

BLANK_TEXT = r"^[\x20\x09-\x0D]*\z"
ENDED_TEXT = r"[.!?][\x20\x09-\x0D]*\z"
#: What follows each initial from the states nothing, system, user, assistant.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The role that a changed or inserted row takes in each state, and the state behind it.
TAKEN = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
CLASSES = "suax"
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
INFINITE = 1 << 40
#: The cost of ending in each state, and what is inserted for it.
AT_END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "ua", "a", "")
#: Steps of a plan: a and u insert, A and U change, K keeps, D deletes.
LETTER = str.maketrans("auAU", "IIRR")
ROLE = {"a": "assistant", "u": "user"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class Automaton:
    """The determinised automaton as far as rows have asked for it."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.plans: list[str] = []
        self.plan_ids: dict[str, int] = {}
        self.next = np.full((0, 16), -1, np.int64)
        self.cost = np.zeros((0, 16), np.int64)
        self.plan = np.full((0, 16, 4), -1, np.int64)
        self.to = np.zeros((0, 16, 4), np.int64)

    def state(self, vector: tuple[int, ...]) -> tuple[int, int]:
        """The state of a vector of costs, and the least cost that was taken off."""
        least = min(vector)
        key = tuple(v - least if v < INFINITE else INFINITE for v in vector)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
            if len(self.vectors) > len(self.next):
                more = max(64, len(self.next))
                self.next = np.concatenate([self.next, np.full((more, 16), -1, np.int64)])
                self.cost = np.concatenate([self.cost, np.zeros((more, 16), np.int64)])
                self.plan = np.concatenate([self.plan, np.full((more, 16, 4), -1, np.int64)])
                self.to = np.concatenate([self.to, np.zeros((more, 16, 4), np.int64)])
        return self.ids[key], least

    def _arcs(self, state: int, symbol: int, q: int) -> list[tuple[str, int, int]]:
        """(step, cost to the end, state behind it) of what may be done with a row in state q; ``state`` is that of the rest."""
        rest, role, fault = self.vectors[state], CLASSES[symbol >> 2], symbol & 3
        out = [("D", DELETE + rest[q], q)]
        if fault not in (BLANK, DUPLICATE):
            extra = CUT if fault == TRUNCATED else 0
            if q in KEPT.get(role, {}):
                out.append(("K", extra + rest[KEPT[role][q]], KEPT[role][q]))
            take, to = TAKEN[q]
            out.append((take.upper(), CHANGE + extra + rest[to], to))
        return out

    def _before(self, state: int, symbol: int) -> list[int]:
        """Costs from each state ahead of a row."""
        costs = [min(c for _, c, _ in self._arcs(state, symbol, q)) for q in range(4)]
        for _ in range(3):
            costs = [min(costs[q], INSERT + costs[TAKEN[q][1]]) for q in range(4)]
        return costs

    def _fill(self, state: int, symbol: int) -> None:
        nxt, least = self.state(tuple(min(c, INFINITE) for c in self._before(state, symbol)))
        self.next[state, symbol], self.cost[state, symbol] = nxt, least

    def _choose(self, state: int, symbol: int, q: int) -> None:
        """The plan of a row: insertions ahead of it, then what is done with it."""
        costs, plan, at = self._before(state, symbol), "", q
        while True:
            arcs = [a for a in self._arcs(state, symbol, at) if a[1] == costs[at]]
            take, to = TAKEN[at]
            if INSERT + costs[to] == costs[at]:
                arcs.append((take, costs[at], to))
            step, _, at = min(arcs, key=lambda a: a[0].translate(LETTER))
            plan += step
            if step not in "au":
                break
        if plan not in self.plan_ids:
            self.plan_ids[plan] = len(self.plans)
            self.plans.append(plan)
        self.plan[state, symbol, q], self.to[state, symbol, q] = self.plan_ids[plan], at

    def scan(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the states behind sequences: the states ahead of them, their costs, and the state behind each row."""
        state, cost, behind = last.astype(np.int64), np.zeros(len(starts), np.int64), np.zeros(len(symbols), np.int64)
        for live, at in _in_step(starts, ends, backward=True):
            s, y = state[live], symbols[at]
            behind[at] = s
            for x in np.unique((s * 16 + y)[self.next[s, y] < 0]).tolist():
                self._fill(x >> 4, x & 15)
            cost[live] += self.cost[s, y]
            state[live] = self.next[s, y]
        return state, cost, behind

    def trace(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, behind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The plan of each row along tight arcs, and where each sequence ends."""
        q, plans = first.astype(np.int64), np.zeros(len(symbols), np.int64)
        for live, at in _in_step(starts, ends):
            s, y, p = behind[at], symbols[at], q[live]
            for x in np.unique((s * 64 + y * 4 + p)[self.plan[s, y, p] < 0]).tolist():
                self._choose(x >> 6, x >> 2 & 15, x & 3)
            plans[at] = self.plan[s, y, p]
            q[live] = self.to[s, y, p]
        return plans, q


def _in_step(starts: np.ndarray, ends: np.ndarray, backward: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each step the sequences that are as long, and their row of it."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    falling = -sizes[order]
    for t in range(int(sizes.max(initial=0))):
        live = order[: np.searchsorted(falling, -t)]
        yield live, (ends[live] - 1 - t if backward else starts[live] + t)


def conversation_key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit("null"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by the CRC of their ``conv_id:turn``: dropped, emptied, without end marks, repeated, of role user."""
    blank = F.lit(" ")
    text = F.coalesce("text", blank)
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    return conversations.filter(kind != 0).select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def lined_up(rows: DataFrame) -> DataFrame:
    """k, at, turn, role, text, times, symbol: equal rows once with their number, in the order of all conversations.

    ``at`` rises with the order; ``symbol`` holds the role's initial and the fault of a
    row's first copy.
    """
    text = F.coalesce("text", F.lit(" "))
    whole = rows.select(conversation_key(F.col("conv_id")).alias("k"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"))
    once = whole.groupBy("k", "turn", "role", "text").agg(F.count("*").alias("times")).withColumn("h", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    first = once.groupBy("k", "h").agg(F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("first"))
    again = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.col("text").rlike(BLANK_TEXT), BLANK).when(again, DUPLICATE).when(~F.col("text").rlike(ENDED_TEXT), TRUNCATED).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    flagged = once.join(first, ["k", "h"]).select("k", "turn", "role", "text", "times", (role * 4 + fault).cast("int").alias("symbol"))
    order = ["k", "turn", "role", "text"]
    near = [F.col("k"), F.col("turn"), F.substring("role", 1, SPLIT_CHARS), F.substring("text", 1, SPLIT_CHARS)]
    return flagged.repartitionByRange(*near).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and numbers of copies of all blocks of a batch, and where each block begins and ends."""
    lists = batch["symbols"]
    ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
    return lists.flatten().to_numpy().astype(np.int64), batch["times"].flatten().to_numpy(), np.r_[0, ends[:-1]].astype(np.int64), ends


def blocks_of(lined: DataFrame) -> DataFrame:
    """k, block, at (of its first row), symbols, times."""
    rows = F.array_sort(F.collect_list(F.struct("at", "symbol", "times")))
    return (
        lined.groupBy("k", F.shiftright("at", BLOCK_BITS).alias("block")).agg(rows.alias("rows"))
        .select("k", "block", F.col("rows")[0]["at"].alias("at"), F.col("rows.symbol").alias("symbols"), F.col("rows.times").alias("times"))
    )


def _illegal(symbols: np.ndarray, times: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Neighbours inside each block whose initials may not follow each other; copies never may."""
    legal = np.array([[(a, b) in LEGAL for b in CLASSES] for a in CLASSES])
    role = symbols >> 2
    wrong = times - 1
    wrong[1:] += ~legal[role[:-1], role[1:]]
    total = np.r_[0, np.cumsum(wrong)]
    lead = np.where(starts > 0, ~legal[role[starts - 1], role[starts]], False) if len(symbols) else np.zeros(0, np.int64)
    return total[ends] - total[starts] - lead


def _texts(plans: np.ndarray, names: list[str], times: np.ndarray, starts: np.ndarray, ends: np.ndarray, tails: list[str]) -> tuple[list[str], list[str]]:
    """For each block its plan, steps of rows between commas, and its audit."""
    steps = [names[p] for p in plans.tolist()]
    letters = [s.translate(LETTER) for s in names]
    marks = [letters[p] for p in plans.tolist()]
    if (times > 1).any():
        marks = [m + "D" * (n - 1) for m, n in zip(marks, times.tolist(), strict=True)]
    spans = list(zip(starts.tolist(), ends.tolist(), tails, strict=True))
    return [",".join([*steps[a:b], t]) for a, b, t in spans], ["".join(marks[a:b]) + t.translate(LETTER) for a, b, t in spans]


def repair_single(blocks: DataFrame) -> DataFrame:
    """k, at, plan, audit, cost, illegal of conversations of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton()
        end = machine.state(AT_END)[0]
        for batch in batches:
            symbols, times, starts, ends = _arrays(batch)
            state, cost, behind = machine.scan(symbols, starts, ends, np.full(len(starts), end))
            plans, q = machine.trace(symbols, starts, ends, behind, np.zeros(len(starts)))
            cost = cost + np.array([v[0] for v in machine.vectors], np.int64)[state] + DELETE * _copies(times, starts, ends)
            plan, audit = _texts(plans, machine.plans, times, starts, ends, [TAIL[i] for i in q.tolist()])
            yield pa.RecordBatch.from_arrays(
                [batch["k"], batch["at"], pa.array(plan), pa.array(audit), pa.array(cost), pa.array(_illegal(symbols, times, starts, ends))],
                ["k", "at", "plan", "audit", "cost", "illegal"],
            )

    return blocks.select("k", "at", "symbols", "times").mapInArrow(run, "k string, at long, plan string, audit string, cost long, illegal long")


def _copies(times: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(times - 1)]
    return total[ends] - total[starts]


def repair_split(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, at, plan) of the blocks of longer conversations, and (k, audit, cost, illegal) of those."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton()
        units = [machine.state(tuple(0 if i == q else INFINITE for i in range(4)))[0] for q in range(4)]
        for batch in batches:
            symbols, times, starts, ends = _arrays(batch)
            extra = DELETE * _copies(times, starts, ends)
            columns = []
            for unit in units:
                state, cost, _ = machine.scan(symbols, starts, ends, np.full(len(starts), unit))
                columns.append(np.minimum(np.array(machine.vectors, np.int64)[state] + (cost + extra)[:, None], INFINITE))
            rows = np.stack(columns, axis=2).reshape(len(starts), 16)
            role = (symbols >> 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["k"], batch["block"], pa.array(role[starts]), pa.array(role[ends - 1]), pa.array(_illegal(symbols, times, starts, ends)), pa.array(rows.tolist())],
                ["k", "block", "first", "last", "illegal", "costs"],
            )

    known = blocks.select("k", "block", "symbols", "times").mapInArrow(matrices, "k string, block long, first int, last int, illegal long, costs array<long>")

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, parts in zip(pdf["k"], pdf["parts"], strict=True):
                behind = np.array(AT_END, np.int64)
                illegal = sum(p["illegal"] for p in parts) + sum((CLASSES[a["last"]], CLASSES[b["first"]]) not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
                for i in range(len(parts) - 1, -1, -1):
                    p = parts[i]
                    ahead = (np.array(p["costs"], np.int64).reshape(4, 4) + behind).min(axis=1)
                    out.append((k, p["block"], behind.tolist(), i == 0, i == len(parts) - 1, int(ahead[0]), illegal))
                    behind = np.minimum(ahead, INFINITE)
            yield pd.DataFrame(out, columns=["k", "block", "behind", "leads", "closes", "cost", "illegal"])

    parts = known.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("block", "first", "last", "illegal", "costs"))).alias("parts"))
    ends = parts.mapInPandas(compose, "k string, block long, behind array<long>, leads boolean, closes boolean, cost long, illegal long")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton()
        for batch in batches:
            symbols, times, starts, ends = _arrays(batch)
            last = np.array([machine.state(tuple(v))[0] for v in batch["behind"].to_pylist()], np.int64)
            _, _, behind = machine.scan(symbols, starts, ends, last)
            closes = batch["closes"].to_pylist()
            by_state = []
            for q in range(4):
                plans, to = machine.trace(symbols, starts, ends, behind, np.full(len(starts), q))
                by_state.append((*_texts(plans, machine.plans, times, starts, ends, [TAIL[i] if c else "" for i, c in zip(to.tolist(), closes, strict=True)]), to.tolist()))
            lists = [pa.array([list(x) for x in zip(*(s[n] for s in by_state), strict=True)]) for n in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in ("k", "block", "at", "leads", "cost", "illegal")), *lists], ["k", "block", "at", "leads", "cost", "illegal", "plans", "audits", "to"])

    joined = blocks.join(ends, ["k", "block"]).select("k", "block", "at", "symbols", "times", "behind", "leads", "closes", "cost", "illegal")
    schema = "k string, block long, at long, leads boolean, cost long, illegal long, plans array<string>, audits array<string>, to array<long>"
    tried = materialize(joined.mapInArrow(traced, schema), "repair-blocks")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, parts in zip(pdf["k"], pdf["parts"], strict=True):
                q = 0
                for p in parts:
                    out.append((k, p["block"], q))
                    q = p["to"][q]
            yield pd.DataFrame(out, columns=["k", "block", "q"])

    order = tried.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("block", "to"))).alias("parts"))
    begun = order.mapInPandas(walk, "k string, block long, q int")
    chosen = tried.join(begun, ["k", "block"]).select("k", "block", "at", "leads", "cost", "illegal", F.col("plans")[F.col("q")].alias("plan"), F.col("audits")[F.col("q")].alias("audit"))
    audits = chosen.groupBy("k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"),
        F.max(F.when(F.col("leads"), F.col("cost"))).alias("cost"), F.max("illegal").alias("illegal"),
    )
    return chosen.select("k", "at", "plan"), audits


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str, str, str]]:
    """(k, role, text, letter) of all edits, from rows that follow the plan of their block; a deletion has the row's text."""
    plan: Iterator[str] = iter(())
    last = ""
    for pdf in batches:
        for k, is_row, role, text, times, steps in zip(pdf["k"], pdf["is_row"], pdf["role"], pdf["text"], pdf["times"], pdf["plan"], strict=True):
            if not is_row:
                yield from _inserted(last, plan)
                plan, last = iter(steps.split(",")), k
                continue
            for step in next(plan):
                if step in "au":
                    yield k, ROLE[step], "", "I"
                else:
                    yield k, ROLE.get(step.lower(), role), text, step.translate(LETTER)
            for _ in range(times - 1):
                yield k, role, text, "D"
    yield from _inserted(last, plan)


def _inserted(k: str, tail: Iterator[str]) -> Iterator[tuple[str, str, str, str]]:
    """What is inserted behind the last row of a block."""
    for steps in tail:
        for step in steps:
            yield k, ROLE[step], "", "I"


def _streamed(lined: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans and rows of each conversation in order, a block's plan ahead of its rows."""
    rows = lined.select("k", "at", F.lit(True).alias("is_row"), "role", "text", "times", F.lit("").alias("plan"))
    heads = plans.select("k", "at", F.lit(False).alias("is_row"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(1).cast("long").alias("times"), "plan")
    return rows.unionByName(heads).repartition("k").sortWithinPartitions("k", "at", "is_row")


def plan_repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows in order, the plans of blocks, and (k, audit, cost, illegal)."""
    lined = materialize(lined_up(rows), "repair-rows")
    blocks = materialize(blocks_of(lined), "repair-blocks")
    number = blocks.groupBy("k").agg(F.count("*").alias("blocks"))
    counted = blocks.join(number, "k")
    single = materialize(repair_single(counted.filter("blocks = 1")), "repair-plans")
    plans, audits = repair_split(counted.filter("blocks > 1"))
    return lined, single.select("k", "at", "plan").unionByName(plans), single.select("k", "audit", "cost", "illegal").unionByName(audits)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id (as text), place, edit, role, text: every row with what was done to it, and what was inserted."""
    lined, plans, _ = plan_repairs(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, last, place = [], None, 0
        for k, role, text, letter in _lines(batches):
            place = place + 1 if k == last else 0
            last = k
            out.append((k, place, letter, role, text))
            if len(out) == 4096:
                yield pd.DataFrame(out, columns=["conv_id", "place", "edit", "role", "text"])
                out = []
        yield pd.DataFrame(out, columns=["conv_id", "place", "edit", "role", "text"])

    return _streamed(lined, plans).mapInPandas(run, "conv_id string, place long, edit string, role string, text string")


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``ids`` (default: of ``rows``): faults, cost, audit and the digest of the repaired text."""
    lined, plans, audits = plan_repairs(rows)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, last, h, begun = [], None, hashlib.sha256(), False
        for k, role, text, letter in _lines(batches):
            if k != last:
                if last is not None:
                    out.append((last, h.hexdigest()))
                last, h, begun = k, hashlib.sha256(), False
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=["k", "repaired_sha256"])
                    out = []
            if letter != "D":
                h.update((f"\n{role}:{text}" if begun else f"{role}:{text}").encode())
                begun = True
        if last is not None:
            out.append((last, h.hexdigest()))
        yield pd.DataFrame(out, columns=["k", "repaired_sha256"])

    digests = _streamed(lined, plans).mapInPandas(digest, "k string, repaired_sha256 string")
    fault, copies = F.col("symbol") % 4, F.col("times") - 1
    turns = lined.groupBy("k", "turn").agg(
        F.sum(F.when(fault == BLANK, F.col("times")).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == DUPLICATE, F.col("times")).when(fault != BLANK, copies).otherwise(0)).alias("duplicate"),
        F.sum(F.when(fault == TRUNCATED, 1).otherwise(0)).alias("truncated"),
    )
    counts = turns.groupBy("k").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(n).cast("long").alias(n) for n in ("blank", "duplicate", "truncated")),
    )
    every = (rows if ids is None else ids).select("conv_id").distinct().withColumn("k", conversation_key(F.col("conv_id")))
    found = every.join(counts, "k", "left").join(audits, "k", "left").join(digests, "k", "left")
    return found.select(
        "conv_id",
        *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
