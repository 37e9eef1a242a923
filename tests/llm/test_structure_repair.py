"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import duckdb
import pytest

from goldweave.llm import queries, structure_repair

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows, ids):
    """By memoised recursion over (row, initials so far), texts and all."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv in ids:
        seq, seen, faults = sorted(by.get(conv, [])), set(), []
        for _, _, role, text in seq:
            body = text.strip(SPACE)
            faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(maxsize=None)
        def best(i, state, inserted, seq=tuple(seq), faults=tuple(faults)):
            """(cost, audit, lines) of the rest; state: what may be read next is told by the last initial."""
            options = []
            follow = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            if i == len(seq):
                if state in ("", "a"):
                    options.append((0, "", ()))
            else:
                _, _, role, text = seq[i]
                c, a, t = best(i + 1, state, 0)
                options.append((c + 4, "D" + a, t))
                if faults[i] not in ("b", "d"):
                    extra = 3 if faults[i] == "t" else 0
                    if role[:1] and role[:1] in follow:
                        c, a, t = best(i + 1, role[:1], 0)
                        options.append((c + extra, "K" + a, (f"{role}:{text}", *t)))
                    new = {"u": "user", "a": "assistant"}[follow[-1]]
                    c, a, t = best(i + 1, new[0], 0)
                    options.append((c + extra + 3, "R" + a, (f"{new}:{text}", *t)))
            if inserted < 3:
                new = {"u": "user", "a": "assistant"}[follow[-1]]
                c, a, t = best(i, new[0], inserted + 1)
                options.append((c + 3, "I" + a, (f"{new}:", *t)))
            return min(options) if options else (10**9, "", ())

        cost, audit, lines = best(0, "", 0)
        turns = [t for given, t, _, _ in seq if given]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(seq, seq[1:], strict=False)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), audit, lines,
        )
    return out


SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def values(rows):
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in rows}


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(rng.randrange(14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "a", "", " \t", None, "Why?  ", "an end, no mark", "é。", "x.\n", "long " * 3000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, 2, None]), role, text))
    rows += rows[40:60]
    rows.append((1000, 5, "user", "a conversation of one row."))
    return rows


@pytest.fixture(scope="module")
def table(spark, conversations):
    return spark.createDataFrame(conversations, SCHEMA).repartition(3)


@pytest.mark.parametrize("bits", [12, 2, 0])
def test_repairs_are_the_cheapest(spark, conversations, table, bits, monkeypatch):
    monkeypatch.setattr(structure_repair, "BLOCK_BITS", bits)
    ids = {r[0] for r in conversations}
    want = plain_repair(conversations, ids)
    got = structure_repair.repair_conversations(table).collect()
    assert len(got) == len(ids)
    assert values(got) == {k: v[:8] for k, v in want.items()}
    rows = sorted(structure_repair.repaired_rows(table).collect(), key=lambda r: (r["conv_id"], r["place"]))
    for conv in ids:
        mine = [r for r in rows if r["conv_id"] == ("null" if conv is None else str(conv))]
        assert "".join(r["edit"] for r in mine) == want[conv][8]
        assert tuple(f"{r['role']}:{r['text']}" for r in mine if r["edit"] != "D") == want[conv][9]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in mine if r["edit"] != "D"))


def test_damage_and_rows_that_all_go(spark, conversations, table):
    ids = {r[0] for r in conversations}
    got = structure_repair.repair_conversations(structure_repair.damage(table), table).collect()
    assert values(got) == {k: v[:8] for k, v in plain_repair(plain_damage(conversations), ids).items()}
    gone = [c for c in range(5000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = spark.createDataFrame([(c, 0, "user", "a.") for c in gone], SCHEMA)
    got = structure_repair.repair_conversations(structure_repair.damage(rows), rows).collect()
    assert values(got) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in gone}


def test_one_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(structure_repair, "BLOCK_BITS", 5)
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", ""])) for t in range(700)] + [(8, 0, "user", "x.")] + [(9, 3, "user", "same")] * 200
    got = structure_repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert values(got) == {k: v[:8] for k, v in plain_repair(rows, {7, 8, 9}).items()}


def test_extra_columns_and_empty_tables(spark, table):
    from pyspark.sql import functions as F

    more = table.withColumns({"k": F.lit(1), "AT": F.lit("x"), "Times": F.lit(0), "h": F.lit(2), "symbol": F.lit(3)})
    assert values(structure_repair.repair_conversations(more).collect()) == values(structure_repair.repair_conversations(table).collect())
    assert structure_repair.repair_conversations(table.limit(0)).collect() == []
    assert structure_repair.repaired_rows(table.limit(0)).collect() == []


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    cursor = db.execute(queries.ORACLE_SQL["op11_structure_repair"])
    names = [c[0] for c in cursor.description]
    want = {(r := dict(zip(names, x, strict=True)))["conv_id"]: tuple(r[n] for n in NAMES) for x in cursor.fetchall()}
    assert values(queries.op11_structure_repair(spark, sf).collect()) == want
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert want == {k: v[:8] for k, v in plain_repair(plain_damage(rows), {r[0] for r in rows}).items()}
