"""Chat formatting over reply trees.

Messages point to the message that they answer.  Iterative self-joins double the
distance that a message sees towards its root, so a path of n messages takes log2(n)
joins; the branch score of a leaf is summed on the way.  Leaves are ranked in their
conversation, and each chosen root-to-leaf path is formatted as one conversation.

The template marks every turn; control strings inside texts are escaped so that only
the template's own marks can be read as marks, and unescaping gives the texts back.
The loss mask is a list of code point ranges of the formatted text: assistant texts.

Defined results: null texts and roles count as empty; null conversation ids are one
conversation; rows of equal turn follow each other, ordered by role and text; a parent
that does not exist makes a root; a cycle of parents raises ``ValueError``; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.llm.ids import as_long, as_text
from goldweave.llm.storage import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that some template reads as a mark; none stays whole inside a text.
CONTROL = ("<</SYS>>", "<<SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "[/INST]", "[INST]", "</s>", "<s>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPE = re.compile(r"\\([\\n.])")
_TURN = re.compile(re.escape(OPEN) + "([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)
TRAINED_ROLE = "assistant"
MAX_DOUBLINGS = 40


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\." + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: {"\\": "\\", "n": "\n", ".": ""}[m[1]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the code point ranges under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN + escape(role).replace("\n", "\\n") + "\n"
        body = escape(text)
        if role == TRAINED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at code point {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def conversation_key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit("null"))


def thread(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a reply tree: every row answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("node", F.row_number().over(order).cast("long")).select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(conv_id, leaf, rank, node, up) of the ``keep`` best root-to-leaf paths of each conversation.

    ``messages`` has conv_id, node (unique in its conversation), parent and score; ``up``
    is a node's distance from the leaf.
    """
    base = messages.select("conv_id", conversation_key(F.col("conv_id")).alias("k"), "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    present = base.select("k", F.col("node").alias("parent"), F.lit(True).alias("known"))
    level = materialize(
        base.join(present, ["k", "parent"], "left").select(
            "conv_id", "k", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")
        ),
        "tree",
    )
    first, levels = level, []
    settled = level.filter("up is null")  # rows that see their root take no part in further joins
    while level.filter("up is not null").limit(1).count():
        live = level.filter("up is not null")
        levels.append(live)
        if len(levels) > MAX_DOUBLINGS:
            raise ValueError("the parents form a cycle")
        state = live.unionByName(settled)
        above = state.select("k", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        level = materialize(
            live.join(above, ["k", "up"]).select(
                "conv_id", "k", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth")
            ),
            "tree",
        )
        settled = settled.unionByName(level.filter("up is null"))
    parents = first.select("k", F.col("up").alias("node")).filter("node is not null").distinct()
    leaves = settled.join(parents, ["k", "node"], "left_anti")
    best = Window.partitionBy("k").orderBy(F.desc("total"), F.desc("depth"), "node")
    path = (
        leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
        .select("conv_id", "k", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("up"))
    )
    for n in reversed(range(len(levels))):  # each distance is a sum of distinct powers of two
        jump = levels[n].select("k", "node", F.col("up").alias("to"))
        here = F.struct("node", "up")
        there = F.struct(F.col("to").alias("node"), (F.col("up") + (1 << n)).alias("up"))
        both = F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))
        path = path.join(jump, ["k", "node"], "left").select("conv_id", "k", "leaf", "rank", F.explode(both).alias("s")).select("conv_id", "k", "leaf", "rank", "s.*")
    return path


def format_branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """conv_id, leaf, rank, formatted, loss (code point ranges) of each chosen path."""
    texts = messages.select(conversation_key(F.col("conv_id")).alias("k"), "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns")
    paths = branches(messages, keep).join(texts, ["k", "node"]).groupBy("k", "leaf").agg(F.first("conv_id").alias("conv_id"), F.first("rank").alias("rank"), turns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for turns in pdf["turns"]:
                text, spans = render([(t["role"], t["text"]) for t in turns])
                rows.append((text, [{"start": a, "end": b} for a, b in spans]))
            out = pd.DataFrame(rows, columns=["formatted", "loss"])
            yield pd.concat([pdf[["conv_id", "leaf", "rank"]].reset_index(drop=True), out], axis=1)

    rows = as_text(paths.select("conv_id", "leaf", "rank", "turns"), "conv_id", "leaf")
    return as_long(rows.mapInPandas(run, "conv_id string, leaf string, rank int, formatted string, loss array<struct<start long, end long>>"), "conv_id", "leaf")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations and their loss masks hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, spans in zip(pdf["formatted"], pdf["loss"], strict=True):
                turns = parse(text)
                said = "".join([f"{r}\n{t}\n" for r, t in turns])
                loss = "".join([unescape(text[s["start"] : s["end"]]) for s in spans])
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            out = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.insert(0, "conv_id", pdf["conv_id"].to_numpy())
            yield out

    rows = as_text(formatted.select("conv_id", "formatted", "loss"), "conv_id")
    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return as_long(rows.mapInPandas(run, schema), "conv_id")
