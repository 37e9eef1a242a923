"""Sharding by jump consistent hashing.

A key alone and the shard count decide where a row goes; there is no ring table.
Growing from n to n + 1 shards moves rows only into the new shard, and only the
necessary 1 / (n + 1) of them.

Defined results: a null key is one more key value, whose rows share a shard but are
numbered by many tasks; null text has size 8 (the framing) and CRC 0; very long texts
count whole; repeated rows share a shard and get slots of their own; an empty table gives
an empty result; extra columns are ignored, and where ``shard`` or ``grown_shard`` is
taken in any case, ``assign_shards`` adds an underscore to its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.llm.ids import free_name
from goldweave.llm.storage import materialize

SHARDS = 24
FRAME_BYTES = 8
#: Rows that one numbering group holds on average.
BLOCK_ROWS = 4096


def jump_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of 64-bit keys; every round serves only the keys that still jump."""
    if buckets < 1:
        raise ValueError("buckets must be positive")
    state = keys.astype(np.uint64, copy=True)
    out = np.full(len(state), -1, np.int64)
    landing = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        out[live] = landing[live]
        with np.errstate(over="ignore"):
            s = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        state[live] = s
        step = float(1 << 31) / ((s >> np.uint64(33)).astype(np.float64) + 1.0)
        landing[live] = ((out[live] + 1) * step).astype(np.int64)
        live = live[landing[live] < buckets]
    return out


def jump_column(key: Column, buckets: int) -> Column:
    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64), buckets).astype(np.int32))

    return place(key)


def assign_shards(df: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """``df`` with ``shard`` and ``grown_shard`` (the shard among one more)."""
    mixed = F.xxhash64(F.col(key))
    names = [free_name(df.columns, n) for n in ("shard", "grown_shard")]
    return df.withColumns({names[0]: jump_column(mixed, shards), names[1]: jump_column(mixed, shards + 1)})


def shard_documents(docs: DataFrame, shards: int = SHARDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: its shard and its gapless slot there.

    Slots are numbered in two levels so that no task orders a whole shard: rows of
    a shard fall into blocks by the hash of their columns, blocks get their offset from a
    running sum of block sizes, and rows are ordered only within their block.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + FRAME_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    blocks = max(1, math.ceil(docs.count() / (block_rows * shards)))
    block = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit(1)), F.lit(blocks)).alias("block")
    placed = materialize(assign_shards(rows.select("*", block), "doc_id", shards), "shards")
    sizes = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("inner", inner)
        .join(offsets, ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("offset") + F.col("inner") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
