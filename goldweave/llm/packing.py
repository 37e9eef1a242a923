"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most one sequence; the plan is made from the
histogram of piece lengths alone (at most ``capacity`` rows, whatever the input).
For each bin the largest length left is set, and bitset subset-sum dynamic
programming over the lengths left finds the fullest feasible rest; the combination
is removed as often as its lengths last.  Pieces then take their places by rank
within their length.

Defined results: null text is an empty document and packs as its end token alone;
longer documents are cut into full pieces behind a first piece that holds the
remainder; very long texts are cut into as many pieces as they need; repeated rows are
packed once each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldweave.llm import byte_pairs
from goldweave.llm.ids import as_long, as_text
from goldweave.llm.storage import materialize

CAPACITY = 1024
END_TOKEN = 2
#: Pieces of one length that a numbering group holds on average.
BLOCK_ROWS = 1024
#: Characters from which a text is encoded in overlapping chunks.
LONG_TEXT = 1 << 17


@lru_cache(maxsize=2)
def load_ranks(path: str):
    """A byte-level BPE encoder over the file's ranks, with the added tokens of the tokenizer file beside it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(os.path.splitext(path)[0] + ".json", "rb") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(encoding, ranks_path: str, text: str) -> list[int]:
    """Ids of a text; long ones, of which a run may be too long for the library's pattern, are stitched from chunks."""
    if len(text) < LONG_TEXT:
        return encoding.encode(text, allowed_special="all")
    added = encoding._special_tokens
    parts = re.split("(" + "|".join(map(re.escape, added)) + ")", text)
    coder = byte_pairs.encoder(ranks_path)
    return [i for p in parts if p for i in ([added[p]] if p in added else coder.encode_text(p))]


def cut_points(length: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document of ``length`` tokens; the first may be shorter."""
    head = length % capacity or capacity
    return [0, *range(head, length, capacity)]


def tokenize_pieces(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_ranks(ranks_path)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.array([*(token_ids(encoding, ranks_path, text) if text else ()), END_TOKEN], "<u4")
                starts = cut_points(len(ids), capacity)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    row = (doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                    rows.append((*row, ids[a:b].astype(np.int32)) if keep_ids else row)
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    return as_long(as_text(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, schema), "doc_id")


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """A combination of available lengths that fills ``room`` as far as any can."""
    if room <= 0:
        return {}
    mask = (1 << (room + 1)) - 1
    reach = 1
    layers: list[tuple[int, int, int]] = []
    for length in sorted(available, reverse=True):
        left = min(available[length], room // length)
        take = 1
        while left > 0:  # copies in binary steps, so that many short ones cost few layers
            take = min(take, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as (length -> copies, how many bins of this kind), fullest first for each largest length."""
    left = {k: v for k, v in histogram.items() if v}
    bins = []
    while left:
        largest = max(left)
        rest = {k: v - (k == largest) for k, v in left.items() if v - (k == largest)}
        used = fullest(rest, capacity - largest)
        used[largest] = used.get(largest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        bins.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return bins


def _places(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, copies in a bin, first sequence, offset in the sequence)."""
    seen: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for used, times in bins:
        offset = 0
        for length in sorted(used, reverse=True):
            out.setdefault(length, []).append((seen.get(length, 0), used[length], sequence, offset))
            seen[length] = seen.get(length, 0) + used[length] * times
            offset += length * used[length]
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``pieces`` (stored, so that they are made once) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(plan_bins(histogram, capacity))
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    # Ranks in two levels: a length that many pieces share is numbered by several tasks.
    blocks = spark.createDataFrame([(k, math.ceil(n / block_rows)) for k, n in histogram.items()], "length long, blocks int")
    dealt = pieces.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("blocks")))
    sizes = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("inner", inner).join(offsets, ["length", "block"]).withColumn("rank", F.col("before") + F.col("inner"))
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if not len(at):
                    continue
                length = int(lengths[at[0]])
                table = places[length]
                row = table[np.searchsorted(table[:, 0], ranks[at], "right") - 1]
                turn, copy = np.divmod(ranks[at] - row[:, 0], row[:, 1])
                sequence[at] = row[:, 2] + turn
                offset[at] = row[:, 3] + copy * length
            yield pdf[kept].assign(sequence_id=sequence, offset=offset)

    rows = as_text(ranked.select(*kept, "rank"), "doc_id")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return as_long(rows.mapInPandas(settle, fields + ", sequence_id long, offset long"), "doc_id")


def pack_documents(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    return place_pieces(materialize(tokenize_pieces(docs, ranks_path, capacity, keep_ids), "pieces"), capacity)
