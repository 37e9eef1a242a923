"""Exact dedup over an extendible-hash index on shared files; DataFrame operations only.

The top bits of a 64-bit hash address a directory, whose entries point to buckets.  It
starts with one entry and one bucket; an overfull bucket is split by its next bit, and a
bucket that has as many bits as the directory doubles it first.  Splits follow a histogram
of at most 2^16 hash prefixes, so the directory does not grow with the input; a bucket
that cannot be split further overflows into longer chains.

A bucket is a range of keys.  Rows are dealt by bucket to its owner task, which chains the
different texts of a key, compared as bytes, and writes the entries of its ranges to the
shared folder: bucket, key, place in the chain, row that stays, group size, and the text
itself where a chain has several links.  Every row then finds its entry through the
directory: by bucket and key, and by bytes where the key's chain has several links (where
it has one, the owner has compared every text of that key and found a single one).

Rows of buckets that stay overfull, as copies of one text make them, collapse before they
are dealt, and look-ups of those buckets are spread over several tasks.

Texts are equal when identical after lower-casing A-Z only; the row with the largest
doc_id stays.

Defined results: null text counts as empty; very long texts are compared whole; a group
without any doc_id has a null keep_id; of rows repeated with their doc_id one stays, by
the hash of its columns; an empty table gives an empty result; extra columns are kept as
they are, whatever their names.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.llm.ids import free_mark
from goldweave.llm.storage import materialize

#: Rows that a bucket holds before it is split; more where the table has many rows for each address.
BUCKET_ROWS = 1024
#: Address bits of the directory at most.
DIRECTORY_BITS = 16
#: Rows for each address, in the mean, that still leave a bucket of full depth in order.
FULL_DEPTH = 4
#: Tasks over which the look-ups of an overfull bucket are spread at most.
SPREAD = 256


def normalized(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null is empty."""
    t = F.coalesce(text, F.lit(""))
    only_ascii = F.octet_length(t) == F.char_length(t)
    return F.when(only_ascii, F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def hash_key() -> Column:
    """Equal for equal texts; folding more than A-Z only makes chains longer."""
    return F.xxhash64(F.lower(F.coalesce(F.col("text"), F.lit(""))))


def prefix(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - DIRECTORY_BITS).cast("int")


def grow_directory(histogram: dict[int, int], capacity: int = BUCKET_ROWS, bits: int = DIRECTORY_BITS) -> list[tuple[int, int, int]]:
    """Buckets as (first prefix, end, local depth) in the order of their keys, after all splits."""
    sums = [0] * ((1 << bits) + 1)
    for i in range(1 << bits):
        sums[i + 1] = sums[i] + histogram.get(i, 0)
    depth, pointers = 0, [0]
    first, local = [0], [0]  # by bucket: its first prefix and how many bits it knows
    todo = [0]
    while todo:
        bucket = todo.pop()
        low, width = first[bucket], 1 << (bits - local[bucket])
        if sums[low + width] - sums[low] <= capacity or local[bucket] == bits:
            continue
        if local[bucket] == depth:
            pointers = [p for p in pointers for _ in range(2)]
            depth += 1
        local[bucket] += 1
        first.append(low + width // 2)
        local.append(local[bucket])
        for entry in range((low + width // 2) >> (bits - depth), (low + width) >> (bits - depth)):
            pointers[entry] = len(first) - 1
        todo += [bucket, len(first) - 1]
    reached = dict.fromkeys(pointers)  # in the order of addresses
    return [(first[b], first[b] + (1 << (bits - local[b])), local[b]) for b in reached]


def directory(docs: DataFrame, capacity: int = BUCKET_ROWS) -> tuple[DataFrame, bool]:
    """(prefix, bucket, spread), at most 2^16 rows, and whether a bucket stays overfull (its spread is above 1)."""
    found = docs.select(prefix(hash_key()).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
    histogram = {r["p"]: r["n"] for r in found}
    capacity = max(capacity, FULL_DEPTH * sum(histogram.values()) >> DIRECTORY_BITS)
    buckets = grow_directory(histogram, capacity)
    full = [histogram.get(low, 0) if depth == DIRECTORY_BITS else 0 for low, _, depth in buckets]
    spread = [max(1, min(SPREAD, -(-n // capacity))) for n in full]
    text = json.dumps([{"low": a, "high": b, "bucket": i, "spread": spread[i]} for i, (a, b, _) in enumerate(buckets)])
    rows = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<low:int,high:int,bucket:int,spread:int>>")))
    return rows.select(F.explode(F.sequence("low", F.col("high") - 1)).alias("prefix"), "bucket", "spread"), max(spread) > 1


def build_index(docs: DataFrame, addresses: DataFrame, overfull: bool) -> DataFrame:
    """(bucket, key, link, chain, body, keep_id, group_size, spread): an entry for each different text, stored by its owner."""
    rows = docs.select("doc_id", hash_key().alias("key"), normalized(F.col("text")).alias("body")).withColumn("prefix", prefix(F.col("key")))
    rows = rows.join(F.broadcast(addresses), "prefix").select("bucket", "spread", "key", "body", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    text = ("bucket", "spread", "key", "body")
    collapsed = lambda df: df.groupBy(*text).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    if overfull:
        rows = rows.filter("spread = 1").unionByName(collapsed(rows.filter("spread > 1")))
    texts = collapsed(rows.repartition("bucket"))
    key = Window.partitionBy("bucket", "key")
    chained = texts.withColumns({"link": F.row_number().over(key.orderBy("body")), "chain": F.count("*").over(key)})
    return materialize(chained.withColumn("body", F.when(F.col("chain") > 1, F.col("body"))), "hash-index")


def _with_entries(docs: DataFrame, mark: str, carried: dict[str, Column]) -> DataFrame:
    """``docs`` with the columns ``carried``, and keep_id, group_size and kept behind ``mark``; no row is lost."""
    addresses, overfull = directory(docs)
    index = build_index(docs, addresses, overfull)
    places = [f"{mark}{n}" for n in ("bucket", "key", "salt")]
    bucket, key, salt = places
    rows = docs.withColumn(key, hash_key()).withColumn(f"{mark}prefix", prefix(F.col(key)))
    named = addresses.select(F.col("prefix").alias(f"{mark}prefix"), F.col("bucket").alias(bucket), F.col("spread").alias(f"{mark}spread"))
    rows = rows.join(F.broadcast(named), f"{mark}prefix")
    rows = rows.withColumn(salt, F.when(F.col(f"{mark}spread") > 1, F.pmod(F.xxhash64("doc_id"), F.col(f"{mark}spread"))).otherwise(0).cast("int"))

    entries = index.select(
        F.col("bucket").alias(bucket), F.col("key").alias(key), F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias(salt), F.col("chain").alias(f"{mark}chain"),
        F.col("link").alias(f"{mark}link"), F.col("keep_id").alias(f"{mark}keep_id"), F.col("group_size").alias(f"{mark}group_size"), F.col("body").alias(f"{mark}body"),
    )
    kept = [*docs.columns, *carried, bucket, key, *(f"{mark}{n}" for n in ("link", "keep_id", "group_size"))]
    slim = rows.select(*docs.columns, *(c.alias(n) for n, c in carried.items()), *places)
    found = slim.join(entries.filter(F.col(f"{mark}chain") == 1).drop(f"{mark}chain", f"{mark}body"), places).select(*kept)
    several = index.filter("chain > 1")
    if not several.isEmpty():
        links = materialize(entries.filter(F.col(f"{mark}chain") > 1).drop(f"{mark}chain"), "long-chains")
        wide = rows.select(*docs.columns, *(c.alias(n) for n, c in carried.items()), *places, normalized(F.col("text")).alias(f"{mark}body"))
        found = found.unionByName(wide.join(links, [*places, f"{mark}body"]).select(*kept))
    stays = F.col("doc_id").eqNullSafe(F.col(f"{mark}keep_id"))
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():  # repeated rows need an order
        again = Window.partitionBy(bucket, key, f"{mark}link", "doc_id").orderBy(F.xxhash64(*docs.columns))
        stays = stays & (F.row_number().over(again) == 1)
    return found.withColumn(f"{mark}kept", stays)


def decide_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    digest = F.sha2(normalized(F.col("text")), 256)
    found = _with_entries(docs.select("doc_id", "text"), "_copy_", {"text_sha256": digest})
    return found.select("doc_id", *(F.col(f"_copy_{n}").alias(n) for n in ("keep_id", "group_size", "kept")), "text_sha256")


def keep_one_copy(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged."""
    mark = free_mark(docs.columns, "_copy_")
    return _with_entries(docs, mark, {}).filter(F.col(f"{mark}kept")).select(*docs.columns)
