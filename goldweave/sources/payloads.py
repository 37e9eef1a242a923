"""Leaves of JSON payloads, row by row: what no field rule reads, and files that no manifest covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.storage import materialize

#: What a payload is when it is no JSON object.
UNREADABLE = "unreadable"


def payload_leaves(rows: DataFrame, key: str, payload: Column) -> DataFrame:
    """(key, leaf): dotted paths of all leaves of each payload, elements of arrays as ``[]``, each once.

    One round a level: objects and arrays are opened side by side, whatever their rows. An
    empty object or array has no leaf; payloads that are no object have none either.
    """
    spark = rows.sparkSession
    start = rows.select(F.col(key).alias("k"), F.lit("").alias("p"), F.try_parse_json(payload).alias("v"))
    front = materialize(start.filter(F.schema_of_variant("v").startswith("OBJECT")).withColumn("v", F.to_json("v")), "leaves")
    found = None
    while True:
        opened = spark.sql(
            "SELECT DISTINCT k, CASE WHEN x.key IS NULL THEN p || '[]' WHEN p = '' THEN x.key ELSE p || '.' || x.key END AS p, to_json(x.value) AS v "
            "FROM {front}, LATERAL variant_explode(parse_json(v)) x",
            front=front,
        )
        front = materialize(opened.withColumn("deep", _nested_json("v")), "leaves")
        leaves = front.filter(~F.col("deep")).select(F.col("k").alias(key), F.col("p").alias("leaf")).distinct()
        found = leaves if found is None else found.unionByName(leaves)
        front = front.filter("deep").drop("deep")
        if front.isEmpty():
            return found.distinct()


def _nested_json(text: str) -> Column:
    """Whether a JSON text is an object or an array: known by its first character."""
    return F.coalesce(F.substring(text, 1, 1).isin("{", "["), F.lit(False))


def ancestors(leaf: Column) -> Column:
    """A path and all paths above it: ``a.b[].c`` lies below ``a.b[]``, ``a.b`` and ``a``."""
    steps = F.regexp_extract_all(leaf, F.lit(r"\[\]|[^.\[]+|\["), F.lit(0))
    join = lambda a, s: F.when((a == "") | (s == "[]"), F.concat(a, s)).otherwise(F.concat(a, F.lit("."), s))
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.aggregate(F.slice(steps, 1, n), F.lit(""), join))


def uncovered(leaves: DataFrame, key: str, declared: DataFrame) -> DataFrame:
    """(key, leaf) of leaves that lie below no path of ``declared`` (path): joined by each path above them, never path by path."""
    above = leaves.select(key, "leaf", F.explode(ancestors(F.col("leaf"))).alias("path"))
    known = above.join(declared.select("path").distinct(), "path", "left_semi").select(key, "leaf").distinct()
    return leaves.join(known, [key, "leaf"], "left_anti")


def drift(leaves: DataFrame, key: str, declared: DataFrame) -> DataFrame:
    """(leaf, rows, first): leaves that no rule reads and nobody ignores, in how many rows, and the least of these."""
    return uncovered(leaves, key, declared).groupBy("leaf").agg(F.count("*").alias("rows"), F.min(key).alias("first"))


def file_faults(files: DataFrame, manifest: DataFrame, declared: DataFrame, today: Column) -> DataFrame:
    """(file, fault, leaf): each file's unlisted, dated_ahead, unreadable and unmapped faults; listed files that are missing.

    ``files`` is (file, payload), ``manifest`` (file, recorded_on), ``declared`` (path).
    """
    listed = manifest.select("file", "recorded_on").withColumn("_listed", F.lit(True))
    both = files.select("file", F.col("payload"), F.lit(True).alias("_there")).join(listed, "file", "full_outer")
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False))
    faults = F.array_compact(F.array(
        F.when(F.col("_listed").isNull(), "unlisted"), F.when(F.col("_there").isNull(), "missing"),
        F.when(F.col("_listed").isNotNull() & F.coalesce(F.col("recorded_on") > today, F.lit(True)), "dated_ahead"),
        F.when(F.col("_there").isNotNull() & ~readable, UNREADABLE),
    ))
    plain = both.select("file", F.explode(faults).alias("fault"), F.lit(None).cast("string").alias("leaf"))
    stray = uncovered(payload_leaves(files, "file", F.col("payload")), "file", declared)
    return plain.unionByName(stray.select("file", F.lit("unmapped").alias("fault"), "leaf"))
