"""Raw provider payloads: fixture scans, declared field maps, drift of the schema.

A provider is a schema, a list of field rules and the paths it ignores.  Unmapped leaves
are found, never guessed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FieldRule:
    """A raw path, the canonical path that it feeds, and how (a function of a column)."""

    raw: str
    path: str
    transform: object = None

    def column(self) -> Column:
        c = F.col(self.raw)
        return self.transform(c) if self.transform else c


def read_fixture(spark: SparkSession, root: str, provider: str, endpoint: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(f"{root}/{provider}/{endpoint}.json")


def read_technologies(spark: SparkSession, path: str) -> DataFrame:
    """(uid, category, name) of a two-column CSV list."""
    rows = spark.read.option("header", True).schema("Category STRING, Technology STRING").csv(path)
    return rows.select(technology_uid(F.col("Technology")).alias("uid"), F.col("Category").alias("category"), F.col("Technology").alias("name"))


def technology_uid(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[ .]", "_")


def to_contributions(raw: DataFrame, key: str, rules: list[FieldRule]) -> DataFrame:
    """(key, path, value, raw_path): one row for each rule whose value is present."""
    items = [F.struct(F.lit(r.path).alias("path"), r.column().cast("string").alias("value"), F.lit(r.raw).alias("raw_path")) for r in rules]
    return raw.select(key, F.inline(F.filter(F.array(*items), lambda x: x["value"].isNotNull())))


def absences(raw: DataFrame, key: str, rules: list[FieldRule], declared: set[str]) -> DataFrame:
    """(key, path, kind): asked for and not there is negative evidence; undeclared is not applicable."""
    items = [
        F.struct(F.lit(r.path).alias("path"), F.when(F.lit(r.path not in declared), "not_applicable").when(r.column().isNull(), "negative_evidence").alias("kind"))
        for r in rules
    ]
    return raw.select(key, F.inline(F.filter(F.array(*items), lambda x: x["kind"].isNotNull())))


def leaves(schema: T.DataType, prefix: str = "") -> list[str]:
    """Dotted paths of all leaves; elements of arrays as []."""
    if isinstance(schema, T.StructType):
        return [x for f in schema.fields for x in leaves(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return leaves(schema.elementType, prefix + "[]")
    return [prefix]


def unmapped(schema: T.StructType, rules: list[FieldRule], ignored: set[str]) -> list[str]:
    """Leaves that no rule reads and nobody ignores."""
    named = {r.raw for r in rules} | ignored
    return [x for x in leaves(schema) if not any(x == n or x.startswith((n + ".", n + "[]")) for n in named)]
