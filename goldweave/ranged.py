"""Tables laid out by ranges of a key, so that a point or a page opens few files.

``data`` holds the rows, a folder a range, sorted; ``parts`` one row a range: its least and
greatest key and its number of rows. A reader looks the ranges up and names their folders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ranged:
    """A table at ``path`` whose rows lie by ``key``."""

    path: str
    key: str

    def store(self, rows: DataFrame, parts: int) -> None:
        """Writes ``rows`` in ``parts`` ranges of about equal size; rows without a key are left out.

        A key that holds many rows is dealt over several ranges by a hash of the row, and a
        range of rows equal in all columns stays whole.
        """
        if {"_part", "_deal"} & {c.lower() for c in rows.columns}:
            raise ValueError("_part and _deal are columns of the layout")
        held = rows.filter(F.col(self.key).isNotNull()).withColumn("_deal", F.xxhash64(*rows.columns))
        dealt = held.repartitionByRange(parts, self.key, "_deal").withColumn("_part", F.spark_partition_id())
        dealt.sortWithinPartitions("_part", self.key).drop("_deal").write.partitionBy("_part").parquet(f"{self.path}/data")
        k = F.col(self.key)
        ends = rows.sparkSession.read.parquet(f"{self.path}/data").groupBy("_part").agg(F.min(k).alias("low"), F.max(k).alias("high"), F.count("*").alias("n"))
        ends.orderBy("low", "_part").write.parquet(f"{self.path}/parts")

    def rows(self, spark: SparkSession, parts: list[int]) -> DataFrame:
        """The rows of some ranges; other folders are pruned."""
        return spark.read.parquet(f"{self.path}/data").filter(F.col("_part").isin(parts)).drop("_part")

    def at(self, spark: SparkSession, value: object) -> DataFrame:
        """All rows of one key: of one range, or of the ranges over which a large key is dealt."""
        ends = spark.read.parquet(f"{self.path}/parts").filter(F.lit(value).between(F.col("low"), F.col("high")))
        return self.rows(spark, [r["_part"] for r in ends.select("_part").collect()]).filter(F.col(self.key) == value)

    def page(self, spark: SparkSession, after: object, n: int, where: Column | None = None) -> DataFrame:
        """The first ``n`` rows in order of their key behind ``after`` (null: from the start) that ``where`` keeps.

        Ranges are opened in their order, twice as many each time that the rows did not suffice.
        """
        kept = F.lit(True) if where is None else where
        if after is not None:
            kept = kept & (F.col(self.key) > after)
        opened: list[int] = []
        found = 0
        for parts in self._onwards(spark, after, n):
            opened += parts
            found += self.rows(spark, parts).filter(kept).limit(n - found).count()
            if found >= n:
                break
        return self.rows(spark, opened).filter(kept).orderBy(self.key).limit(n)

    def _onwards(self, spark: SparkSession, after: object, n: int) -> Iterator[list[int]]:
        """Ranges behind a key in their order, in growing lots; the first is the fewest that may hold ``n`` rows."""
        ends = spark.read.parquet(f"{self.path}/parts")
        last, lot = None, 1
        while True:
            left = ends if after is None else ends.filter(F.col("high") > after)
            if last is not None:
                left = left.filter(F.struct("low", "_part") > F.struct(F.lit(last["low"]).alias("low"), F.lit(last["_part"]).alias("_part")))
            taken = left.orderBy("low", "_part").limit(lot).collect()
            if not taken:
                return
            last, lot = taken[-1], 2 * lot
            yield [r["_part"] for r in taken]
