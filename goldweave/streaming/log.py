"""Append-only logs fed by streams: every observation once, whatever is restarted."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from goldweave.storage import discard, exists, materialize

#: Columns of the layout, beside those of the rows.
LAYOUT = ("stream", "batch", "day")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a log with the stream, batch and day that hold them; empty where nothing was appended."""
    whole = f"{schema}, stream string, batch long, day date"
    if not exists(spark, path):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(path)


def append_batch(rows: DataFrame, path: str, sha: str, at: str, stream: str, batch: int, days: int) -> int:
    """Appends what is new of one batch of a stream, and says how many rows that were.

    A batch owns the folder of its number.  A repeated batch looks past that folder and
    writes it anew, so neither a failure half-way nor a restart appends anything twice.
    Equal digests lie at most ``days`` apart in ``at``: only those days of the log are read,
    of which only the digests.  Rows of any age are appended, rows without a time too (their
    day is null; they are compared with all rows without one).
    """
    clash = {c.lower() for c in rows.columns} & set(LAYOUT)
    if clash:
        raise ValueError(f"columns of the log's layout: {', '.join(sorted(clash))}")
    spark = rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    stored = materialize(rows.withColumn("day", F.to_date(at)), "batch")
    ends = stored.agg(F.date_sub(F.min("day"), days).alias("low"), F.date_add(F.max("day"), days).alias("high")).first()
    near = F.col("day").isNull() if ends["low"] is None else F.col("day").isNull() | F.col("day").between(ends["low"], ends["high"])
    older = read_log(spark, path, schema).filter(near & ~((F.col("stream") == stream) & (F.col("batch") == batch)))
    fresh = materialize(stored.dropDuplicates([sha]).join(older.select(sha), sha, "left_anti"), "fresh")
    n = fresh.count()
    fresh.write.mode("overwrite").partitionBy("day").parquet(f"{path}/stream={stream}/batch={batch}")
    discard(stored, fresh)
    return n


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """What tells the batches of one checkpoint from those of another: the id that Spark keeps in it."""
    held = json.loads("\n".join(r["value"] for r in spark.read.text(f"{checkpoint}/metadata").collect()))  # one small file
    return re.sub("[^0-9a-zA-Z-]", "", held["id"])


def append_stream(rows: DataFrame, path: str, checkpoint: str, sha: str, at: str, days: int = 30, **trigger: object) -> StreamingQuery:
    """Starts a query that appends a stream of rows to the log at ``path``.

    A new checkpoint is a new stream with folders of its own: it reads its source anew, and
    what the log holds already is left out by digest.
    """

    def add(batch: DataFrame, number: int) -> None:
        append_batch(batch, path, sha, at, stream_name(batch.sparkSession, checkpoint), number, days)

    out = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()
