"""Streams that append each observation once; the fold as a state machine."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from goldweave.operators import sequence
from goldweave.streaming import log
from goldweave.streaming.machine import due_machine

SCHEMA = "sha string, at timestamp, body string"
DAY = datetime(2024, 3, 1)


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}")


def run(spark, tmp_path, checkpoint="ck"):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = log.append_stream(source, f"file://{tmp_path}/log", f"file://{tmp_path}/{checkpoint}", "sha", "at", 3, availableNow=True)
    query.awaitTermination(120)


def held(spark, tmp_path):
    return sorted(r["sha"] for r in log.read_log(spark, f"file://{tmp_path}/log", SCHEMA).collect())


def test_nothing_is_appended_twice(spark, tmp_path, monkeypatch):
    add(spark, tmp_path / "in", [("a", DAY, "x"), ("a", DAY, "x"), ("b", DAY, None), ("n", None, "no time")])
    run(spark, tmp_path)
    assert held(spark, tmp_path) == ["a", "b", "n"]
    # A batch that fails after its rows are written is run again by the restart.
    add(spark, tmp_path / "in", [("b", DAY + timedelta(days=2), None), ("c", DAY + timedelta(days=2), "y"), ("n", None, "no time"), ("old", DAY - timedelta(days=900), "z")])
    real = log.discard
    with monkeypatch.context() as m:
        m.setattr(log, "discard", lambda *tables: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            run(spark, tmp_path)
    assert held(spark, tmp_path) == ["a", "b", "c", "n", "old"]
    assert log.discard is real
    run(spark, tmp_path)
    assert held(spark, tmp_path) == ["a", "b", "c", "n", "old"]
    run(spark, tmp_path, "another")  # reads all anew under its own name
    assert held(spark, tmp_path) == ["a", "b", "c", "n", "old"]
    with pytest.raises(ValueError, match="batch"):
        log.append_batch(spark.createDataFrame([("q", DAY, 1)], "sha string, at timestamp, Batch int"), f"file://{tmp_path}/log", "sha", "at", "s", 0, 3)


def test_only_near_days_are_read(spark, tmp_path):
    where = f"file://{tmp_path}/log"
    for i in range(6):
        rows = spark.createDataFrame([(f"s{i}", DAY + timedelta(days=30 * i), "x")], SCHEMA)
        assert log.append_batch(rows, where, "sha", "at", "s", i, 2) == 1
    near = log.read_log(spark, where, SCHEMA).filter(F.col("day").between((DAY - timedelta(days=2)).date(), DAY.date()))
    assert len(near.inputFiles()) == 6 and near.count() == 1
    assert log.append_batch(spark.createDataFrame([("s0", DAY + timedelta(days=1), "again")], SCHEMA), where, "sha", "at", "s", 9, 2) == 0
    assert log.append_batch(spark.createDataFrame([], SCHEMA), where, "sha", "at", "s", 10, 2) == 0


def feed(spark, tmp_path, batches, schema, **days):
    """Runs the machine over one file a batch; gives the actions and the rows of its state."""
    src, out, ck = (f"file://{tmp_path}/{x}" for x in ("in", "out", "ck"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            stream = due_machine(spark.readStream.schema(schema).parquet(src), **days)
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(180)
        count = lambda name: spark.read.format("statestore").option("stateVarName", name).load(ck).count()
        return spark.read.parquet(out), {name: count(name) for name in ("waiting", "done")}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_machine_owes_what_the_batch_owes(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for key in range(60):
        opted, mail = rng.random() < 0.2, rng.random() < 0.5
        for kind in rng.sample(["invite", "accepted", "email", "halted", "other"], rng.randrange(1, 4)):
            rows.append((key, kind, datetime(2024, 1, 1) + timedelta(hours=rng.randrange(96)), opted, mail))
    schema = "key long, kind string, at timestamp, opted_out boolean, usable_email boolean"
    out, _ = feed(spark, tmp_path, [rows], schema)
    got = {}
    for r in out.orderBy("at").collect():
        got.setdefault(r["key"], r["action"])
    df = spark.createDataFrame(rows, schema)
    times = df.groupBy("key").agg(F.max("at").alias("now"), F.first("opted_out").alias("o"), F.first("usable_email").alias("u"))
    mark = F.lit(max(r[2] for r in rows) - timedelta(days=1))
    owed = F.coalesce(*(sequence.due_action(now, F.col("o"), F.col("u")) for now in (F.col("now"), mark)))
    want = {r["key"]: r["action"] for r in sequence.first_per_kind(df, "key", "kind", "at").join(times, "key").select("key", owed.alias("action")).collect()}
    assert got == {k: v for k, v in want.items() if v} and {"halted", "invite", "email"} <= set(got.values())


def test_state_of_ended_keys_goes(spark, tmp_path):
    t = datetime(2024, 1, 1)
    first = [(1, "invite", t), (1, "accepted", t), (2, "invite", t), (3, "halted", t), (4, "invite", t + timedelta(days=20))]
    late = [(4, "other", t + timedelta(days=200))]
    out, held = feed(spark, tmp_path, [first, [(3, "invite", t + timedelta(days=20))], late], "key long, kind string, at timestamp")
    assert sorted((r["key"], r["action"]) for r in out.collect()) == [(1, "email"), (2, "fallback_email"), (4, "fallback_email")]
    assert held == {"waiting": 0, "done": 1}  # 4, which has just ended
