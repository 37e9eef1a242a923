"""Endpoints by their words, leaves of payloads, corroborated answers, tables by ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from goldweave.functions import endpoints
from goldweave.operators import enrich
from goldweave.ranged import Ranged
from goldweave.sources import payloads

PATHS = {
    "/v1/people/{id}": [], "/v1/single-send": ["send"], "/V1/singleSend": ["send"], "/v1/singlesend": ["send"], "/consequence": [], "/sequence": ["sequence"], "/{action}": ["action"],
    "/{id}/%2573end": ["send"], "/%25252525252573end": [], "/bulk+read/100%": [], "/{emailCall}": ["call"], "/reSubscribed": ["subscribe"], "": [], "/Notes/añadir": ["notes"], "/%zz/tasks": ["tasks"],
}


def test_words_of_endpoints(spark):
    rng = random.Random(2)
    bits = ["/", "send", "Send", "note", "s", "%73", "%25", "{", "}", "A", "op", "9", "-", "_", "+", "%", "é", "mail", "er"]
    paths = [*PATHS, *("".join(rng.choices(bits, k=rng.randrange(8))) for _ in range(800))]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", endpoints.send_hits(F.col("path")).alias("hits"))
    got = {r["path"]: r["hits"] for r in rows.collect()}
    assert {p: got[p] for p in PATHS} == PATHS
    assert got == {p: endpoints.sending_words(p) for p in paths}
    asked = spark.createDataFrame([("post", "/a"), ("GET", "/a"), ("POST", "/b"), ("POST", "/send"), ("GET", None)], "m string, p string")
    said = [r[0] for r in asked.select(endpoints.send_problem(F.col("m"), F.col("p"), ["/b", "/send"])).collect()]
    assert said[:4] == ["unlisted_post", None, None, "names send"]


def plain_leaves(value, path=""):
    if isinstance(value, dict):
        return {x for k, v in value.items() for x in plain_leaves(v, f"{path}.{k}" if path else k)}
    if isinstance(value, list):
        return {x for v in value for x in plain_leaves(v, path + "[]")}
    return {path}


def made(rng, depth):
    kind = rng.randrange(6 if depth else 3)
    if kind < 3:
        return [None, "{x", 3][kind]
    if kind < 5:
        return {k: made(rng, depth - 1) for k in rng.sample(["a", "b", "c"], rng.randrange(3))}
    return [made(rng, depth - 1) for _ in range(rng.randrange(3))]


def test_leaves_of_payloads(spark):
    rng = random.Random(4)
    held = [(i, {"r": made(rng, 5), "s": made(rng, 3)}) for i in range(150)]
    texts = [(i, json.dumps(v)) for i, v in held] + [(900, "[1]"), (901, "{"), (902, None), (903, ""), (904, "{}")]
    files = spark.createDataFrame(texts, "file long, payload string")
    got = {tuple(r) for r in payloads.payload_leaves(files, "file", F.col("payload")).collect()}
    want = {(i, p) for i, v in held for p in plain_leaves(v)}
    assert got == want
    declared = ["r.a", "s", "r.b[]"]
    below = lambda p: any(p == d or p.startswith((d + ".", d + "[]")) for d in declared)
    leaves = spark.createDataFrame(sorted(want), "file long, leaf string")
    left = payloads.uncovered(leaves, "file", spark.createDataFrame([(d,) for d in declared], "path string"))
    assert {tuple(r) for r in left.collect()} == {(i, p) for i, p in want if not below(p)}
    assert payloads.payload_leaves(files.limit(0), "file", F.col("payload")).count() == 0


def test_corroboration(spark):
    rows = [
        ("a", "b", "email", "email", "t", None, "t", None), ("a", "a", "email", "email", None, None, None, None), (None, "b", "name_domain", "name", "t", "e", "u", "e"),
        (None, "b", "name_domain", "name", "t", None, "u", "e"), (None, "b", "email", "name", "t", None, "t", None), (None, None, None, None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, "asker_linkedin string, linkedin string, rung string, anchor string, asker_title string, asker_employer string, title string, employer string")
    got = [(r["outcome"], r["reason"]) for r in enrich.attach_corroborated(d).collect()]
    assert got == [("discarded", "other_profile"), ("kept", None), ("dropped", "by_name"), ("discarded", "uncorroborated"), ("dropped", "by_name"), ("dropped", "weak_rung")]


def files_read(df):
    """Files that the scan opens, by the plan's own metric."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))


def test_point_reads_open_few_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for parts in (8, 32):
            table = Ranged(f"file://{tmp_path}/t{parts}", "k")
            rows = spark.range(parts * 200).select(F.floor(F.col("id") / 2).alias("k"), F.col("id").alias("x"))
            table.store(rows.unionByName(spark.createDataFrame([(None, -1)], "k long, x long")), parts)
            at = table.at(spark, 37)
            assert sorted(r["x"] for r in at.collect()) == [74, 75] and files_read(at) <= 2
            page = table.page(spark, 50, 10)
            assert [r["k"] for r in page.collect()] == [k for k in range(51, 56) for _ in (0, 1)] and files_read(page.select("k")) <= 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert table.at(spark, -5).count() == 0
    far = table.page(spark, None, 3, F.col("x") >= parts * 200 - 4)  # kept rows lie at the end: refilled to the last range
    assert {parts * 200 - 4, parts * 200 - 3} < {r["x"] for r in far.collect()}
    assert far.count() == 3 and table.page(spark, 10**9, 5).count() == 0


def test_a_large_key_is_dealt_over_ranges(spark, tmp_path):
    table = Ranged(f"file://{tmp_path}/t", "k")
    table.store(spark.range(6000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("x")), 8)
    ends = spark.read.parquet(f"file://{tmp_path}/t/parts").collect()
    assert max(r["n"] for r in ends) < 1500 and sum(r["low"] <= 7 <= r["high"] for r in ends) >= 4
    assert table.at(spark, 7).count() == 3001
    with pytest.raises(ValueError, match="_part"):
        table.store(spark.range(1).select(F.col("id").alias("k"), F.lit(1).alias("_PART")), 2)
