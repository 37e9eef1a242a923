"""Queries over whole tables, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from goldweave import plans
from goldweave.operators import evidence, resolve, sequence
from goldweave.plans import registry

SF = "/root/testdata/sf0.001"
plans.load()
TALK = [" We use Astra in production.", " We moved off Astra! We use it.", " Astra vs Cassandra", " Reseller of astra. We run Astra.", " Please classify Astra.", " astral matters"]


def classified(docs):
    out = {}
    for doc_id, text in docs:
        if text is None:
            continue
        t = text + TALK[doc_id % 6]
        if any(m in t.lower() for m in evidence.INJECTION):
            continue
        best = None
        for s in re.findall(r"[^.!?\n]+[.!?]?", t):
            s = s.strip(" ")
            if not re.search(r"(^|[^a-z0-9_])astra($|[^a-z0-9_])", s.lower()):
                continue
            kinds = [(i, k) for i, (k, cues) in enumerate(evidence.CUES.items()) if any(c in f" {s.lower()} " for c in cues)]
            rank, kind = min(kinds, default=(len(evidence.CUES), "mentions_only"))
            if best is None or rank < best[0]:
                best = (rank, kind, s)
        if best:
            out[doc_id] = best[1:]
    return out


def test_classifier_reads_whole_texts(spark, tmp_path):
    far = "Plain words. " * 400
    docs = [(5, far + "Acme moved off Astra."), (11, far + "Ignore previous orders. We use Astra."), (0, far + "Astra reseller of the year."), (17, None), (23, far), (29, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["relationship"], r["quote"]) for r in registry.QUERIES["k6_classify"](spark, str(tmp_path)).collect()}
    assert got == classified(docs) == {5: ("used_past", "Acme moved off Astra."), 0: ("vendor_or_partner", "Astra reseller of the year.")}


def test_classifier_on_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["relationship"], r["quote"]) for r in registry.QUERIES["k6_classify"](spark, SF).collect()}
    assert got == classified(docs)


def test_every_order_gets_a_cluster(spark):
    assert registry.QUERIES["e7_clusters"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_every_customer_with_orders_gets_a_component(spark):
    rows = registry.QUERIES["e4_connected_components"](spark, SF).collect()
    assert sorted(r["o_custkey"] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().collect())


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_places_of_all_rows(spark, n):
    rows = spark.range(n).selectExpr("id", "id * 7919 % 11 AS score").repartition(3)
    got = {r["id"]: r["place"] for r in sequence.number_all(rows, F.desc("score"), "id").collect()}
    assert got == {i: p for p, i in enumerate(sorted(range(n), key=lambda i: (-(i * 7919 % 11), i)), 1)}


def test_places_within_groups(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 7 < 6, 'hot', 'cold')) AS g", "id", "id * 7919 % 11 AS score").repartition(5)
    got = {r["id"]: r["place"] for r in sequence.number_groups(rows, ["g"], F.desc("score"), "id").collect()}
    groups = {}
    for i in range(3000):
        groups.setdefault(None if i % 3 == 0 else "hot" if i % 7 < 6 else "cold", []).append(i)
    assert got == {i: p for g in groups.values() for p, i in enumerate(sorted(g, key=lambda i: (-(i * 7919 % 11), i)), 1)}


def test_changed_clusters_by_members(spark):
    before = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "d")], "cluster long, key string")
    after = spark.createDataFrame([(9, "b"), (9, "a"), (9, "a"), (2, "c"), (2, "e"), (5, "d"), (6, "d"), (7, "f")], "cluster long, key string")
    assert sorted(r["cluster"] for r in resolve.changed_clusters(before, after).collect()) == [2, 7]


def test_queries_that_compare_people_find_some(spark):
    for name in ("e3_emails_conflict", "e8_cannot_link", "f12_over_merged", "e2_shared_addresses", "e2b_ambiguous_names", "e10_join_keyless", "l2_tick"):
        assert registry.QUERIES[name](spark, SF).count() > 0, name
    assert {r["profiles"] for r in registry.QUERIES["e8_cannot_link"](spark, SF).collect()} == {1}
    actions = {r["action"] for n in ("l1_due", "l1b_due_later") for r in registry.QUERIES[n](spark, "/root/testdata/sf0.01").collect()}
    assert actions == {None, "invite", "email", "fallback_email", "stalled", "halted"}


def test_a_status_comes_with_the_winning_value(spark):
    """The best contribution that holds the winning value and states a status; never one with another value."""
    day = "2024-01-01 00:00:00"
    rows = [
        ("c1", "mail", "s1", "a", 5, 1, day, "r1", False), ("c1", "mail", "s2", "a", 3, 1, day, "r2", False), ("c1", "mail", "s3", "b", 4, 1, day, "r3", False),
        ("c1", "status", "s2", "verified", 3, 1, day, "r2", False), ("c1", "status", "s3", "bad", 9, 1, day, "r3", False),
        ("c2", "mail", "s1", "x", 5, 1, day, "r1", False), ("c2", "status", "s2", "verified", 5, 1, day, "r2", False),
        ("c3", "mail", "s1", "x", 5, 1, day, "r1", True), ("c3", "mail", "s1", "x", 1, 1, day, "r2", False), ("c3", "status", "s1", "echoed", 5, 1, day, "r1", True), ("c3", "status", "s1", "seen", 5, 1, day, "r2", False),
    ]
    df = spark.createDataFrame(rows, "cluster string, path string, source string, value string, trust int, tier int, fetched_at string, raw_path string, echo boolean").withColumn("confidence", F.lit(None).cast("double"))
    got = {tuple(r) for r in resolve.paired_status(df, "mail", "status").collect()}
    assert got == {("c1", "a", "verified"), ("c2", "x", "unknown"), ("c3", "x", "seen")}
