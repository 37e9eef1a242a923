"""Queries of sinks and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators import sinks as S
from goldweave.plans.registry import Tables, query

RAW_SQL = "r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'synthetic' ELSE 'live' END AS mode, o_orderdate AS fetched_at FROM orders), u AS (SELECT *, CASE WHEN mode = 'live' THEN fetched_at + INTERVAL 30 DAY END AS until FROM r)"


def raw(t: Tables) -> DataFrame:
    mode = F.when(F.col("o_orderkey") % 4 == 0, "synthetic").otherwise("live")
    rows = t.orders.select("o_orderkey", "o_custkey", mode.alias("mode"), F.col("o_orderdate").alias("fetched_at"))
    return rows.withColumn("until", S.retention_until(F.col("mode"), F.col("fetched_at")))


@query("b1_idempotent_append", "SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 2")
def b1(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))
    batch = rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    return S.new_rows(batch, rows.filter("doc_id % 3 = 0"), "sha").select("doc_id", "sha")


@query("b2_field_rows", "SELECT c_custkey, 'name' AS path, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', nullif(c_mktsegment, 'BUILDING') FROM customer WHERE c_mktsegment <> 'BUILDING'")
def b2(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    return S.to_fields(rows, "c_custkey", ["name", "segment"])


@query("b4_changed_rows", """WITH n AS (SELECT o_custkey, count(*) AS c, max(o_orderstatus) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1), o AS (SELECT o_custkey, count(*) AS c, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01' GROUP BY 1)
SELECT o_custkey, CASE WHEN o.c IS NULL THEN 'inserted' WHEN n.c IS NULL THEN 'removed' ELSE 'updated' END AS change FROM n FULL JOIN o USING (o_custkey) WHERE (n.c, n.s) IS DISTINCT FROM (o.c, o.s)""")
def b4(t: Tables) -> DataFrame:
    per = lambda x: t.orders.filter(x).groupBy("o_custkey").agg(F.count("*").alias("c"), F.max("o_orderstatus").alias("s"))
    return S.changed(per("o_orderdate >= timestamp_ntz '1996-01-01'"), per("o_orderdate < timestamp_ntz '1996-06-01'"), "o_custkey", ["c", "s"])


@query("b5_repointed_mapping", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS lead FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def b5(t: Tables) -> DataFrame:
    old = t.orders.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_custkey").alias("lead"))
    return S.repoint(old, t.orders.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("lead")), "o_orderkey", "lead")


@query("b6_reindexed", "SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 5 <> 0) UNION ALL SELECT DISTINCT user_id, 'k' || event_type FROM events WHERE user_id % 5 = 0")
def b6(t: Tables) -> DataFrame:
    index = t.events.select("user_id", "event_type").distinct()
    fresh = index.filter("user_id % 5 = 0").select("user_id", F.concat(F.lit("k"), "event_type").alias("event_type"))
    return S.reindex(index, fresh, "user_id")


@query("b7_last_write", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def b7(t: Tables) -> DataFrame:
    return S.last_write(t.events, ["user_id", "event_type"], "value", F.col("event_id"))


@query("b8_first_write", "SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def b8(t: Tables) -> DataFrame:
    return S.first_write(t.events, ["user_id"], "event_type", F.col("event_id"))


@query("b13_purge_expired", f"WITH {RAW_SQL} SELECT mode, count_if(until IS NULL OR until > TIMESTAMP '1998-01-01')::BIGINT AS kept, count_if(coalesce(until <= TIMESTAMP '1998-01-01', false))::BIGINT AS purged FROM u GROUP BY 1")
def b13(t: Tables) -> DataFrame:
    kept, gone = S.purge(raw(t), "until", F.expr("timestamp_ntz '1998-01-01'"))
    both = kept.select("mode", F.lit(1).alias("k"), F.lit(0).alias("g")).unionByName(gone.select("mode", F.lit(0).alias("k"), F.lit(1).alias("g")))
    return both.groupBy("mode").agg(F.sum("k").alias("kept"), F.sum("g").alias("purged"))


@query("b13b_detached", f"WITH {RAW_SQL} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN until IS NULL OR until > TIMESTAMP '1998-01-01' OR u.o_orderkey IS NULL THEN l_orderkey END AS raw FROM lineitem LEFT JOIN u ON u.o_orderkey = l_orderkey")
def b13b(t: Tables) -> DataFrame:
    _, gone = S.purge(raw(t), "until", F.expr("timestamp_ntz '1998-01-01'"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("raw"))
    return S.detach(rows, gone.select(F.col("o_orderkey").alias("raw")), "raw").select("l_orderkey", "l_linenumber", "l_partkey", "raw")


@query("b14_retention_stamp", f"WITH {RAW_SQL} SELECT o_orderkey, until FROM u")
def b14(t: Tables) -> DataFrame:
    return raw(t).select("o_orderkey", "until")


@query("c44_violations", "SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey > 20 THEN 'segment_nation' END], lambda x: x IS NOT NULL), ',') AS codes FROM customer WHERE c_acctbal < 0 OR (c_mktsegment = 'BUILDING' AND c_nationkey > 20)")
def c44(t: Tables) -> DataFrame:
    checks = {"negative_balance": F.col("c_acctbal") >= 0, "segment_nation": ~((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") > 20))}
    return S.violations(t.customer, "c_custkey", checks).select("c_custkey", F.array_join("codes", ",").alias("codes"))


@query("a16_stored_log_scan", "SELECT o_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber || ':' || l_returnflag) AS fields FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def a16(t: Tables) -> DataFrame:
    field = F.concat_ws(":", F.col("l_linenumber").cast("string"), "l_returnflag")
    f = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list(field)), ",").alias("fields"))
    return t.orders.select("o_orderkey").join(f, "o_orderkey", "left")


@query("a17_evidence_scan", "SELECT event_id, event_type, ts FROM events WHERE user_id = 7")
def a17(t: Tables) -> DataFrame:
    return t.events.filter("user_id = 7").select("event_id", "event_type", "ts").orderBy("ts", "event_id")


@query("a18_decision_reads", "SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def a18(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer.filter("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "c_name", "o_orderstatus").orderBy("o_orderkey")
