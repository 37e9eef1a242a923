"""Queries of conflict resolution, election, projection and lead assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators import resolve as R
from goldweave.plans.registry import Tables, query

# Candidates made of line items: an order is a cluster, its two flags are paths.
CAND_SQL = """cand AS (SELECT l_orderkey AS cluster, x.path, 's' || CAST(l_suppkey % 5 AS {s}) AS source, x.value, CAST(5 - l_suppkey % 5 - l_suppkey % 2 AS INT) AS trust,
  CAST(l_linenumber % 3 AS INT) AS tier, CASE WHEN l_discount > 0 THEN l_discount * 10 END AS confidence, l_shipdate AS fetched_at,
  'p' || CAST(l_partkey AS {s}) || '.' || CAST(l_linenumber AS {s}) AS raw_path, l_linenumber % 4 = 1 AS echo
  FROM lineitem, {lateral})"""
CAND_DUCK = CAND_SQL.format(s="VARCHAR", lateral="LATERAL (VALUES ('returnflag', l_returnflag), ('linestatus', l_linestatus)) x(path, value)")
ORDER_SQL = "-trust, -tier, -coalesce(confidence, 0), -epoch_us(fetched_at), source, sha256(value), raw_path"
RANKED_SQL = f"""{CAND_DUCK}, ranked AS (SELECT *, row_number() OVER w AS rank, first_value(value) OVER w AS winning_value FROM cand WINDOW w AS (PARTITION BY cluster, path ORDER BY {ORDER_SQL})),
roles AS (SELECT *, CASE WHEN rank = 1 THEN 'winner' WHEN value = winning_value THEN 'agreeing' ELSE 'superseded' END AS role FROM ranked)"""


def candidates(t: Tables) -> DataFrame:
    k = F.col("l_suppkey") % 5
    paths = F.array(F.struct(F.lit("returnflag").alias("path"), F.col("l_returnflag").alias("value")), F.struct(F.lit("linestatus").alias("path"), F.col("l_linestatus").alias("value")))
    return t.lineitem.select(
        F.col("l_orderkey").alias("cluster"), F.inline(paths), F.concat(F.lit("s"), k.cast("string")).alias("source"),
        (5 - k - F.col("l_suppkey") % 2).cast("int").alias("trust"), (F.col("l_linenumber") % 3).cast("int").alias("tier"),
        F.when(F.col("l_discount") > 0, F.col("l_discount") * 10).alias("confidence"), F.col("l_shipdate").alias("fetched_at"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("raw_path"),
        (F.col("l_linenumber") % 4 == 1).alias("echo"),
    )


@query("g1_conflict_winner", f"WITH {RANKED_SQL} SELECT cluster, path, source, value FROM ranked WHERE rank = 1")
def g1(t: Tables) -> DataFrame:
    return R.winners(candidates(t))


@query("g1b_candidate_ranks", f"WITH {RANKED_SQL} SELECT cluster, path, raw_path, CAST(rank AS INTEGER) AS rank FROM ranked")
def g1b(t: Tables) -> DataFrame:
    return R.rank_candidates(candidates(t)).select("cluster", "path", "raw_path", "rank")


@query("g2_agreeing_superseded", f"WITH {RANKED_SQL} SELECT cluster, path, raw_path, role FROM roles")
def g2(t: Tables) -> DataFrame:
    return R.rank_candidates(candidates(t)).select("cluster", "path", "raw_path", "role")


@query("g3_decided_by", f"""WITH {RANKED_SQL}, w AS (SELECT * FROM roles WHERE role = 'winner'), l AS (SELECT *, row_number() OVER (PARTITION BY cluster, path ORDER BY rank) AS rn FROM roles WHERE role = 'superseded')
SELECT w.cluster, w.path, CASE WHEN l.cluster IS NULL THEN NULL WHEN w.trust <> l.trust THEN 'trust' WHEN w.tier <> l.tier THEN 'origin' WHEN coalesce(w.confidence, 0) <> coalesce(l.confidence, 0) THEN 'confidence'
 WHEN w.fetched_at <> l.fetched_at THEN 'recency' WHEN w.source <> l.source THEN 'source' ELSE 'value_hash' END AS decided_by FROM w LEFT JOIN l ON w.cluster = l.cluster AND w.path = l.path AND l.rn = 1""")
def g3(t: Tables) -> DataFrame:
    return R.decided_by(R.rank_candidates(candidates(t)))


@query("g4_flagged_first", f"""WITH {RANKED_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY cluster, path ORDER BY (value IN ('R', 'F')) DESC, rank) AS r2 FROM ranked) SELECT cluster, path, source, value FROM f WHERE r2 = 1""")
def g4(t: Tables) -> DataFrame:
    moved = R.flagged_first(R.rank_candidates(candidates(t)), F.col("value").isin("R", "F"))
    return moved.filter("rank = 1").select("cluster", "path", "source", "value")


@query("e14_echo_precedence", f"""WITH {CAND_DUCK}, o AS (SELECT * FROM (SELECT *, bool_or(NOT echo) OVER (PARTITION BY cluster, path) AS seen FROM cand) WHERE NOT seen OR NOT echo),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster, path ORDER BY {ORDER_SQL}) AS rank FROM o) SELECT cluster, path, raw_path, value FROM r WHERE rank = 1""")
def e14(t: Tables) -> DataFrame:
    return R.rank_candidates(R.observed_first(candidates(t))).filter("rank = 1").select("cluster", "path", "raw_path", "value")


@query("g6_paired_status", f"""WITH {CAND_DUCK}, m AS MATERIALIZED (SELECT * FROM cand WHERE NOT (path = 'linestatus' AND cluster % 3 = 0 AND tier = 2)),
o AS MATERIALIZED (SELECT * FROM (SELECT *, bool_or(NOT echo) OVER (PARTITION BY cluster, path) AS seen FROM m) WHERE NOT seen OR NOT echo),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {ORDER_SQL}) AS rank FROM o WHERE path = 'returnflag'), w AS (SELECT cluster, value FROM r WHERE rank = 1),
p AS (SELECT r.cluster, arg_min(s.value, (r.rank, s.value)) AS status FROM r JOIN w USING (cluster, value) JOIN (SELECT cluster, source, raw_path, fetched_at, value FROM o WHERE path = 'linestatus') s USING (cluster, source, raw_path, fetched_at) GROUP BY 1)
SELECT w.cluster, w.value AS returnflag, coalesce(p.status, 'unknown') AS linestatus FROM w LEFT JOIN p USING (cluster)""")
def g6(t: Tables) -> DataFrame:
    silent = (F.col("path") == "linestatus") & (F.col("cluster") % 3 == 0) & (F.col("tier") == 2)  # contributions without a status
    return R.paired_status(candidates(t).filter(~silent), "returnflag", "linestatus").select("cluster", F.col("value").alias("returnflag"), F.col("status").alias("linestatus"))


@query("f6_agreeing_sources", f"WITH {RANKED_SQL} SELECT cluster, path, count(DISTINCT CASE WHEN role <> 'superseded' THEN source END) AS agreeing_sources FROM roles GROUP BY 1, 2")
def f6(t: Tables) -> DataFrame:
    return R.agreement(R.rank_candidates(candidates(t)))


@query("f10_source_agreement", f"""WITH {RANKED_SQL}, a AS (SELECT cluster, path, count(DISTINCT CASE WHEN role <> 'superseded' THEN source END) AS n FROM roles GROUP BY 1, 2), s AS (SELECT cluster, count(DISTINCT source) AS sources FROM cand GROUP BY 1)
SELECT cluster, CASE WHEN max(sources) < 2 THEN 0::DOUBLE ELSE avg(CASE WHEN n >= 2 THEN 1.0::DOUBLE ELSE 0 END) END AS share FROM a JOIN s USING (cluster) GROUP BY 1""")
def f10(t: Tables) -> DataFrame:
    c = candidates(t)
    sources = c.groupBy("cluster").agg(F.count_distinct("source").alias("sources"))
    share = F.avg(F.when(F.col("agreeing_sources") >= 2, 1.0).otherwise(0.0))
    return R.agreement(R.rank_candidates(c)).join(sources, "cluster").groupBy("cluster").agg(F.when(F.max("sources") < 2, 0.0).otherwise(share).alias("share"))


VOTES_SQL = "SELECT l_orderkey, l_returnflag, sum(w) AS w FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag, l_suppkey % 4 + 1 AS w FROM lineitem) GROUP BY 1, 2"


@query("f7_weighted_election", f"""WITH v AS ({VOTES_SQL}), b AS (SELECT *, max(w) OVER (PARTITION BY l_orderkey) AS top FROM v),
l AS (SELECT l_orderkey, list_sort(list(l_returnflag)) AS c FROM b WHERE w = top GROUP BY 1)
SELECT l_orderkey, c[1] AS l_returnflag, len(c) > 1 AS tied, CASE WHEN len(c) > 1 THEN array_to_string(c, ',') ELSE '' END AS tied_choices FROM l""")
def f7(t: Tables) -> DataFrame:
    return R.elect(t.lineitem, "l_orderkey", "l_suppkey", "l_returnflag", F.col("l_suppkey") % 4 + 1)


@query("j6_tie_outcome", f"""WITH v AS ({VOTES_SQL}), b AS (SELECT *, max(w) OVER (PARTITION BY l_orderkey) AS top FROM v), l AS (SELECT l_orderkey, list_sort(list(l_returnflag)) AS c FROM b WHERE w = top GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(c) = 1 THEN c[1] WHEN l_orderkey % 3 = 0 THEN c[len(c)] ELSE c[1] END AS domain, CASE WHEN len(c) = 1 THEN 'elected' WHEN l_orderkey % 3 = 0 THEN 'stored_answer' ELSE 'fallback' END AS outcome FROM l""")
def j6(t: Tables) -> DataFrame:
    won = R.elect(t.lineitem, "l_orderkey", "l_suppkey", "l_returnflag", F.col("l_suppkey") % 4 + 1)
    stored = F.when(F.col("l_orderkey") % 3 == 0, F.element_at(F.split("tied_choices", ","), -1))
    answer = F.when(F.col("tied"), stored)
    how = F.when(~F.col("tied"), "elected").when(answer.isNotNull(), "stored_answer").otherwise("fallback")
    return won.select("l_orderkey", F.coalesce(answer, "l_returnflag").alias("domain"), how.alias("outcome"))


@query("f20_union_signals", "SELECT user_id, event_type, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def f20(t: Tables) -> DataFrame:
    return R.union_signals(t.events, "user_id", "event_type", "value", "event_id")


@query("f9_latest_value", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def f9(t: Tables) -> DataFrame:
    return R.latest(t.events, ["user_id", "event_type"], "value", "ts", "event_id")


@query("j1_golden_record", f"""WITH {RANKED_SQL}, w AS (SELECT * FROM ranked WHERE rank = 1) SELECT cluster, max(CASE WHEN path = 'returnflag' THEN value END) AS returnflag, max(CASE WHEN path = 'linestatus' THEN value END) AS linestatus FROM w GROUP BY 1""")
def j1(t: Tables) -> DataFrame:
    return R.golden_record(R.winners(candidates(t)), "cluster", ["returnflag", "linestatus"], ["returnflag", "linestatus"])


@query("j2_invalid_winner_null", f"""WITH {RANKED_SQL}, w AS (SELECT cluster, path, CASE WHEN value <> 'N' THEN value END AS value FROM ranked WHERE rank = 1 AND path = 'returnflag') SELECT cluster, value AS returnflag FROM w WHERE value IS NOT NULL""")
def j2(t: Tables) -> DataFrame:
    valid = R.winners(candidates(t)).withColumn("value", F.when(F.col("value") != "N", F.col("value")))
    return R.golden_record(valid.filter("path = 'returnflag'"), "cluster", ["returnflag"], ["returnflag"])


@query("j4_role_contacts", """SELECT l_orderkey, array_to_string(list_sort(list_filter(list_distinct(list(l_shipmode_)), lambda x: x <> 'R' )), ',') AS contacts FROM (SELECT l_orderkey, l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY 1""")
def j4(t: Tables) -> DataFrame:
    stated = F.collect_set("l_returnflag")
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.array_except(stated, F.array(F.lit("R")))), ",").alias("contacts"))


@query("j5_compliance_or", "SELECT user_id, bool_or(event_type = 'error' AND value > 450) AS opt_out, bool_or(event_type = 'purchase' AND value > 400) AS suppressed FROM events GROUP BY 1")
def j5(t: Tables) -> DataFrame:
    out = lambda k, v: F.bool_or((F.col("event_type") == k) & (F.col("value") > v))
    return t.events.groupBy("user_id").agg(out("error", 450).alias("opt_out"), out("purchase", 400).alias("suppressed"))


@query("j8_version_stamp", """WITH now AS (SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS fingerprint FROM orders GROUP BY 1),
was AS (SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS f, CAST(o_custkey % 3 + 1 AS INTEGER) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT o_custkey, fingerprint, CASE WHEN f = fingerprint THEN v ELSE coalesce(v, 0) + 1 END AS version FROM now LEFT JOIN was USING (o_custkey)""")
def j8(t: Tables) -> DataFrame:
    def prints(rows: DataFrame) -> DataFrame:
        keys = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",")
        return rows.groupBy("o_custkey").agg(F.sha2(keys, 256).alias("fingerprint"))

    prior = prints(t.orders.filter("o_orderdate < timestamp_ntz '1998-01-01'")).withColumn("version", (F.col("o_custkey") % 3 + 1).cast("int"))
    return R.version_stamp(prints(t.orders), prior, "o_custkey")


SNAP_SQL = """p AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS key, l_suppkey % 50 AS lead FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'),
c AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS key, l_suppkey % 50 + CASE WHEN l_suppkey % 50 < 25 AND l_orderkey % 11 = 0 THEN 100 WHEN l_suppkey % 50 IN (30, 31) THEN 0 ELSE 0 END - CASE WHEN l_suppkey % 50 = 31 THEN 1 ELSE 0 END AS cluster FROM lineitem)"""


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lead = F.col("l_suppkey") % 50
    prior = t.lineitem.filter("l_shipdate < timestamp_ntz '1999-01-01'").select(key.alias("key"), lead.alias("lead"), lead.alias("seniority")).distinct()
    split = F.when((lead < 25) & (F.col("l_orderkey") % 11 == 0), 100).otherwise(0) - F.when(lead == 31, 1).otherwise(0)
    return t.lineitem.select(key.alias("key"), (lead + split).alias("cluster")).distinct(), prior


@query("e23_assign_leads", f"""WITH {SNAP_SQL}, h AS (SELECT lead, count(DISTINCT cluster) AS n, min(cluster) AS cluster FROM p JOIN c USING (key) GROUP BY 1), k AS (SELECT cluster, min(lead) AS lead FROM h WHERE n = 1 GROUP BY 1)
SELECT DISTINCT c.cluster, k.lead FROM c LEFT JOIN k USING (cluster)""")
def e23(t: Tables) -> DataFrame:
    return R.assign_leads(*snapshots(t))[0]


@query("e23b_retired_leads", f"""WITH {SNAP_SQL}, h AS (SELECT lead, count(DISTINCT cluster) AS n, min(cluster) AS cluster FROM p JOIN c USING (key) GROUP BY 1), k AS (SELECT cluster, min(lead) AS lead FROM h WHERE n = 1 GROUP BY 1)
SELECT DISTINCT p.lead, c.cluster AS successor FROM p JOIN c USING (key) WHERE p.lead NOT IN (SELECT lead FROM k)""")
def e23b(t: Tables) -> DataFrame:
    return R.assign_leads(*snapshots(t))[1]


@query("i3_changed_clusters", """WITH a AS (SELECT l_suppkey AS cluster, list_sort(list_distinct(list(l_orderkey))) AS m FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1), b AS (SELECT l_suppkey AS cluster, list_sort(list_distinct(list(l_orderkey))) AS m FROM lineitem GROUP BY 1)
SELECT cluster FROM b WHERE m NOT IN (SELECT m FROM a)""")
def i3(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("cluster"), "l_shipdate")
    return R.changed_clusters(rows.filter("l_shipdate < timestamp_ntz '1998-06-01'"), rows)


@query("j9_reprojection_reason", """WITH a AS (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS s FROM orders GROUP BY 1)
SELECT b.o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'new' WHEN a.n <> b.n THEN 'members changed' WHEN a.s <> b.s THEN 'reports changed' ELSE 'unchanged' END AS reason FROM b LEFT JOIN a USING (o_custkey)""")
def j9(t: Tables) -> DataFrame:
    per = lambda rows, n, s: rows.groupBy("o_custkey").agg(F.count("*").alias(n), F.max("o_orderstatus").alias(s))
    both = per(t.orders, "n", "s").join(per(t.orders.filter("o_orderdate < timestamp_ntz '1997-01-01'"), "n0", "s0"), "o_custkey", "left")
    reason = F.when(F.col("n0").isNull(), "new").when(F.col("n") != F.col("n0"), "members changed").when(F.col("s") != F.col("s0"), "reports changed").otherwise("unchanged")
    return both.select("o_custkey", reason.alias("reason"))


@query("j13_shared_company_consistency", "SELECT p_brand, count(DISTINCT p_type) AS contents FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def j13(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.count_distinct("p_type").alias("contents")).filter("contents > 1")


@query("i1_union_distinct", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 300000")
def i1(t: Tables) -> DataFrame:
    ids = t.orders.select("o_custkey", "o_orderstatus", "o_totalprice")
    return ids.filter("o_orderstatus = 'F'").union(ids.filter("o_totalprice > 300000")).select("o_custkey").distinct()


@query("i2_set_operations", """WITH s AS (SELECT user_id, list_distinct(list(event_type) FILTER (WHERE value > 250)) AS a, list_distinct(list(event_type) FILTER (WHERE value <= 40)) AS b FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: list_contains(coalesce(b, []), x))), ',') AS both, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS only_a,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS either FROM s""")
def i2(t: Tables) -> DataFrame:
    a, b = (F.collect_set(F.when(x, F.col("event_type"))) for x in (F.col("value") > 250, F.col("value") <= 40))
    s = t.events.groupBy("user_id").agg(a.alias("a"), b.alias("b"))
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return s.select("user_id", text(F.array_intersect("a", "b")).alias("both"), text(F.array_except("a", "b")).alias("only_a"), text(F.array_union("a", "b")).alias("either"))


@query("i5_symmetric_difference", """(SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 0)
UNION ALL (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 0 EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 5000)""")
def i5(t: Tables) -> DataFrame:
    a, b = (t.customer.filter(x).select("c_nationkey", "c_mktsegment").distinct() for x in ("c_acctbal > 5000", "c_acctbal < 0"))
    return a.exceptAll(b).unionByName(b.exceptAll(a))
