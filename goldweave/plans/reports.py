"""Queries of counts, funnels, joins and scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators import reports as P
from goldweave.plans.registry import Tables, query


@query("f1_contributions_per_run", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def f1(t: Tables) -> DataFrame:
    rows = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return P.counts_with_zero(t.customer.select("c_custkey"), rows, "c_custkey")


@query("f2_decision_counts", "SELECT o_orderpriority, count_if(o_orderstatus = 'F')::BIGINT AS selected, count_if(o_orderstatus = 'O')::BIGINT AS rejected, count_if(o_orderstatus = 'P')::BIGINT AS manual_review FROM orders GROUP BY 1")
def f2(t: Tables) -> DataFrame:
    return P.count_kinds(t.orders, "o_orderpriority", "o_orderstatus", {"F": "selected", "O": "rejected", "P": "manual_review"})


@query("f3_decisions_with_events", "SELECT o_orderpriority, count(DISTINCT CASE WHEN l_returnflag IN ('R', 'A') THEN o_orderkey END) AS sent FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def f3(t: Tables) -> DataFrame:
    sent = t.lineitem.filter(F.col("l_returnflag").isin("R", "A")).select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("s", F.lit(1))
    return t.orders.join(sent, "o_orderkey", "left").groupBy("o_orderpriority").agg(F.count("s").alias("sent"))


@query("f4_attachment_counts", "SELECT l_suppkey % 5 AS source, count_if(l_linestatus = 'F')::BIGINT AS attached, count_if(l_linestatus <> 'F')::BIGINT AS unattached FROM lineitem GROUP BY 1")
def f4(t: Tables) -> DataFrame:
    return t.lineitem.groupBy((F.col("l_suppkey") % 5).alias("source")).agg(F.count_if(F.col("l_linestatus") == "F").alias("attached"), F.count_if(F.col("l_linestatus") != "F").alias("unattached"))


@query("f5_ledger_totals", "SELECT user_id, arg_max(k, event_id) AS k, sum(amount) AS amount FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN event_type = 'purchase' AND value > 100 THEN value::DECIMAL(12,2) END AS amount FROM events) GROUP BY 1")
def f5(t: Tables) -> DataFrame:
    paid = F.when((F.col("event_type") == "purchase") & (F.col("value") > 100), F.col("value").cast("decimal(12,2)"))
    rows = t.events.select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), paid.alias("amount"))
    return P.ledger_totals(rows, "user_id", "k", "amount", "event_id").withColumn("amount", F.col("amount").cast("decimal(38,2)"))


@query("f11_max_strength", "SELECT user_id, greatest(coalesce(max(CASE WHEN event_type = 'view' THEN value END), 0), coalesce(max(CASE WHEN event_type = 'error' THEN value END), 0)) AS strength FROM events WHERE value > 40 GROUP BY 1")
def f11(t: Tables) -> DataFrame:
    best = lambda k: F.coalesce(F.max(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0))
    return t.events.filter("value > 40").groupBy("user_id").agg(F.greatest(best("view"), best("error")).alias("strength"))


@query("f13_scorecard", """WITH x AS (SELECT lang, quality = 1 AS e, n_chars > 1500 AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count_if(e AND p)::BIGINT AS tp, count_if(NOT e AND p)::BIGINT AS fp, count_if(e AND NOT p)::BIGINT AS fn, count_if(NOT e AND NOT p)::BIGINT AS tn FROM x GROUP BY 1)
SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, (2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1 FROM c""")
def f13(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    return P.scorecard(rows, "lang", F.col("quality") == 1, F.col("n_chars") > 1500)


@query("f14_outcome_breakdown", """WITH n AS (SELECT o_orderpriority AS wanted, got, count(*) AS n FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN '1-URGENT' ELSE o_orderpriority END AS got FROM orders) GROUP BY 1, 2)
SELECT wanted, sum(CASE WHEN wanted = got THEN n ELSE 0 END)::BIGINT AS right, coalesce(string_agg(got || ':' || n, ',' ORDER BY got || ':' || n) FILTER (WHERE wanted <> got), '') AS wrong FROM n GROUP BY 1""")
def f14(t: Tables) -> DataFrame:
    got = F.when(F.col("o_orderstatus") == "P", "1-URGENT").otherwise(F.col("o_orderpriority"))
    return P.breakdown(t.orders.select(F.col("o_orderpriority").alias("wanted"), got.alias("got")), "wanted", "got")


@query("f15_scenario_tally", "SELECT o_orderpriority, count_if(x)::BIGINT AS passed, count_if(NOT x)::BIGINT AS failed, count_if(x IS NULL)::BIGINT AS skipped FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS x FROM orders) GROUP BY 1")
def f15(t: Tables) -> DataFrame:
    return P.tally(t.orders, "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"))


@query("f16_classifier_accuracy", "SELECT toxic, count(*) AS n, count_if(quality = toxic)::BIGINT AS right FROM labels GROUP BY 1")
def f16(t: Tables) -> DataFrame:
    return t.labels.groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("right"))


@query("f18_exit_code", "SELECT user_id, CASE WHEN bool_or(value > 150) THEN 0 ELSE 1 END AS exit_code FROM events GROUP BY 1")
def f18(t: Tables) -> DataFrame:
    return P.exit_codes(t.events, "user_id", F.col("value") > 150)


@query("f19_log_cap", "WITH s AS (SELECT c_nationkey, list_sort(list_distinct(list(c_name))) AS v FROM customer GROUP BY 1) SELECT c_nationkey, array_to_string(v[1:20], ',') AS first, greatest(len(v) - 20, 0)::INTEGER AS omitted FROM s")
def f19(t: Tables) -> DataFrame:
    return P.capped(t.customer, "c_nationkey", "c_name", 20)


@query("e16_inner_joins", "SELECT n_name, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(38,2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def e16(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    rows = per.join(t.customer, per.o_custkey == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.sum("n").alias("orders"), F.sum("s").cast("decimal(38,2)").alias("total"))


@query("e17_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def e17(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("e18_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
def e18(t: Tables) -> DataFrame:
    big = t.orders.filter("o_totalprice > 400000").select("o_custkey", "o_orderkey")
    return t.customer.select("c_custkey").join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("e19_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def e19(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("e24_whole_lead_check", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 7 = 0) AND l_suppkey % 7 <> 0")
def e24(t: Tables) -> DataFrame:
    given = t.lineitem.filter("l_suppkey % 7 = 0").select("l_orderkey")
    return t.lineitem.filter("l_suppkey % 7 <> 0").select("l_orderkey").join(given, "l_orderkey", "left_semi").distinct()


@query("e25_answer_key_match", "SELECT c_custkey, min(o) AS expected FROM (SELECT c_custkey, c_custkey AS o FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, s_suppkey + 100000 FROM customer JOIN supplier ON c_acctbal::INTEGER % 50 = s_acctbal::INTEGER % 50 AND c_nationkey = s_nationkey) GROUP BY 1")
def e25(t: Tables) -> DataFrame:
    by_profile = t.customer.filter("c_custkey % 3 = 0").select("c_custkey", F.col("c_custkey").alias("o"))
    key = lambda b: F.bround(F.col(b)).cast("int") % 50
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("n"), key("c_acctbal").alias("k"))
    s = t.supplier.select((F.col("s_suppkey") + 100000).alias("o"), F.col("s_nationkey").alias("n"), key("s_acctbal").alias("k"))
    return by_profile.unionByName(c.join(s, ["n", "k"]).select("c_custkey", "o")).groupBy("c_custkey").agg(F.min("o").alias("expected"))


@query("e26_current_employer", "SELECT l_orderkey, arg_min(l_suppkey, (CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 100 ELSE 200 END + l_linenumber, l_suppkey)) AS employer FROM lineitem GROUP BY 1")
def e26(t: Tables) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 100).otherwise(200) + F.col("l_linenumber")
    return t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct(rank, "l_suppkey")).alias("employer"))


@query("e27_company_key_groups", "SELECT coalesce(nullif(regexp_replace(CASE WHEN c_custkey % 3 = 0 THEN 'www.D' || c_nationkey || '.example' WHEN c_custkey % 3 = 1 THEN 'd' || c_nationkey || '.example' END, '^www\\.', ''), ''), lower(c_mktsegment)) AS company_key, count(*) AS leads FROM (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer) GROUP BY 1".replace("'www.D'", "'www.d'"))
def e27(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 3
    domain = F.when(k == 0, F.concat(F.lit("www.d"), F.col("c_nationkey").cast("string"), F.lit(".example"))).when(k == 1, F.concat(F.lit("d"), F.col("c_nationkey").cast("string"), F.lit(".example")))
    key = F.coalesce(F.regexp_replace(domain, r"^www\.", ""), F.lower("c_mktsegment"))
    return t.customer.groupBy(key.alias("company_key")).agg(F.count("*").alias("leads"))


@query("e33_work_list", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INTEGER AS place FROM lineitem WHERE l_returnflag = 'N'")
def e33(t: Tables) -> DataFrame:
    order = F.array_sort(F.collect_list("l_linenumber"))
    rows = t.lineitem.filter("l_returnflag = 'N'").groupBy("l_orderkey").agg(order.alias("o"))
    return rows.select("l_orderkey", F.posexplode("o").alias("p", "l_linenumber")).select("l_orderkey", "l_linenumber", (F.col("p") + 1).alias("place"))


@query("b11_json_lines", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def b11(t: Tables) -> DataFrame:
    return P.to_lines(t.nation, "n_nationkey")


@query("d1_active_leads", "SELECT p_partkey FROM part WHERE nullif(p_size % 5, 0) IS NULL")
def d1(t: Tables) -> DataFrame:
    retired = F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 5)
    return t.part.filter(retired.isNull()).select("p_partkey")


@query("d2_leads_of_company", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 7")
def d2(t: Tables) -> DataFrame:
    return P.leads_of_company(t.lineitem, "l_orderkey", "l_suppkey", 7)


@query("d4_plan_match", "SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type IN ('signup', 'purchase') AND value > 110) OR bool_or(contains(event_type, 'err') AND value > 130)")
def d4(t: Tables) -> DataFrame:
    of = lambda x: F.collect_set(F.when(x, F.col("event_type")))
    sets = t.events.groupBy("user_id").agg(of(F.col("value") > 110).alias("w"), of(F.col("value") > 130).alias("u"))
    return sets.filter(F.arrays_overlap("w", F.array(F.lit("signup"), F.lit("purchase"))) | F.exists("u", lambda x: F.contains(x, F.lit("err")))).select("user_id")


@query("d6_attached_evidence", "SELECT DISTINCT a.page_id FROM pages a WHERE a.page_id % 4 = 0 AND split_part(split_part(a.url, '//', 2), '/', 1) IN (SELECT split_part(split_part(url, '//', 2), '/', 1) FROM pages WHERE page_id % 9 = 0)")
def d6(t: Tables) -> DataFrame:
    from goldweave.functions.urls import host

    named = t.pages.select("page_id", host(F.col("url")).alias("h"))
    return named.filter("page_id % 4 = 0").join(named.filter("page_id % 9 = 0").select("h"), "h", "left_semi").select("page_id")


@query("d10_stale_projections", "SELECT p_partkey, p_size AS version FROM part WHERE p_size <> 20 AND p_partkey % 3 = 0")
def d10(t: Tables) -> DataFrame:
    return t.part.filter("p_size <> 20 and p_partkey % 3 = 0").select("p_partkey", F.col("p_size").alias("version"))


@query("d12_unrecognised_identifiers", "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)")
def d12(t: Tables) -> DataFrame:
    return t.part.select("p_brand").distinct().join(t.part.filter("p_size > 48").select("p_brand"), "p_brand", "left_anti")


@query("d11_send_capable", "SELECT url, bool_or(contains(lower(url), '/fr/')) AS flagged FROM pages GROUP BY 1")
def d11(t: Tables) -> DataFrame:
    words = F.filter(F.split(F.lower("url"), "[^a-z]+"), lambda w: w != "")
    return t.pages.select("url", F.arrays_overlap(words, F.array(F.lit("fr"))).alias("flagged")).groupBy("url").agg(F.bool_or("flagged").alias("flagged"))
