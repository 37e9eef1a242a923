"""Queries of merges as a whole: employments, stored leads, merge logs, decisions of all leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.functions.urls import company_id
from goldweave.operators import assembly as A
from goldweave.operators import graph as G
from goldweave.operators import identity as I
from goldweave.operators import sinks as S
from goldweave.plans.identity import C_SQL, CLUSTER_SQL, KEYS_SQL, contributions
from goldweave.plans.registry import Tables, query
from goldweave.storage import materialize, new_path, read_committed


@query("e6_email_links", f"""WITH {KEYS_SQL}, m AS (SELECT k.id, k.value, c.linkedin IS NULL AS bare FROM keys k JOIN c USING (id) WHERE kind = 2 AND NOT barred),
h AS (SELECT value, min(id) AS u FROM m WHERE bare GROUP BY 1) SELECT h.u, m.id AS v FROM m JOIN h USING (value) WHERE h.u <> m.id""")
def e6(t: Tables) -> DataFrame:
    c = contributions(t)
    return I.email_links(c, I.match_keys(c))


@query("j3_employments", """SELECT l_orderkey, string_agg(l_suppkey || ':' || coalesce(CAST(is_current AS VARCHAR), 'unknown'), ',' ORDER BY l_suppkey) AS employments FROM (SELECT l_orderkey, l_suppkey,
CASE WHEN bool_or(l_returnflag = 'N') THEN true WHEN bool_and(l_returnflag = 'R') THEN false END AS is_current FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def j3(t: Tables) -> DataFrame:
    stated = F.when(F.col("l_returnflag") == "N", True).when(F.col("l_returnflag") == "R", False)
    jobs = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("company"), stated.alias("is_current"))
    e = A.employments(jobs, "l_orderkey", "company")
    text = F.transform("employments", lambda x: F.concat_ws(":", x["company"].cast("string"), F.coalesce(x["is_current"].cast("string"), F.lit("unknown"))))
    return e.select("l_orderkey", F.array_join(text, ",").alias("employments"))


@query("j7_tie_answers_once", """WITH a AS (SELECT user_id AS tie_key, event_type AS answer, event_id, value FROM events), ok AS (SELECT * FROM a WHERE answer IN ('click', 'view'))
SELECT tie_key, arg_min(answer, event_id) AS answer, CASE WHEN tie_key % 3 = 0 THEN 'stored' ELSE 'resolved' END AS source FROM ok GROUP BY 1""")
def j7(t: Tables) -> DataFrame:
    asked = t.events.select(F.col("user_id").alias("tie_key"), F.col("event_type").alias("answer"), F.col("event_id").alias("seq"), (F.col("user_id") % 3 == 0).alias("stored"))
    return A.resolve_ties(asked, ["click", "view"])


@query("j10_company_id_swap", "SELECT l_orderkey, string_agg(CASE WHEN l_suppkey = 7 THEN 'lead-' || l_orderkey ELSE 's' || l_suppkey END, ',' ORDER BY CASE WHEN l_suppkey = 7 THEN 'lead-' || l_orderkey ELSE 's' || l_suppkey END) AS companies FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1")
def j10(t: Tables) -> DataFrame:
    leads = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("c"))
    own = F.concat(F.lit("lead-"), F.col("l_orderkey").cast("string"))
    return leads.select("l_orderkey", F.array_join(F.array_sort(A.swap_company(F.col("c"), F.lit("s7"), own)), ",").alias("companies"))


@query("j11_merge_log", f"""WITH RECURSIVE {CLUSTER_SQL}, ml AS (SELECT cluster, list_sort(list(id)) AS v FROM g GROUP BY 1 HAVING count(*) > 1)
SELECT cluster, array_to_string(v[1:3], ',') AS members, greatest(len(v) - 3, 0)::INTEGER AS omitted FROM ml""")
def j11(t: Tables) -> DataFrame:
    c = contributions(t)
    return A.merge_log(I.clusters(c), "cluster", "id", 3)


@query("j12_stored_leads", """SELECT c_custkey, c_name, coalesce(o.n, 0)::BIGINT AS orders, o.latest, coalesce(o.statuses, '') AS statuses, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN
(SELECT o_custkey, count(*) AS n, max(o_orderdate) AS latest, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey""")
def j12(t: Tables) -> DataFrame:
    side = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("orders"), F.max("o_orderdate").alias("latest"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses")
    )
    base = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    return A.assemble(base, "c_custkey", {"side": side}, {"orders": F.lit(0), "statuses": F.lit("")}).select("c_custkey", "c_name", "orders", "latest", "statuses", "n_name")


@query("k17_decide_all", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'rejected' ELSE 'selected' END AS status, c_acctbal IS NULL AS missing FROM customer""")
def k17(t: Tables) -> DataFrame:
    verdicts = t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "rejected").otherwise("selected").alias("status"))
    return A.one_each(t.customer.select("c_custkey"), verdicts, "c_custkey", "status")


@query("k21_profile_pivot", "SELECT p_brand AS term, string_agg(DISTINCT CASE WHEN p_size <= 10 THEN p_type END, ',' ORDER BY CASE WHEN p_size <= 10 THEN p_type END) AS small, string_agg(DISTINCT CASE WHEN p_size > 40 THEN p_type END, ',' ORDER BY CASE WHEN p_size > 40 THEN p_type END) AS large FROM part GROUP BY 1")
def k21(t: Tables) -> DataFrame:
    source = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") > 40, "large")
    words = t.part.select(F.col("p_brand").alias("term"), source.alias("source"), F.col("p_type").alias("word"))
    return A.to_profile(words, ("small", "large"))


@query("b3_persisted_merge", f"""WITH RECURSIVE {CLUSTER_SQL}, prior AS (SELECT id, person AS lead FROM c WHERE id % 2 = 0), h AS (SELECT lead, count(DISTINCT cluster) AS n, min(cluster) AS cluster FROM prior JOIN g USING (id) GROUP BY 1),
k AS (SELECT cluster, min(lead) AS lead FROM h WHERE n = 1 GROUP BY 1) SELECT g.id, coalesce(k.lead, g.cluster + 1000000) AS lead FROM g LEFT JOIN k USING (cluster)""")
def b3(t: Tables) -> DataFrame:
    c = contributions(t)
    prior = c.filter("id % 2 = 0").select(F.col("id").alias("key"), F.col("person").alias("lead"), F.col("person").alias("seniority"))
    return A.merge_mapping(I.clusters(c).withColumnRenamed("id", "key"), prior, F.col("cluster") + 1000000).withColumnRenamed("key", "id")


@query("b9_new_events", "SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-08') GROUP BY 1, 2")
def b9(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "ts", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("sha"))
    fresh = rows.groupBy("user_id", "event_type", "sha").agg(F.min("event_id").alias("event_id"))
    return S.new_rows(fresh, rows.filter("ts < timestamp_ntz '2024-01-08'"), "sha").select("user_id", "event_type", "event_id")


@query("b10_outbox_lines", """SELECT r_regionkey, '{"to":"' || r_name || '","kind":"invite"}' AS line FROM region""")
def b10(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("to"), F.lit("invite").alias("kind"))).alias("line"))


@query("c43_manifest_faults", """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unlisted' WHEN page_id % 7 = 0 THEN 'dated_ahead' END AS fault FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0""")
def c43(t: Tables) -> DataFrame:
    day = F.when(F.col("page_id") % 7 == 0, "2099-01-01").otherwise("2024-01-01").cast("date")
    files = t.pages.select(F.col("page_id").alias("file"))
    manifest = t.pages.filter("page_id % 5 <> 0").select(F.col("page_id").alias("file"), day.alias("recorded_on"))
    return A.manifest_faults(files, manifest, F.lit("2026-01-01").cast("date")).withColumnRenamed("file", "page_id")


@query("f12b_profile_conflicts", f"WITH {C_SQL} SELECT person, count(DISTINCT linkedin) AS profiles, count(DISTINCT email) AS emails FROM c GROUP BY 1 HAVING count(DISTINCT linkedin) + count(DISTINCT email) > 1")
def f12b(t: Tables) -> DataFrame:
    per = contributions(t).groupBy("person").agg(F.count_distinct("linkedin").alias("profiles"), F.count_distinct("email").alias("emails"))
    return per.filter("profiles + emails > 1")


@query("e11b_company_ids", """WITH RECURSIVE f AS (SELECT c_custkey AS id, c_nationkey || c_mktsegment || CAST(floor(c_acctbal / 500) AS INTEGER) AS d FROM customer), g AS (SELECT d, min(id) AS cluster FROM f GROUP BY 1)
SELECT cluster, 'co-' || substr(sha256(d), 1, 16) AS company_id FROM g""")
def e11b(t: Tables) -> DataFrame:
    place = F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor(F.col("c_acctbal") / 500).cast("int").cast("string"))
    rows = t.customer.select("c_custkey", place.alias("d"))
    labels = G.label_all(rows.select("c_custkey"), "c_custkey", G.star_edges(rows, "c_custkey", "d"), "cluster")
    return rows.join(labels, "c_custkey").groupBy("cluster").agg(company_id(F.collect_set("d")).alias("company_id"))


@query("b3b_committed_merge", f"""WITH RECURSIVE {CLUSTER_SQL}, prior AS (SELECT id, person AS lead FROM c WHERE id % 2 = 0), hp AS (SELECT lead, count(DISTINCT cluster) AS n, min(cluster) AS cluster FROM prior JOIN g USING (id) GROUP BY 1),
kp AS (SELECT cluster, min(lead) AS lead FROM hp WHERE n = 1 GROUP BY 1), mp AS (SELECT g.id, coalesce(kp.lead, g.cluster + (SELECT max(lead) FROM prior) + 1) AS lead FROM g LEFT JOIN kp USING (cluster)),
xi AS (SELECT DISTINCT mp.lead, kind, value FROM keys JOIN mp USING (id) WHERE NOT barred)
SELECT mp.lead, count(*) AS members, min(fetched_at) AS first_seen, max(fetched_at) AS last_seen, (SELECT count(*) FROM xi WHERE xi.lead = mp.lead) AS index_rows FROM mp JOIN c USING (id) GROUP BY 1""")
def b3b(t: Tables) -> DataFrame:
    """A merge stored as one version, and its identities and index as read back."""
    c = contributions(t)
    labels = materialize(I.clusters(c), "labels")
    prior = c.filter("id % 2 = 0").select(F.col("id").alias("key"), F.col("person").alias("lead"), F.col("person").alias("seniority"))
    won = c.join(labels, "id").groupBy("cluster").agg(F.min("name").alias("value")).filter("value is not null").select("cluster", F.lit("name").alias("path"), F.lit("orders").alias("source"), "value")
    root = new_path(t.spark, "merge")
    version = A.persist_merge(A.merge_tables(c, labels, I.match_keys(c), prior, won), root)
    read = lambda name: read_committed(t.spark, root, name, version)
    entries = read("index").groupBy("lead").agg(F.count("*").alias("index_rows"))
    return read("identities").join(entries, "lead", "left").withColumn("index_rows", F.coalesce("index_rows", F.lit(0)))
