"""Queries of identity resolution and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.functions.urls import company_id
from goldweave.operators import graph as G
from goldweave.operators import identity as I
from goldweave.plans.registry import Tables, query

# Contributions made of orders: profiles, addresses of one or several people (some people have two), names at domains (some change).
CONTRIBUTION_SQL = """SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'linkedin.com/in/p' || CAST(o_custkey AS {s}) END AS linkedin,
  CASE WHEN o_orderkey % 4 <> 3 THEN CASE WHEN o_orderkey % 23 = 0 THEN 'alt' || CAST(o_custkey AS {s}) WHEN o_custkey % 10 = 0 THEN 'q' || CAST(o_custkey % 50 AS {s}) WHEN o_custkey % 31 = 0 THEN 'info' ELSE 'p' || CAST(o_custkey AS {s}) END || '@d' || CAST(o_custkey % 40 AS {s}) || '.example' END AS email,
  o_orderkey % 4 <> 2 AS verified,
  CASE WHEN o_orderkey % 29 = 0 THEN 'maiden ' || CAST(o_custkey % 700 AS {s}) WHEN o_orderkey % 7 <> 0 THEN 'name ' || CAST(o_custkey % 700 AS {s}) END AS name,
  CASE WHEN o_orderkey % 5 <> 4 THEN 'd' || CAST(o_custkey % 40 AS {s}) || '.example' END AS domain,
  o_orderpriority AS title, CASE WHEN o_orderkey % 6 = 1 THEN 'emp' || CAST(o_custkey % 40 AS {s}) END AS employer,
  o_orderdate AS fetched_at, o_custkey AS person FROM orders"""

C_SQL = f"c AS ({CONTRIBUTION_SQL.format(s='VARCHAR')})"
KEYS_SQL = f"""{C_SQL},
shared AS (SELECT email FROM c WHERE email IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) > 1 OR count(DISTINCT linkedin) > 1 OR bool_or(split_part(email, '@', 1) = 'info')),
cand AS (SELECT *, name || chr(31) || domain AS candidate FROM c),
amb AS (SELECT candidate FROM cand WHERE candidate IS NOT NULL GROUP BY 1 HAVING count(DISTINCT linkedin) > 1
  UNION SELECT candidate FROM cand WHERE candidate IS NOT NULL AND linkedin IS NULL AND email IS NOT NULL AND email NOT IN (SELECT email FROM shared) GROUP BY 1
  HAVING count(DISTINCT CASE WHEN verified THEN email END) > 1 OR (count(DISTINCT CASE WHEN verified THEN email END) = 0 AND count(DISTINCT CASE WHEN NOT verified THEN email END) > 1)),
keys AS (SELECT id, 1 AS kind, linkedin AS value, false AS barred FROM c WHERE linkedin IS NOT NULL
  UNION ALL SELECT id, 2, email, email IN (SELECT email FROM shared) FROM c WHERE verified AND email IS NOT NULL
  UNION ALL SELECT id, 3, candidate, candidate IN (SELECT candidate FROM amb) FROM cand WHERE candidate IS NOT NULL)"""
LINKS_SQL = f"""{KEYS_SQL},
l1 AS (SELECT a.id AS u, b.id AS v FROM keys a JOIN keys b USING (kind, value) WHERE kind = 1 AND a.id < b.id),
m AS (SELECT k.id, k.value, c.linkedin IS NULL AS bare FROM keys k JOIN c USING (id) WHERE kind = 2 AND NOT barred),
l2 AS (SELECT h.u, m.id AS v FROM m JOIN (SELECT value, min(id) AS u FROM m WHERE bare GROUP BY 1) h USING (value) WHERE h.u <> m.id),
n AS (SELECT k.id, k.value, c.title, c.employer FROM keys k JOIN c USING (id) WHERE kind = 3 AND NOT barred AND c.linkedin IS NULL),
l3 AS (SELECT a.id AS u, b.id AS v FROM n a JOIN n b USING (value) WHERE a.id < b.id AND (a.title = b.title OR a.employer = b.employer)),
s3 AS (SELECT u, v FROM l3 UNION SELECT v, u FROM l3), """
CLOSURE_SQL = """{name}r(node, label) AS (SELECT id, id FROM c UNION SELECT e.v, r.label FROM {name}r r JOIN {edges} e ON e.u = r.node WHERE r.label < e.v),
{name} AS (SELECT node AS id, min(label) AS cluster FROM {name}r GROUP BY 1)"""
CLUSTER_SQL = f"""{LINKS_SQL}{CLOSURE_SQL.format(name='g3', edges='s3')},
bad AS (SELECT g3.cluster FROM g3 JOIN c USING (id) WHERE email IS NOT NULL AND email NOT IN (SELECT email FROM shared) GROUP BY 1
  HAVING count(DISTINCT CASE WHEN verified THEN email END) > 1 OR (count(DISTINCT CASE WHEN verified THEN email END) = 0 AND count(DISTINCT CASE WHEN NOT verified THEN email END) > 1)),
ok3 AS (SELECT l3.* FROM l3 JOIN g3 ON g3.id = l3.u WHERE g3.cluster NOT IN (SELECT cluster FROM bad)),
alle AS (SELECT u, v FROM l1 UNION SELECT u, v FROM l2 UNION SELECT u, v FROM ok3), sall AS (SELECT u, v FROM alle UNION SELECT v, u FROM alle),
{CLOSURE_SQL.format(name='g', edges='sall')}"""


def contributions(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(CONTRIBUTION_SQL.format(s="STRING"))


@query("e1_match_keys", f"WITH {KEYS_SQL} SELECT id, kind, value, barred FROM keys")
def e1(t: Tables) -> DataFrame:
    return I.match_keys(contributions(t))


@query("e2_shared_addresses", f"WITH {KEYS_SQL} SELECT email FROM shared")
def e2(t: Tables) -> DataFrame:
    return I.shared_addresses(contributions(t))


@query("e2b_ambiguous_names", f"WITH {KEYS_SQL} SELECT candidate FROM amb")
def e2b(t: Tables) -> DataFrame:
    c = contributions(t)
    return I.ambiguous_names(c, I.shared_addresses(c))


@query("e3_emails_conflict", f"""WITH {C_SQL} SELECT person FROM c WHERE email IS NOT NULL GROUP BY 1
HAVING count(DISTINCT CASE WHEN verified THEN email END) > 1 OR (count(DISTINCT CASE WHEN verified THEN email END) = 0 AND count(DISTINCT CASE WHEN NOT verified THEN email END) > 1)""")
def e3(t: Tables) -> DataFrame:
    return I.conflict(contributions(t), "person")


@query("e4_connected_components", """
WITH RECURSIVE c AS (SELECT DISTINCT o_custkey AS id, o_orderdate AS d, o_orderpriority AS p FROM orders),
e AS (SELECT DISTINCT a.id AS u, b.id AS v FROM c a JOIN c b USING (d, p) WHERE a.id <> b.id),
r(node, label) AS (SELECT DISTINCT id, id FROM c UNION SELECT e.v, r.label FROM r JOIN e ON e.u = r.node WHERE r.label < e.v)
SELECT node AS o_custkey, min(label) AS component FROM r GROUP BY 1""")
def e4(t: Tables) -> DataFrame:
    rows = t.orders
    edges = G.star_edges(rows, "o_custkey", "o_orderdate", "o_orderpriority")
    return G.label_all(rows.select("o_custkey").distinct(), "o_custkey", edges)


@query("e5_profile_links", f"""WITH {C_SQL}, h AS (SELECT linkedin, min(id) AS u FROM c WHERE linkedin IS NOT NULL GROUP BY 1) SELECT h.u, c.id AS v FROM c JOIN h USING (linkedin) WHERE c.id <> h.u""")
def e5(t: Tables) -> DataFrame:
    return G.star_edges(contributions(t).filter("linkedin is not null"), "id", "linkedin")


@query("e7_clusters", f"WITH RECURSIVE {CLUSTER_SQL} SELECT id, cluster FROM g")
def e7(t: Tables) -> DataFrame:
    return I.clusters(contributions(t))


@query("e8_cannot_link", f"WITH RECURSIVE {CLUSTER_SQL} SELECT cluster, count(DISTINCT linkedin) AS profiles, count(DISTINCT name) AS names FROM g JOIN c USING (id) GROUP BY 1 HAVING count(linkedin) > 0")
def e8(t: Tables) -> DataFrame:
    """Clusters that hold a profile, and how many: never more than one, however many names and addresses would join them."""
    c = contributions(t)
    sums = c.join(I.clusters(c), "id").groupBy("cluster").agg(F.count_distinct("linkedin").alias("profiles"), F.count_distinct("name").alias("names"))
    return sums.filter("profiles > 0")


@query("e9_cluster_ids", f"""WITH RECURSIVE {CLUSTER_SQL}
SELECT cluster, arg_min(sha256(CAST(id AS VARCHAR)), (fetched_at, CAST(id AS VARCHAR))) AS cluster_id FROM g JOIN c USING (id) GROUP BY 1""")
def e9(t: Tables) -> DataFrame:
    c = contributions(t)
    return I.cluster_ids(c, I.clusters(c), F.col("id").cast("string"))


@query("e10_join_keyless", f"""WITH RECURSIVE {CLUSTER_SQL},
h AS (SELECT person AS record, min(cluster) AS owner, count(DISTINCT cluster) AS owners FROM c JOIN g USING (id) WHERE id IN (SELECT id FROM keys) GROUP BY 1),
loose AS (SELECT id, person AS record FROM c WHERE id NOT IN (SELECT id FROM keys)), least AS (SELECT record, min(id) AS least FROM loose GROUP BY 1)
SELECT g.id, coalesce(CASE WHEN loose.id IS NULL THEN NULL WHEN owners IS NULL THEN least WHEN owners = 1 THEN owner ELSE loose.id END, g.cluster) AS cluster
FROM g LEFT JOIN loose USING (id) LEFT JOIN h USING (record) LEFT JOIN least USING (record)""")
def e10(t: Tables) -> DataFrame:
    c = contributions(t)
    keys = I.match_keys(c)
    return I.join_keyless(c, I.clusters(c), keys, F.col("person"))


@query("e11_company_clusters", """
WITH RECURSIVE f AS (SELECT c_custkey AS id, d FROM customer, (VALUES (0), (1)) x(k), LATERAL (SELECT c_nationkey || c_mktsegment || CAST(floor((c_acctbal + k * 40) / 500) AS INTEGER) AS d)),
e AS (SELECT DISTINCT a.id AS u, b.id AS v FROM f a JOIN f b USING (d) WHERE a.id <> b.id),
r(node, label) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT e.v, r.label FROM r JOIN e ON e.u = r.node WHERE r.label < e.v)
SELECT node AS c_custkey, min(label) AS cluster FROM r GROUP BY 1""")
def e11(t: Tables) -> DataFrame:
    place = [F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor((F.col("c_acctbal") + k * 40) / 500).cast("int").cast("string")) for k in (0, 1)]
    return I.company_clusters(t.customer.select("c_custkey", F.array(*place).alias("d")), "c_custkey", "d")


@query("e12_company_work_list", """
WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS rn FROM customer)
SELECT c_custkey, c_nationkey, c_mktsegment FROM c WHERE rn = 1""")
def e12(t: Tables) -> DataFrame:
    first = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("c_custkey"))
    return first.select("c_custkey", "c_nationkey", "c_mktsegment")


@query("e13_company_anchors", """
SELECT c_nationkey, 'co-' || substr(sha256(array_to_string(list_sort(list_distinct(list(c_mktsegment))), chr(31))), 1, 16) AS company_id, count(DISTINCT CASE WHEN c_acctbal > 0 THEN c_custkey % 5 END) AS sources FROM customer GROUP BY 1""")
def e13(t: Tables) -> DataFrame:
    observed = F.when(F.col("c_acctbal") > 0, F.col("c_custkey") % 5)  # echoes of a request do not corroborate
    return t.customer.groupBy("c_nationkey").agg(company_id(F.collect_set("c_mktsegment")).alias("company_id"), F.count_distinct(observed).alias("sources"))


@query("e15_blocked_identities", f"""WITH {C_SQL}, ids AS (SELECT id, 'l:' || linkedin AS identity FROM c WHERE linkedin IS NOT NULL UNION SELECT id, 'e:' || email FROM c WHERE email IS NOT NULL),
f AS (SELECT id, 'opt_out' AS flag, CAST(id % 3 AS VARCHAR) AS source FROM c WHERE id % 40 = 0), b AS (SELECT DISTINCT identity, flag, source FROM ids JOIN f USING (id))
SELECT DISTINCT ids.id, flag, source FROM ids JOIN b USING (identity)""")
def e15(t: Tables) -> DataFrame:
    c = contributions(t)
    return I.blocked_identities(c, c.filter("id % 40 = 0").select("id", F.lit("opt_out").alias("flag"), (F.col("id") % 3).cast("string").alias("source")))


@query("d3_prune_flagged", f"WITH RECURSIVE {CLUSTER_SQL} SELECT id, person FROM c JOIN g USING (id) WHERE cluster NOT IN (SELECT cluster FROM g WHERE id % 40 = 0)")
def d3(t: Tables) -> DataFrame:
    c = contributions(t)
    return I.prune_flagged(c, I.clusters(c), c.filter("id % 40 = 0")).select("id", "person")


@query("d13_unambiguous_questions", f"WITH {C_SQL} SELECT id, email FROM c WHERE email IN (SELECT email FROM c GROUP BY 1 HAVING count(DISTINCT person) <= 1)")
def d13(t: Tables) -> DataFrame:
    return I.unambiguous(contributions(t).filter("email is not null"), "email", "person").select("id", "email")


@query("f12_over_merged", f"WITH RECURSIVE {CLUSTER_SQL} SELECT cluster, count(DISTINCT name) AS names FROM g JOIN c USING (id) GROUP BY 1 HAVING count(DISTINCT name) > 1")
def f12(t: Tables) -> DataFrame:
    c = contributions(t)
    return I.over_merged(c, I.clusters(c))


@query("e20_all_keys_match", "SELECT user_id AS lead FROM events WHERE event_type IN ('signup', 'error', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def e20(t: Tables) -> DataFrame:
    wanted = t.spark.sql("SELECT explode(array('signup', 'error', 'purchase')) AS key")
    return I.all_keys_match(t.events.select(F.col("user_id").alias("lead"), F.col("event_type").alias("key")), wanted)


WALK_SQL = """WITH RECURSIVE s AS (SELECT p_partkey AS node, p_partkey * 2 AS next FROM part WHERE p_partkey * 2 <= (SELECT max(p_partkey) FROM part) UNION SELECT p_partkey, p_partkey - 7 FROM part WHERE p_partkey % 5 = 0 AND p_partkey > 7),
a AS (SELECT p_partkey AS node FROM part WHERE p_size % 4 = 0),
w(start, node) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT w.start, s.next FROM w JOIN s ON s.node = w.node WHERE w.node NOT IN (SELECT node FROM a)),
f AS (SELECT start, node AS active FROM w WHERE node IN (SELECT node FROM a))"""


def walked(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("node"), "p_size")
    top = p.agg(F.max("node").alias("top"))
    doubled = p.join(F.broadcast(top)).filter("node * 2 <= top").select("node", (F.col("node") * 2).alias("next"))
    steps = doubled.unionByName(p.filter("node % 5 = 0 and node > 7").select("node", (F.col("node") - 7).alias("next"))).distinct()
    return G.walk_to_active(p.select("node"), steps, p.filter("p_size % 4 = 0").select("node"))


@query("e21_active_successor", f"{WALK_SQL} SELECT start, active FROM f")
def e21(t: Tables) -> DataFrame:
    return walked(t)


@query("e21b_sole_successor", f"""{WALK_SQL}, n AS (SELECT start, count(*) AS n, min(active) AS active FROM f GROUP BY 1)
SELECT p_partkey AS start, CASE WHEN n = 1 THEN active END AS active, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'several' END AS problem FROM part LEFT JOIN n ON n.start = p_partkey""")
def e21b(t: Tables) -> DataFrame:
    return G.sole_active(t.part.select(F.col("p_partkey").alias("node")), walked(t))


@query("e22_successors", "SELECT p_size AS lead, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS successors FROM part GROUP BY 1")
def e22(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_size").alias("lead")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("successors"))


@query("e32_strong_person_labels", f"""WITH RECURSIVE {KEYS_SQL}, st AS (SELECT id, kind, value FROM keys WHERE kind < 3 AND NOT barred),
e AS (SELECT DISTINCT a.id AS u, b.id AS v FROM st a JOIN st b USING (kind, value) WHERE a.id <> b.id),
r(node, label) AS (SELECT id, id FROM c UNION SELECT e.v, r.label FROM r JOIN e ON e.u = r.node WHERE r.label < e.v), g AS (SELECT node AS id, min(label) AS person FROM r GROUP BY 1)
SELECT g.person, min(c.linkedin) AS linkedin FROM g JOIN c USING (id) GROUP BY 1 HAVING count(DISTINCT c.linkedin) = 1""")
def e32(t: Tables) -> DataFrame:
    c = contributions(t).drop("person")
    strong = I.match_keys(c).filter("kind < 3 and not barred")
    people = G.label_all(c, "id", G.star_edges(strong, "id", "kind", "value"), "person")
    one = people.groupBy("person").agg(F.count_distinct("linkedin").alias("n"), F.min("linkedin").alias("linkedin"))
    return one.filter("n = 1").select("person", "linkedin")
