"""Queries of provider scans, lookups, catalogues and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.functions.urls import dedupe_key
from goldweave.operators import enrich as E
from goldweave.operators.sequence import number_all
from goldweave.plans.registry import Tables, query
from goldweave.sources import catalog as K
from goldweave.sources import contract as C
from goldweave.sources import fixtures as X
from goldweave.sources import robots as B
from goldweave.sources import synthetic as Y


@query("a2_source_order", "SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey DESC, s_name)::INTEGER AS place FROM supplier")
def a2(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    return number_all(rows, F.desc("s_nationkey"), "s_name").select("s_suppkey", "place")


@query("a3_people_search", "SELECT user_id, min(event_id) AS event_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS terms FROM events WHERE event_type IN ('click', 'signup', 'view') GROUP BY 1")
def a3(t: Tables) -> DataFrame:
    hits = t.events.filter(F.col("event_type").isin("click", "signup", "view"))
    return E.union_of_hits(hits, "user_id", "event_type", "event_id")


@query("a3b_pages_until_short", """WITH e AS (SELECT user_id AS ask, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 + 1)::INTEGER AS page FROM events),
p AS (SELECT ask, page, count(*) FILTER (WHERE event_id % 37 <> 0) AS found FROM e GROUP BY 1, 2), s AS (SELECT ask, min(CASE WHEN found < 10 THEN page END) AS short FROM p GROUP BY 1)
SELECT p.ask, p.page, p.found FROM p JOIN s USING (ask) WHERE p.page <= coalesce(short, 100)""")
def a3b(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t.events.select(F.col("user_id").alias("ask"), F.when(F.col("event_id") % 37 != 0, F.col("event_id")).alias("hit"), (F.floor((place - 1) / 10) + 1).cast("int").alias("page"))
    pages = rows.groupBy("ask", "page").agg(F.collect_list("hit").alias("hits"))
    return E.until_short_page(pages, "ask", "page", "hits", 10).select("ask", "page", F.size("hits").cast("long").alias("found"))


@query("a4_lookup_ladder", """WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS id, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey END AS linkedin, c_mktsegment AS email FROM customer)
SELECT c_custkey, CASE WHEN id % 2 = 0 THEN 'id' WHEN linkedin < 15 THEN 'linkedin' ELSE 'email' END AS rung, CASE WHEN id % 2 = 0 THEN 'i' || id WHEN linkedin < 15 THEN 'l' || linkedin ELSE 'e' || email END AS answer FROM p WHERE id % 2 = 0 OR linkedin < 15 OR email IN ('BUILDING', 'MACHINERY')""")
def a4(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    people = t.customer.select("c_custkey", F.when(k % 3 == 0, k).alias("id"), F.when(k % 4 == 0, F.col("c_nationkey")).alias("linkedin"), F.col("c_mktsegment").alias("email"))
    row = lambda rung, v: (F.lit(rung).alias("rung"), v.cast("string").alias("value"), F.concat(F.lit(rung[0]), v.cast("string")).alias("answer"))
    answers = t.customer.filter("c_custkey % 2 = 0").select(*row("id", k)).unionByName(t.nation.filter("n_nationkey < 15").select(*row("linkedin", F.col("n_nationkey"))))
    mails = t.customer.select("c_mktsegment").distinct().filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(*row("email", F.col("c_mktsegment")))
    return E.ladder(people, "c_custkey", answers.unionByName(mails), ("id", "linkedin", "email"))


@query("a5_open_deals", "SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS open_deals FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a5(t: Tables) -> DataFrame:
    deals = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", "false").otherwise("true").alias("closed"))
    return E.open_deals(t.customer, deals, "c_custkey")


@query("a6_email_routing", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'verifier' WHEN c_custkey % 4 <> 0 AND c_nationkey > 5 THEN 'finder' WHEN c_nationkey > 5 THEN 'domain_search' END AS route FROM customer")
def a6(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    domain = F.when(F.col("c_nationkey") > 5, "d.example")
    return t.customer.select("c_custkey", E.route(F.when(k % 3 == 0, "x@d.example"), F.when(k % 4 != 0, F.col("c_name")), domain).alias("route"))


@query("a7_anchored_results", r"""WITH d AS (SELECT page_id % 3 AS term, lower(regexp_extract(url, '^(?:[a-z]+:)?//([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^(?:[a-z]+:)?//[^/?#]*([^?#]*)', 1), '/+$', '')
  || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END AS k, min(page_id) AS page_id FROM pages GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY page_id) AS place FROM d)
SELECT term, k, page_id, place::INTEGER AS place FROM r WHERE place <= 40""")
def a7(t: Tables) -> DataFrame:
    found = t.pages.select((F.col("page_id") % 3).alias("term"), dedupe_key(F.col("url")).alias("k"), "page_id")
    return E.anchored(found, ["term"], ["page_id"], "k", 40)


@query("a15_technology_uids", "SELECT p_partkey, replace(replace(lower(trim(p_type || ' v1.2')), ' ', '_'), '.', '_') AS uid FROM part")
def a15(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.technology_uid(F.concat("p_type", F.lit(" v1.2 "))).alias("uid"))


@query("a19_organic_results", "SELECT page_id, trim(url) AS link FROM pages WHERE trim(url) <> '' AND page_id % 5 <> 0")
def a19(t: Tables) -> DataFrame:
    link = F.when(F.col("page_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    serp = t.pages.select("page_id", F.array(F.struct(link.alias("link"))).alias("organic_results"))
    return serp.select("page_id", F.inline("organic_results")).select("page_id", F.trim("link").alias("link")).filter("link <> ''")


class EventSource(C.Source):
    """Signals of companies as a source: what it declares, and its two DataFrame functions."""

    name, capabilities, cost_class, charge_unit = "events", frozenset({"signals"}), "paid", "record"
    surfaces = {"target.astra": frozenset({"event_type"}), "signal.strength": frozenset({"payload.k"})}
    vocabulary = {"astra": ("click", "view")}
    endpoints = {"signals": C.Endpoint("GET", "/v1/signals")}
    rates = (C.Bucket(60, 60.0),)

    def fetch_raw(self, spark, asks):
        return asks.select("event_id", "event_type", F.from_json("props", "k int").alias("payload"))

    def normalize(self, raw):
        return X.to_contributions(raw, "event_id", RULES)


@query("a1_source_contributions", """SELECT 'events' AS source, 'paid' AS cost_class, 'signal.strength' AS path, count(*) AS n FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT 'events', 'paid', 'signal.kind', count(*) FROM events WHERE event_type = 'click'""")
def a1(t: Tables) -> DataFrame:
    """What a source that is asked in its own vocabulary contributes, by path."""
    source = EventSource()
    asks = t.events.filter(F.col("event_type").isin(*source.vocabulary["astra"]))
    counts = source.normalize(source.fetch_raw(t.spark, asks)).groupBy("path").agg(F.count("*").alias("n"))
    return counts.select(F.lit(source.name).alias("source"), F.lit(source.cost_class).alias("cost_class"), "path", "n")


RULES = [X.FieldRule("payload.k", "signal.strength"), X.FieldRule("event_type", "signal.kind", lambda c: F.when(c != "view", c))]


@query("c1_field_mapping", """SELECT event_id, 'signal.strength' AS path, json_extract_string(props, '$.k') AS value, 'payload.k' AS raw_path FROM events UNION ALL SELECT event_id, 'signal.kind', event_type, 'event_type' FROM events WHERE event_type <> 'view'""")
def c1(t: Tables) -> DataFrame:
    raw = t.events.select("event_id", "event_type", F.from_json("props", "k int").alias("payload"))
    return X.to_contributions(raw, "event_id", RULES)


@query("d16_absences", "SELECT event_id, 'signal.kind' AS path, 'not_applicable' AS kind FROM events UNION ALL SELECT event_id, 'signal.strength', 'negative_evidence' FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0")
def d16(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    raw = t.events.select("event_id", "event_type", F.struct(F.when(k % 10 != 0, k).alias("k")).alias("payload"))
    return X.absences(raw, "event_id", RULES, {"signal.strength"})


@query("c4_payload_validation", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'negative' ELSE 'unreadable' END AS violation FROM events")
def c4(t: Tables) -> DataFrame:
    said = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, '{"k": -4}').otherwise("{k")
    parsed = t.events.select("event_id", F.from_json(said, "k int, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("p"))
    return parsed.select("event_id", F.when(F.col("p._bad").isNotNull(), "unreadable").when(F.col("p.k") < 0, "negative").alias("violation"))


@query("c3_unmapped_leaves", "SELECT 'props' AS leaf UNION ALL SELECT 'value'")
def c3(t: Tables) -> DataFrame:
    left = X.unmapped(t.events.schema, [X.FieldRule("event_type", "signal.kind"), X.FieldRule("ts", "signal.at")], {"event_id", "user_id"})
    return t.spark.range(1).select(F.explode(F.array(*map(F.lit, sorted(left)))).alias("leaf"))


@query("a14_catalog_scan", "SELECT * FROM (VALUES ('astra', 'acme', 'Astra,Astra DB'), ('cassandra', 'acme', 'Cassandra,Apache Cassandra'), ('mongo', 'other', 'Mongo')) v(key, vendor, aliases)")
def a14(t: Tables) -> DataFrame:
    return K.catalog_table(t.spark, K.load_catalog(K.EXAMPLE_CATALOG).products).select("key", "vendor", F.array_join("aliases", ",").alias("aliases"))


@query("k19_compile_query", r"""WITH q AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Find senior Data Engineers using Astra-DB' WHEN 1 THEN 'directors at cassandra shops, analysts too' ELSE 'pandastra owners' END AS q FROM customer), w AS (SELECT c_custkey, trim(regexp_replace(lower(q), '[^a-z0-9+#.]+', ' ', 'g')) AS w FROM q)
SELECT c_custkey, array_to_string(list_filter([CASE WHEN regexp_matches(w, '(^|[^a-z0-9])astra($|[^a-z0-9])') THEN 'astra' END, CASE WHEN regexp_matches(w, '(^|[^a-z0-9])cassandra($|[^a-z0-9])') THEN 'cassandra' END], lambda x: x IS NOT NULL), ',') AS terms,
 CASE c_custkey % 3 WHEN 0 THEN 'senior' WHEN 1 THEN 'director' ELSE 'owner' END AS seniorities, CASE c_custkey % 3 WHEN 0 THEN 'data engineers' WHEN 1 THEN 'shops analysts' ELSE '' END AS titles FROM w""")
def k19(t: Tables) -> DataFrame:
    said = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'Find senior Data Engineers using Astra-DB' WHEN 1 THEN 'directors at cassandra shops, analysts too' ELSE 'pandastra owners' END")
    plan = t.customer.select("c_custkey", K.compile_query(said, {"astra": ("astra",), "cassandra": ("cassandra",)}).alias("p"))
    return plan.select("c_custkey", *[F.array_join(f"p.{c}", ",").alias(c) for c in ("terms", "seniorities", "titles")])


@query("k20_plan_lookup", "SELECT key FROM (VALUES ('astra', 'acme'), ('cassandra', 'acme'), ('mongo', 'other')) v(key, vendor) WHERE vendor = 'acme'")
def k20(t: Tables) -> DataFrame:
    return K.catalog_table(t.spark, K.load_catalog(K.EXAMPLE_CATALOG).products).filter("vendor = 'acme'").select("key")


@query("k20b_plan_matches", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'worker' WHEN c_custkey % 4 IN (1, 2) THEN 'user' END AS matched FROM customer""")
def k20b(t: Tables) -> DataFrame:
    """People at the vendor by their employer's domain, users of its products by their signals."""
    found = K.load_catalog(K.EXAMPLE_CATALOG)
    workers, users = found.workers_plan("acme"), found.users_plan("acme")
    k = F.col("c_custkey") % 4
    people = t.customer.select("c_custkey", F.when(k == 0, "acme.example").otherwise("x.example").alias("domain"), F.expr("CASE c_custkey % 4 WHEN 1 THEN 'uses:astra' WHEN 2 THEN 'uses:cassandra' ELSE 'uses:mongo' END").alias("label"))
    return people.select("c_custkey", F.when(F.col("domain").isin(*workers["domains"]), "worker").when(F.col("label").isin(*users["labels"]), "user").alias("matched"))


@query("k22_effective_vocabulary", "SELECT p_brand AS term, s_suppkey AS source, min(p_type) AS first FROM part JOIN supplier ON p_partkey % 107 = s_suppkey GROUP BY 1, 2")
def k22(t: Tables) -> DataFrame:
    profile = t.part.groupBy(F.col("p_brand").alias("term"), (F.col("p_partkey") % 107).alias("source")).agg(F.array_sort(F.collect_set("p_type")).alias("vocabulary"))
    sources = t.supplier.select(F.col("s_suppkey").alias("source"))
    return K.effective_vocabulary(profile, sources).select("term", "source", F.element_at("vocabulary", 1).alias("first"))


@query("e29_merged_askers", "WITH g AS (SELECT c_nationkey, count(DISTINCT CASE WHEN c_custkey % 20 = 0 THEN c_custkey END) AS urls, count(DISTINCT c_nationkey) AS names, arg_min(c_custkey, (c_custkey % 4, c_custkey)) AS asker FROM customer GROUP BY 1) SELECT c_custkey, CASE WHEN urls > 1 OR names > 1 THEN c_custkey ELSE asker END AS asker FROM customer JOIN g USING (c_nationkey)")
def e29(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    rows = t.customer.select("c_custkey", "c_nationkey", F.when(k % 20 == 0, k).alias("linkedin"), F.col("c_nationkey").alias("name"))
    return E.merge_askers(rows, "c_nationkey", "c_custkey", k % 4)


@query("e30_answer_attachment", "SELECT event_id, CASE WHEN user_id % 3 <> event_id % 3 AND user_id % 5 <> 0 THEN 'discarded' WHEN event_type IN ('view', 'error') THEN 'dropped' ELSE 'kept' END AS identity FROM events")
def e30(t: Tables) -> DataFrame:
    rung = F.when(F.col("event_type").isin("view", "error"), "name_domain").otherwise("email")
    asker, answer = F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 3), F.col("event_id") % 3
    return E.attach(t.events, asker, answer, rung).select("event_id", "identity")


@query("e31_echo_withheld", "SELECT o_orderpriority, CASE WHEN count(DISTINCT o_orderstatus) > 3 THEN 'multiple_contacts' WHEN count(DISTINCT o_custkey) > 1 THEN 'several_profiles' END AS reason FROM orders GROUP BY 1")
def e31(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderpriority", F.col("o_custkey").alias("linkedin"), F.lit("n").alias("name"), F.lit("c").alias("contact"))
    return E.withheld(rows, "o_orderpriority")


@query("e28_unseen_identities", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)")
def e28(t: Tables) -> DataFrame:
    return E.unseen(t.events, t.events.filter("event_type = 'purchase' and value > 100"), "user_id").select("event_id", "user_id")


@query("a12_synthetic_people", """WITH p AS (SELECT range AS id, range % 40 AS company FROM range(280))
SELECT id, company, 'c' || company || '.example' AS domain, 'Person ' || id AS full_name, CASE WHEN (('0x' || substr(sha256('11:' || id || ':linkedin'), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE < 0.7 THEN 'linkedin.com/in/p' || id END AS linkedin FROM p""")
def a12(t: Tables) -> DataFrame:
    return K.synthetic_people(t.spark, 40, 7, 11).select("id", "company", "domain", "full_name", "linkedin")


UNIT_SQL = "(('0x' || substr(sha256('11:' || {x} || ':{p}'), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE"


def unit(x: str, p: str) -> str:
    return UNIT_SQL.format(x=x, p=p)


ANSWER_KEY_SQL = f"""firms AS (SELECT range AS company, CASE WHEN {unit('range', 'uses')} < 0.3 THEN 'uses_now' WHEN {unit('range', 'uses')} < 0.4 THEN 'used_past' ELSE 'never' END AS uses FROM range(40)),
people AS (SELECT range AS id, range % 40 AS company, CASE WHEN {unit('range', 'linkedin')} < 0.7 THEN 'linkedin.com/in/p' || range END AS linkedin, CASE WHEN {unit('range', 'email')} < 0.8 THEN 'p' || range || '@c' || range % 40 || '.example' END AS email,
 CASE WHEN {unit('range', 'verified')} < 0.5 THEN 'verified' ELSE 'unverified' END AS email_status, {unit('range', 'opt_out')} < 0.05 AS opt_out FROM range(280))"""


@query("a12b_answer_key", f"WITH {ANSWER_KEY_SQL} SELECT id, company, linkedin, email, uses, opt_out, uses = 'uses_now' AND NOT opt_out AS wanted FROM people JOIN firms USING (company)")
def a12b(t: Tables) -> DataFrame:
    return Y.tables(t.spark, 40, 7, 11)["answer_key"]


@query("a9_routed_scan", f"""WITH {ANSWER_KEY_SQL}, asks AS (SELECT c_custkey AS ask, CASE c_custkey % 4 WHEN 0 THEN 'people.match' WHEN 1 THEN 'mail.verify' WHEN 2 THEN 'web.search' ELSE 'mail.send' END AS endpoint, c_custkey % 300 AS k FROM customer),
found AS (SELECT ask, endpoint, CASE endpoint WHEN 'people.match' THEN CASE WHEN p.id IS NOT NULL THEN 'p' || p.id END WHEN 'mail.verify' THEN CASE WHEN p.email IS NOT NULL THEN p.email_status END
 WHEN 'web.search' THEN CASE WHEN f.company IS NOT NULL AND {unit('f.company', 'web')} < 0.8 THEN 'Company ' || f.company || CASE uses WHEN 'uses_now' THEN ' runs Astra in production.' WHEN 'used_past' THEN ' moved off Astra.' ELSE ' compared Astra with others.' END END END AS answer
 FROM asks LEFT JOIN people p ON p.id = k LEFT JOIN firms f ON f.company = k), first AS (SELECT endpoint, min(ask) AS first FROM asks WHERE endpoint <> 'mail.send' GROUP BY 1)
SELECT ask, CASE WHEN ask = first THEN 2 ELSE 1 END AS attempt, CASE WHEN endpoint = 'mail.send' THEN 404 ELSE 200 END AS status, answer FROM found LEFT JOIN first USING (endpoint)
UNION ALL SELECT first, 1, 429, NULL FROM first""")
def a9(t: Tables) -> DataFrame:
    k, turn = F.col("c_custkey") % 300, F.col("c_custkey") % 4
    number = k.cast("string")
    key = F.when(turn == 0, F.concat(F.lit("id:"), number)).when(turn == 1, F.concat(F.lit("email:p"), number, F.lit("@c"), (k % 40).cast("string"), F.lit(".example"))).otherwise(F.concat(F.lit("domain:c"), number, F.lit(".example")))
    endpoint = F.when(turn == 0, "people.match").when(turn == 1, "mail.verify").when(turn == 2, "web.search").otherwise("mail.send")
    asks = t.customer.select(F.col("c_custkey").alias("ask"), endpoint.alias("endpoint"), key.alias("key"))
    return Y.routed(asks, Y.index(Y.tables(t.spark, 40, 7, 11)), faults=True)


# Robots files made of the pages' hosts: by the length of a host one is missing, closed, or has rules.
HOST_SQL = "regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1)"
PATH_SQL = "regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '^$', '/')"


@query("a13b_robots", f"""WITH p AS (SELECT page_id, url, {HOST_SQL} AS host, {PATH_SQL} AS path FROM pages)
SELECT page_id, CASE length(host) % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN starts_with(path, '/fr/') OR NOT (starts_with(path, '/f') OR starts_with(path, '/d')) ELSE NOT starts_with(path, '/e') END AS allowed FROM p""")
def a13b(t: Tables) -> DataFrame:
    kind = F.char_length(F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#]*)", 1)) % 4
    body = F.when(kind == 2, "User-agent: other\nDisallow: /\n\nUser-agent: goldweave\nAllow: /fr/ # but\nDisallow: /f\nDisallow: /d\n\nUser-agent: *\nDisallow: /").otherwise("User-agent: *\nDisallow:/e\nDisallow:")
    files = t.pages.select(B.origin(F.col("url")).alias("origin"), F.when(kind == 0, 404).when(kind == 1, 503).otherwise(200).alias("status"), body.alias("body")).distinct()
    return B.judged(t.pages.select("page_id", "url"), B.robots_rules(files, "goldweave/1.0"), "page_id", "url").select("page_id", "allowed")


@query("a13c_pages_to_read", "SELECT url, min(page_id) AS page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) GROUP BY 1")
def a13c(t: Tables) -> DataFrame:
    return B.to_read(t.pages, t.pages.filter("page_id % 3 = 0"), "page_id", "url").select("url", "page_id")
