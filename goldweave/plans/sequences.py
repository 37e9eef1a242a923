"""Queries of event sequences, time rules, paging and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators import buckets as K
from goldweave.operators import sequence as S
from goldweave.plans.registry import Tables, query

# A log made of events: large values are steps of a sequence, so that every branch stays alive over the whole table.
LOG_SQL = "CASE WHEN event_type = 'signup' AND value > 100 THEN 'invite' WHEN event_type = 'click' AND value > 150 THEN 'accepted' WHEN event_type = 'purchase' AND value > 180 THEN 'email' WHEN event_type = 'error' AND value > 180 THEN 'halted' END"


def first_sql(now: str | None = None) -> str:
    """First times of all events, or of those up to ``now``."""
    seen = f" WHERE ts <= TIMESTAMP '{now}'" if now else ""
    return f"""f AS (SELECT user_id AS key, {', '.join(f"min(CASE WHEN k = '{k}' THEN ts END) AS {k}" for k in S.KINDS)} FROM (SELECT *, {LOG_SQL} AS k FROM events{seen}) GROUP BY 1)"""


def due_sql(now: str) -> str:
    return f"""CASE WHEN halted IS NOT NULL THEN NULL WHEN key % 17 = 0 THEN 'halted' WHEN coalesce(email, fallback_email, stalled) IS NOT NULL THEN NULL WHEN invite IS NULL THEN 'invite'
 WHEN accepted IS NOT NULL THEN CASE WHEN {now} >= accepted + INTERVAL 2 DAY THEN 'email' END WHEN {now} >= invite + INTERVAL 5 DAY THEN CASE WHEN key % 2 = 0 THEN 'fallback_email' ELSE 'stalled' END END"""


def log(t: Tables, now: str | None = None) -> DataFrame:
    seen = t.events.filter(f"ts <= timestamp_ntz '{now}'") if now else t.events
    return seen.select(F.col("user_id").alias("key"), F.expr(LOG_SQL).alias("kind"), F.col("ts").alias("at"))


def due_at(t: Tables, now: str) -> DataFrame:
    first = S.first_per_kind(log(t, now), "key", "kind", "at")
    at = F.expr(f"timestamp_ntz '{now}'")
    return first.select("key", S.due_action(at, F.col("key") % 17 == 0, F.col("key") % 2 == 0).alias("action"))


@query("g5_first_per_kind", f"WITH {first_sql()} SELECT key, invite, accepted, email, halted FROM f")
def g5(t: Tables) -> DataFrame:
    return S.first_per_kind(log(t), "key", "kind", "at").select("key", "invite", "accepted", "email", "halted")


SOON, LATE = "2024-01-08 12:00:00", "2024-01-31 00:00:00"


def due_query(now: str) -> str:
    at = f"TIMESTAMP '{now}'"
    return f"WITH {first_sql(now)} SELECT key, {due_sql(at)} AS action FROM f"


@query("l1_due", due_query(SOON))
def l1(t: Tables) -> DataFrame:
    return due_at(t, SOON)


@query("l1b_due_later", due_query(LATE))
def l1b(t: Tables) -> DataFrame:
    return due_at(t, LATE)


UNIT_SQL = "(('0x' || substr(sha256('7:' || key || ':{p}'), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE"
ACCEPT_SQL = f"CASE WHEN {UNIT_SQL.format(p='accept')} < 0.6 THEN invite + to_days(least(floor({UNIT_SQL.format(p='delay')} * 4)::INTEGER, 3)) END"


@query("l3_seeded_acceptance", f"WITH {first_sql()} SELECT key, {ACCEPT_SQL} AS accepts_at FROM f")
def l3(t: Tables) -> DataFrame:
    first = S.first_per_kind(log(t), "key", "kind", "at")
    return first.select("key", S.seeded_acceptance(F.col("key"), F.col("invite"), 7, 0.6, 3).alias("accepts_at"))


@query("l2_tick", f"""WITH {first_sql(SOON)}, a AS (SELECT *, CASE WHEN accepted IS NULL AND invite IS NOT NULL AND halted IS NULL AND {ACCEPT_SQL} <= TIMESTAMP '{SOON}' THEN {ACCEPT_SQL} END AS fresh FROM f),
b AS (SELECT * REPLACE (coalesce(accepted, fresh) AS accepted) FROM a), c AS (SELECT *, {due_sql(f"TIMESTAMP '{SOON}'")} AS act FROM b)
SELECT key, 'accepted' AS kind, fresh AS at_ FROM c WHERE fresh IS NOT NULL UNION ALL SELECT key, act, TIMESTAMP '{SOON}' FROM c WHERE act IS NOT NULL""")
def l2(t: Tables) -> DataFrame:
    rows = log(t, SOON)
    facts = rows.select("key").distinct().select("key", (F.col("key") % 17 == 0).alias("opted_out"), (F.col("key") % 2 == 0).alias("usable_email"))
    return S.tick(rows, F.expr(f"timestamp_ntz '{SOON}'"), facts, 7, 0.6, 3).withColumnRenamed("at", "at_")


# Two windows: 2 requests in 300 seconds and 60 in 36,000; p is what a Retry-After adds.
BUCKET_SQL = """WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) AS t, {pause} AS p, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS i FROM events),
r(event_type, i, event_id, t, x, y, f1, f2) AS (SELECT event_type, i, event_id, t, t, t + p, t + 150000000, t + 600000000 FROM e WHERE i = 1
  UNION ALL SELECT e.event_type, e.i, e.event_id, e.t, z.x, z.x + e.p, greatest(z.x, r.f1) + 150000000, greatest(z.x, r.f2) + 600000000
  FROM r JOIN e ON e.event_type = r.event_type AND e.i = r.i + 1, LATERAL (SELECT greatest(e.t, r.y, r.f1 - 150000000, r.f2 - 35400000000) AS x) z)
SELECT event_type, event_id, (x - t) / 1000000 AS waited FROM r"""


def requests(t: Tables) -> DataFrame:
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s")
    return t.events.select("event_type", "event_id", seconds, F.when(F.col("event_id") % 10 == 0, 1000.0).alias("retry"))


@query("l4_token_bucket", BUCKET_SQL.format(pause="0"))
def l4(t: Tables) -> DataFrame:
    return K.throttle(requests(t), "event_type", "s", "event_id", [(2, 300.0), (60, 36000.0)])


@query("l4b_retry_after", BUCKET_SQL.format(pause="CASE WHEN event_id % 10 = 0 THEN 1000000000 ELSE 0 END"))
def l4b(t: Tables) -> DataFrame:
    return K.throttle(requests(t), "event_type", "s", "event_id", [(2, 300.0), (60, 36000.0)], "retry")


@query("l5_backoff_ceiling", "SELECT event_id, least(30.0::DOUBLE, 0.5 * pow(2.0, event_id % 10)) AS ceiling FROM events")
def l5(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.backoff_ceiling(F.col("event_id") % 10, 0.5, 30.0).alias("ceiling"))


@query("l7_call_ledger", "SELECT user_id, arg_max(event_type, event_id) AS event_type, count(*) AS calls FROM events GROUP BY 1")
def l7(t: Tables) -> DataFrame:
    return S.last_status(t.events, "user_id", "event_type", "event_id")


@query("l8_run_lifecycle", """SELECT o_orderkey AS run, CASE WHEN o_orderstatus = 'O' THEN coalesce(e, 'running') ELSE 'completed' END AS status FROM orders LEFT JOIN
(SELECT l_orderkey, arg_min(CASE WHEN l_returnflag = 'N' THEN 'completed' ELSE 'aborted' END, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS e FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON l_orderkey = o_orderkey""")
def l8(t: Tables) -> DataFrame:
    runs = t.orders.select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"))
    end = F.when(F.col("l_returnflag") == "N", "completed").otherwise("aborted")
    return S.finish_runs(runs, t.lineitem.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("run"), end.alias("status"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq")))


@query("g7_earliest_anchor", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS anchor FROM orders GROUP BY 1")
def g7(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("anchor"))


@query("g8_report_order", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders")
def g8(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    ranked = S.number_all(t.orders.select("o_orderkey", "o_totalprice", status.alias("status")), "status", F.desc("o_totalprice"), "o_orderkey")
    return ranked.select("o_orderkey", "place")


@query("h1_keyset_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 200 AND c_acctbal > 0 ORDER BY c_custkey LIMIT 50")
def h1(t: Tables) -> DataFrame:
    return t.customer.filter("c_custkey > 200 and c_acctbal > 0").orderBy("c_custkey").limit(50).select("c_custkey", "c_name")


@query("h2_newest_row", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def h2(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1)


@query("h3_canonical_sort", "SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS members FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def h3(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("members"))


@query("h4_top_runs", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def h4(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("h5_enrichment_tiers", "SELECT s_suppkey, dense_rank() OVER (ORDER BY s_acctbal > 0, s_nationkey % 3, s_suppkey % 2)::INTEGER AS tier FROM supplier")
def h5(t: Tables) -> DataFrame:
    keys = t.supplier.select("s_suppkey", (F.col("s_acctbal") > 0).alias("paid"), (F.col("s_nationkey") % 3).alias("charge"), (F.col("s_suppkey") % 2).alias("place_"))
    order = ("paid", "charge", "place_")
    tiers = S.number_all(keys.select(*order).distinct(), *order).withColumnRenamed("place", "tier")
    return keys.join(tiers, list(order)).select("s_suppkey", "tier")


@query("i4_stable_distinct", "SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY first, l_returnflag) AS flags FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def i4(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_distinct(F.transform(rows, lambda r: r["l_returnflag"])), ",").alias("flags"))
