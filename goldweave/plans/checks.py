"""Queries of checks on endpoints and payloads, of corroborated answers and of point reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.functions import endpoints as N
from goldweave.operators import enrich as E
from goldweave.operators import resolve as R
from goldweave.plans.identity import C_SQL, contributions
from goldweave.plans.registry import Tables, query
from goldweave.plans.resolution import CAND_DUCK, ORDER_SQL, candidates
from goldweave.ranged import Ranged
from goldweave.sources import payloads as Y
from goldweave.storage import new_path

# Endpoints are the paths of the pages with endings that do or do not send.
ENDINGS = ("", "/single-send", "/%73end/{id}", "/sendEmail", "/consequence", "/{action}", "/api%2563ampaigns/x", "/contacts/search", "/notesOfCalls", "/100%/bulk+x")
PATH_SQL = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) || list_extract([{}], CAST(page_id % 10 + 1 AS BIGINT))".format(", ".join(f"'{e}'" for e in ENDINGS))
METHOD_SQL = "CASE page_id % 3 WHEN 0 THEN 'POST' ELSE 'GET' END"
LISTED = ("/fr/contacts/search", "/en/contacts/search")


def _sql_list(words: list[str]) -> str:
    return "[{}]".format(", ".join(f"'{w}'" for w in words))


_WORDS_SQL = r"regexp_extract_all(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')"
_DECODED_SQL = "path"
for _ in range(N.DECODED):
    _DECODED_SQL = f"url_decode({_DECODED_SQL})"


@query("d11b_send_problems", rf"""WITH e AS (SELECT page_id, {METHOD_SQL} AS method, {PATH_SQL} AS path FROM pages), x AS (SELECT *, {_DECODED_SQL} AS whole FROM e),
y AS (SELECT *, array_to_string(regexp_extract_all(whole, '\{{([^}}]*)\}}', 1), ' ') AS named, regexp_replace(whole, '\{{[^}}]*\}}', ' ', 'g') AS plain FROM x),
h AS (SELECT page_id, method, path, list_sort(list_distinct(list_concat(list_concat(list_filter({_WORDS_SQL.format(x="named")}, lambda w: list_contains({_sql_list([*N.SEND_WORDS, *N.SELECTORS])}, w)), list_filter({_WORDS_SQL.format(x="plain")}, lambda w: list_contains({_sql_list(N.SEND_WORDS)}, w))), list_filter({_sql_list(N.SEND_STEMS)}, lambda s: contains(lower(plain), s))))) AS hits FROM y)
SELECT page_id, method, path, CASE WHEN len(hits) > 0 THEN 'names ' || array_to_string(hits, ',') WHEN method <> 'GET' AND path NOT IN {LISTED} THEN 'unlisted_post' END AS problem FROM h""")
def d11b(t: Tables) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % 10 + 1).cast("int"))
    path = F.concat(F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), ending)
    asked = t.pages.select("page_id", F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"), path.alias("path"))
    return asked.select("*", N.send_problem(F.col("method"), F.col("path"), list(LISTED)).alias("problem"))


# Payloads are the events' own with what some of them hold beside it.

def _payload(t: Tables) -> DataFrame:
    i, own = F.col("event_id"), F.get_json_object("props", "$.k")
    more = F.when(i % 11 == 0, ',"who":{"name":"x","mails":[{"to":"a"},{"to":null}]}').when(i % 11 == 1, ',"tags":[],"score":[[1],[2]]').when(i % 11 == 2, ',"kin":1').otherwise("")
    text = F.concat(F.lit('{"k":'), own, more, F.lit("}"))
    return t.events.select(i.alias("file"), F.when(i % 97 == 5, "[1]").when(i % 97 == 6, "{k").otherwise(text).alias("payload"))


LEAVES_SQL = """r AS (SELECT event_id AS file, event_id % 97 IN (5, 6) AS bad, event_id % 11 AS m FROM events),
lv AS (SELECT file, 'k' AS leaf FROM r WHERE NOT bad UNION ALL SELECT file, unnest(['who.name', 'who.mails[].to']) FROM r WHERE NOT bad AND m = 0
 UNION ALL SELECT file, 'score[][]' FROM r WHERE NOT bad AND m = 1 UNION ALL SELECT file, 'kin' FROM r WHERE NOT bad AND m = 2)"""
DECLARED = ("k", "who.mails[]")


def _declared(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(p,) for p in DECLARED], "path string")


@query("c3b_payload_drift", f"""WITH {LEAVES_SQL} SELECT leaf, count(*) AS rows, min(file) AS first FROM lv WHERE leaf NOT IN ('k', 'who.mails[].to') GROUP BY 1""")
def c3b(t: Tables) -> DataFrame:
    return Y.drift(Y.payload_leaves(_payload(t), "file", F.col("payload")), "file", _declared(t))


@query("c43b_file_faults", f"""WITH {LEAVES_SQL}, l AS (SELECT event_id AS file, CASE event_id % 7 WHEN 0 THEN DATE '2099-01-01' WHEN 3 THEN NULL ELSE DATE '2024-01-01' END AS day FROM events WHERE event_id % 5 <> 0
 UNION ALL SELECT -event_id - 1, DATE '2024-01-01' FROM events WHERE event_id % 500 = 0)
SELECT file, 'unmapped' AS fault, leaf FROM lv WHERE leaf NOT IN ('k', 'who.mails[].to') UNION ALL SELECT file, 'unreadable', NULL FROM r WHERE bad UNION ALL SELECT file, 'unlisted', NULL FROM r WHERE file % 5 = 0
UNION ALL SELECT file, 'dated_ahead', NULL FROM l WHERE day IS NULL OR day > DATE '2026-01-01' UNION ALL SELECT file, 'missing', NULL FROM l WHERE file < 0""")
def c43b(t: Tables) -> DataFrame:
    """A fifth of the files is not listed; some entries have no date or a future one, some name no file."""
    i = F.col("event_id")
    day = F.when(i % 7 == 0, "2099-01-01").when(i % 7 != 3, "2024-01-01").cast("date")
    listed = t.events.filter("event_id % 5 <> 0").select(i.alias("file"), day.alias("recorded_on"))
    gone = t.events.filter("event_id % 500 = 0").select((-i - 1).alias("file"), F.lit("2024-01-01").cast("date").alias("recorded_on"))
    return Y.file_faults(_payload(t), listed.unionByName(gone), _declared(t), F.lit("2026-01-01").cast("date"))


PREFERRED_SQL = "CASE source WHEN 's3' THEN 0 WHEN 's1' THEN 1 ELSE 2 END"


@query("g1c_preferred_winner", f"WITH {CAND_DUCK}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster, path ORDER BY {PREFERRED_SQL}, {ORDER_SQL}) AS rank FROM cand) SELECT cluster, path, source, value FROM r WHERE rank = 1")
def g1c(t: Tables) -> DataFrame:
    """Sources that are preferred for a path go before all others, whatever their trust."""
    source = F.col("source")
    return R.winners(candidates(t).withColumn("preferred", F.when(source == "s3", 0).when(source == "s1", 1).otherwise(2)))


@query("e30b_corroborated_answers", f"""WITH {C_SQL}, p AS (SELECT q.id AS asker, a.id AS answer, q.linkedin AS mine, a.linkedin AS theirs, q.title = a.title OR coalesce(q.employer = a.employer, false) AS same,
  CASE WHEN q.linkedin IS NOT NULL THEN 'linkedin' WHEN q.verified AND q.email IS NOT NULL THEN 'email' WHEN q.name IS NOT NULL AND q.domain IS NOT NULL THEN 'name_domain' ELSE 'id' END AS rung,
  q.linkedin IS NULL AND NOT (q.verified AND q.email IS NOT NULL) AND q.name IS NOT NULL AS by_name FROM c q JOIN (SELECT *, name AS n2 FROM c WHERE id % 2 = 1) a ON a.person = q.person + q.id % 2 WHERE q.id % 2 = 0 OR q.id % 6 = 1)
SELECT asker, answer, CASE WHEN mine <> theirs THEN 'discarded' WHEN by_name AND NOT same THEN 'discarded' WHEN by_name OR rung = 'name_domain' THEN 'dropped' ELSE 'kept' END AS outcome,
 CASE WHEN mine <> theirs THEN 'other_profile' WHEN by_name AND NOT same THEN 'uncorroborated' WHEN by_name THEN 'by_name' WHEN rung = 'name_domain' THEN 'weak_rung' END AS reason FROM p""")
def e30b(t: Tables) -> DataFrame:
    """Records ask for their own person, some of them get the next one's; answers are the odd records."""
    c = contributions(t)
    mailed = F.col("verified") & F.col("email").isNotNull()
    rung = F.when(F.col("linkedin").isNotNull(), "linkedin").when(mailed, "email").when(F.col("name").isNotNull() & F.col("domain").isNotNull(), "name_domain").otherwise("id")
    anchor = F.when(F.col("linkedin").isNotNull(), "linkedin").when(mailed, "email").when(F.col("name").isNotNull(), "name").otherwise("own")
    askers = c.filter("id % 2 = 0 or id % 6 = 1").select(F.col("id").alias("asker"), (F.col("person") + F.col("id") % 2).alias("person"), F.col("linkedin").alias("asker_linkedin"), F.col("title").alias("asker_title"), F.col("employer").alias("asker_employer"), rung.alias("rung"), anchor.alias("anchor"))
    answers = c.filter("id % 2 = 1").select(F.col("id").alias("answer"), "person", "linkedin", "title", "employer")
    return E.attach_corroborated(askers.join(answers, "person")).select("asker", "answer", "outcome", "reason")


def _ranged(rows: DataFrame, name: str, key: str) -> Ranged:
    table = Ranged(new_path(rows.sparkSession, name), key)
    table.store(rows, 64)
    return table


@query("d2b_company_point_read", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 7")
def d2b(t: Tables) -> DataFrame:
    """One company's rows from a table that lies by company: one range in 64 is opened, two at a border."""
    return _ranged(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber"), "companies", "l_suppkey").at(t.spark, 7)


@query("h1b_refilled_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 AND o_totalprice > 150000 AND o_custkey % 5 = 0 ORDER BY o_orderkey LIMIT 50")
def h1b(t: Tables) -> DataFrame:
    """A page behind a key from a table that lies by key; further ranges are opened only where the filter leaves too few rows."""
    table = _ranged(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "pages", "o_orderkey")
    return table.page(t.spark, 1000, 50, (F.col("o_totalprice") > 150000) & (F.col("o_custkey") % 5 == 0)).select("o_orderkey", "o_custkey")
