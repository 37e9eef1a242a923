"""Queries of people and companies as components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators import enrich as E
from goldweave.operators import identity as I
from goldweave.operators import people as P
from goldweave.operators import projection as J
from goldweave.operators import reports as O
from goldweave.plans.identity import C_SQL, CLOSURE_SQL, CLUSTER_SQL, contributions
from goldweave.plans.registry import Tables, query

# Companies are customers; some records name two, some none.
DOMAIN_SQL = "CASE WHEN id % 5 = 4 THEN [] WHEN id % 97 = 0 THEN ['c' || person, 'c' || (person + 1)] ELSE ['c' || person] END"
PERSON_SQL = f"""{C_SQL}, ik AS (SELECT id, 'l:' || linkedin AS key FROM c WHERE linkedin IS NOT NULL UNION ALL SELECT id, 'e:' || email FROM c WHERE email IS NOT NULL),
pe AS (SELECT DISTINCT a.id AS u, b.id AS v FROM ik a JOIN ik b USING (key) WHERE a.id <> b.id), {CLOSURE_SQL.format(name='pl', edges='pe')}"""
COMPANY_SQL = f"""ds AS (SELECT id, unnest({DOMAIN_SQL}) AS domain FROM c), de AS (SELECT DISTINCT a.id AS u, b.id AS v FROM ds a JOIN ds b USING (domain) WHERE a.id <> b.id),
{CLOSURE_SQL.format(name='cl0', edges='de')}, cl AS (SELECT id, cluster FROM cl0 WHERE id IN (SELECT id FROM ds))"""


def records(t: Tables) -> DataFrame:
    c = contributions(t)
    one, two = F.concat(F.lit("c"), F.col("person").cast("string")), F.concat(F.lit("c"), (F.col("person") + 1).cast("string"))
    none = F.array().cast("array<string>")
    return c.withColumn("domains", F.when(F.col("id") % 5 == 4, none).when(F.col("id") % 97 == 0, F.array(one, two)).otherwise(F.array(one)))


@query("e12b_company_work_list", f"""WITH RECURSIVE {PERSON_SQL}, {COMPANY_SQL}, r AS (SELECT pl.id, pl.cluster AS person, cl.cluster AS company FROM pl LEFT JOIN cl USING (id))
SELECT min(id) AS id, company, arg_min(person, id) AS person FROM r WHERE company IS NOT NULL GROUP BY company
UNION ALL SELECT min(id), NULL, person FROM r WHERE company IS NULL AND person NOT IN (SELECT person FROM r WHERE company IS NOT NULL) GROUP BY person""")
def e12b(t: Tables) -> DataFrame:
    return P.company_work_list(records(t))


@query("e13b_company_anchors", f"""WITH RECURSIVE {C_SQL}, {COMPANY_SQL}, s AS (SELECT cluster, count(DISTINCT CASE WHEN id % 3 <> 1 THEN id % 4 END) AS sources FROM cl GROUP BY 1)
SELECT DISTINCT cl.cluster AS company, domain, sources FROM cl JOIN ds USING (id) JOIN s ON s.cluster = cl.cluster""")
def e13b(t: Tables) -> DataFrame:
    rows = records(t).withColumns({"source": F.col("id") % 4, "echoed": F.col("id") % 3 == 1})
    return P.company_anchors(rows, "source", "echoed")


LOOKUP_SQL = """lk AS (SELECT id, 'id' AS rung, 'r' || id AS lookup FROM c WHERE id % 11 = 0 UNION ALL SELECT id, 'linkedin', linkedin FROM c WHERE linkedin IS NOT NULL
  UNION ALL SELECT id, 'email', email FROM c WHERE email IS NOT NULL UNION ALL SELECT id, 'name_domain', name || '@' || domain FROM c WHERE name IS NOT NULL AND domain IS NOT NULL)"""
ASK_SQL = f"""{PERSON_SQL}, {LOOKUP_SQL}, rw AS (SELECT c.id, pl.cluster AS person, linkedin, name, CASE WHEN linkedin IS NOT NULL THEN 1 WHEN verified AND email IS NOT NULL THEN 2 WHEN name IS NOT NULL THEN 3 WHEN id % 11 = 0 THEN 4 END AS anchor FROM c JOIN pl USING (id)),
gd AS (SELECT person, max(linkedin) AS profile FROM rw GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT linkedin) <= 1 AND count(DISTINCT name) <= 1),
ab AS (SELECT rw.*, gd.person IS NOT NULL AS one, CASE WHEN gd.person IS NOT NULL THEN rw.person ELSE id END AS asks, CASE WHEN gd.person IS NOT NULL THEN gd.profile ELSE linkedin END AS shown FROM rw LEFT JOIN gd USING (person) WHERE id IN (SELECT id FROM lk)),
ak AS (SELECT asks, arg_min(id, (anchor, id)) AS asker, min(person) AS person, min(anchor) AS anchor, max(shown) AS linkedin FROM ab WHERE anchor IS NOT NULL GROUP BY asks)"""


def _asked(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    step = lambda rung, x: F.when(x.isNotNull(), F.struct(F.lit(rung).alias("rung"), x.alias("lookup")))
    own = F.when(F.col("id") % 11 == 0, F.concat(F.lit("r"), F.col("id").cast("string")))
    named = F.concat("name", F.lit("@"), "domain")
    lookups = F.array_compact(F.array(step("id", own), step("linkedin", F.col("linkedin")), step("email", F.col("email")), step("name_domain", named)))
    mailed = F.col("verified") & F.col("email").isNotNull()
    anchor = F.when(F.col("linkedin").isNotNull(), "linkedin_url").when(mailed, "email").when(F.col("name").isNotNull(), "name").when(own.isNotNull(), "own")
    return P.ask_people(contributions(t), lookups, anchor)


@query("e29b_people_askers", f"WITH RECURSIVE {ASK_SQL} SELECT asker, person, ['linkedin_url', 'email', 'name', 'own'][anchor] AS anchor, linkedin FROM ak")
def e29b(t: Tables) -> DataFrame:
    return _asked(t)[0]


@query("e29c_people_ladders", f"WITH RECURSIVE {ASK_SQL} SELECT DISTINCT ak.asker, lk.rung, lk.lookup FROM ab JOIN lk USING (id) JOIN ak ON ak.asks = ab.asks")
def e29c(t: Tables) -> DataFrame:
    return _asked(t)[1]


@query("e29d_out_of_reach", f"WITH RECURSIVE {ASK_SQL} SELECT DISTINCT person FROM ab WHERE asks NOT IN (SELECT asks FROM ak)")
def e29d(t: Tables) -> DataFrame:
    return _asked(t)[2]


@query("j4b_role_contacts", f"""WITH {C_SQL}, w AS (SELECT person, max(email) AS chosen FROM c WHERE id % 3 = 0 GROUP BY 1)
SELECT DISTINCT person, email AS contact FROM c LEFT JOIN w USING (person) WHERE split_part(email, '@', 1) = 'info' AND email IS DISTINCT FROM chosen""")
def j4b(t: Tables) -> DataFrame:
    """A person's chosen address is one of those that a third of the records state."""
    c = contributions(t)
    chosen = c.filter("id % 3 = 0").groupBy("person").agg(F.max("email").alias("chosen"))
    return P.role_contacts(c.join(chosen, "person", "left"), "person", "email", "chosen")


@query("j5b_linked_flags", f"""WITH {C_SQL}, ik AS (SELECT id, 'l:' || linkedin AS key FROM c WHERE linkedin IS NOT NULL UNION ALL SELECT id, 'e:' || email FROM c WHERE email IS NOT NULL),
f AS (SELECT id, CASE WHEN id % 80 = 0 THEN 'opt_out' ELSE 'suppressed' END AS flag, id % 3 AS source FROM c WHERE id % 40 = 0), b AS (SELECT DISTINCT key, flag, source FROM ik JOIN f USING (id))
SELECT DISTINCT c.person AS cluster, x.flag, x.source FROM (SELECT id, flag, source FROM f UNION SELECT id, flag, source FROM ik JOIN b USING (key)) x JOIN c USING (id)""")
def j5b(t: Tables) -> DataFrame:
    c = contributions(t)
    flags = c.filter("id % 40 = 0").select("id", F.when(F.col("id") % 80 == 0, "opt_out").otherwise("suppressed").alias("flag"), (F.col("id") % 3).alias("source"))
    return P.compliance_reports(c.select("id", F.col("person").alias("cluster")), flags, c)


@query("e9b_numbered_cluster_ids", f"""WITH RECURSIVE {CLUSTER_SQL}, a AS (SELECT cluster, arg_min(coalesce(name, '-'), (fetched_at, coalesce(name, '-'))) AS content FROM g JOIN c USING (id) GROUP BY 1),
nu AS (SELECT cluster, sha256(content) AS h, row_number() OVER (PARTITION BY sha256(content) ORDER BY content, cluster) AS rn FROM a) SELECT cluster, CASE WHEN rn = 1 THEN h ELSE h || '-' || rn END AS cluster_id FROM nu""")
def e9b(t: Tables) -> DataFrame:
    """Contents are names here, so that many clusters have equal ones."""
    c = contributions(t)
    content = F.coalesce("name", F.lit("-"))
    first = F.min_by(content, F.struct("fetched_at", content))
    anchors = c.join(I.clusters(c), "id").groupBy("cluster").agg(first.alias("content")).withColumn("digest", F.sha2("content", 256))
    return P.numbered_ids(anchors, "cluster", "digest", "content")


@query("e25b_answer_key_person", f"""WITH {C_SQL}, h AS (SELECT id, person AS p, 0 AS rank FROM c WHERE linkedin IS NOT NULL AND person % 4 <> 0
  UNION ALL SELECT c.id, o.c_custkey, 1 FROM c JOIN customer o ON c.email = 'p' || o.c_custkey || '@d' || (o.c_custkey % 40) || '.example' WHERE o.c_custkey % 3 <> 0)
SELECT id, arg_min(p, (rank, p)) AS person FROM h JOIN customer ON c_custkey = p GROUP BY id""")
def e25b(t: Tables) -> DataFrame:
    """Some people of the answer key have no profile there, some no address."""
    key = F.col("c_custkey")
    slug = F.when(key % 4 != 0, F.concat(F.lit("linkedin.com/in/p"), key.cast("string")))
    email = F.when(key % 3 != 0, F.concat(F.lit("p"), key.cast("string"), F.lit("@d"), (key % 40).cast("string"), F.lit(".example")))
    answers = t.customer.select(key.alias("person"), slug.alias("linkedin"), email.alias("email"))
    return O.match_answers(contributions(t), answers, ("linkedin", "email"))


@query("e31b_requester_echo", f"""WITH {C_SQL}, q AS (SELECT email, count(DISTINCT linkedin) AS profiles, count(DISTINCT name) AS names, min(linkedin) AS linkedin, bool_or(verified) AS verified FROM c WHERE email IS NOT NULL GROUP BY 1),
k AS (SELECT email, CASE id % 7 WHEN 1 THEN ' ' WHEN 2 THEN 'other@x.example' ELSE upper(email) END AS own FROM c WHERE email IS NOT NULL AND fetched_at < TIMESTAMP '1995-04-01'), f AS (SELECT email, count(*) AS n, min(own) AS own FROM k GROUP BY 1),
r AS (SELECT q.*, CASE WHEN n > 1 THEN 'multiple_contacts' WHEN trim(own) = '' THEN 'email_unconfirmed' WHEN lower(trim(own)) <> email THEN 'email_mismatch' WHEN profiles > 1 OR names > 1 THEN 'two_people' END AS reason FROM q JOIN f USING (email))
SELECT email, reason, CASE WHEN reason IS NULL THEN linkedin END AS linkedin, CASE WHEN reason IS NULL AND verified THEN email END AS verified FROM r""")
def e31b(t: Tables) -> DataFrame:
    """Contacts are those that early records found; some state no address, some another one."""
    c = contributions(t).filter("email is not null")
    own = F.when(F.col("id") % 7 == 1, " ").when(F.col("id") % 7 == 2, "other@x.example").otherwise(F.upper("email"))
    contacts = c.filter("fetched_at < TIMESTAMP '1995-04-01'").select("email", own.alias("own"))
    return E.echoes(c.select("email", "linkedin", "name", "verified"), contacts)


@query("a6b_questions_once", f"""WITH {C_SQL}, w AS (SELECT id, CASE WHEN email IS NOT NULL THEN 'verifier' WHEN name IS NOT NULL AND domain IS NOT NULL THEN 'finder' WHEN domain IS NOT NULL THEN 'domain_search' END AS route,
  CASE WHEN email IS NOT NULL THEN email WHEN name IS NOT NULL AND domain IS NOT NULL THEN name || '@' || domain WHEN domain IS NOT NULL THEN domain END AS question FROM c)
SELECT id, route, question, sha256(route || '|' || question) AS answer FROM w WHERE route IS NOT NULL""")
def a6b(t: Tables) -> DataFrame:
    """The answer is made once for a question (a digest stands for the call) and handed to all who asked it."""
    c = contributions(t)
    route = E.route(F.col("email"), F.col("name"), F.col("domain"))
    question = F.when(route == "verifier", F.col("email")).when(route == "finder", F.concat("name", F.lit("@"), "domain")).otherwise(F.col("domain"))
    questions, waits = E.ask_once(c, "id", route, question)
    answers = questions.withColumn("answer", F.sha2(F.concat_ws("|", "route", "question"), 256))
    return E.answered(waits, answers).select("id", "route", "question", "answer")


@query("f16b_label_confusion", """WITH x AS (SELECT toxic, coalesce(CASE WHEN doc_id % 17 <> 0 THEN quality END::VARCHAR, 'dropped') AS quality FROM labels), n AS (SELECT toxic, quality, count(*) AS n FROM x GROUP BY 1, 2)
SELECT toxic, quality, n, n / sum(n) OVER (PARTITION BY toxic) AS share FROM n""")
def f16b(t: Tables) -> DataFrame:
    said = t.labels.select("toxic", F.when(F.col("doc_id") % 17 != 0, F.col("quality")).alias("quality"))
    return O.confusion(said, "toxic", "quality")


PROJECT_SQL = """m AS (SELECT person AS cluster, sum(('0x' || substr(md5('r' || id), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS fingerprint, {first} FROM c GROUP BY 1)"""
RECORD = ("linkedin", "email", "name", "title")
_FIRST = ", ".join(f"arg_min({p}, (NOT verified, -epoch_us(fetched_at), id)) FILTER (WHERE {p} IS NOT NULL) AS {p}" for p in RECORD)


@query("j1b_lead_projection", f"""WITH {C_SQL}, {PROJECT_SQL.format(first=_FIRST)},
p0 AS (SELECT person AS cluster, sum(('0x' || substr(md5('r' || id), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS was, CAST(person % 3 + 1 AS INTEGER) AS v FROM c WHERE fetched_at < TIMESTAMP '2001-01-01' GROUP BY 1, 3),
em AS (SELECT person AS cluster, string_agg(DISTINCT employer, ',' ORDER BY employer) AS employers FROM c GROUP BY 1),
dv AS (SELECT cluster, arg_min(domain, (-n, domain)) AS primary_domain FROM (SELECT person AS cluster, domain, count(*) AS n FROM c WHERE domain IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
rc AS (SELECT m.cluster, string_agg(DISTINCT c.email, ',' ORDER BY c.email) AS contacts FROM c JOIN m ON m.cluster = c.person WHERE split_part(c.email, '@', 1) = 'info' AND c.email IS DISTINCT FROM m.email GROUP BY 1),
ik AS (SELECT id, 'l:' || linkedin AS key FROM c WHERE linkedin IS NOT NULL UNION ALL SELECT id, 'e:' || email FROM c WHERE email IS NOT NULL),
f AS (SELECT id, 'opt_out' AS flag, id % 3 AS source FROM c WHERE id % 90 = 0), b AS (SELECT DISTINCT key, flag, source FROM ik JOIN f USING (id)),
fl AS (SELECT person AS cluster, string_agg(DISTINCT flag || ':' || source, ',' ORDER BY flag || ':' || source) AS flags FROM (SELECT id, flag, source FROM f UNION SELECT id, flag, source FROM ik JOIN b USING (key)) x JOIN c USING (id) GROUP BY 1)
SELECT m.cluster, linkedin, email, name, title, coalesce(employers, '') AS employers, coalesce(contacts, '') AS contacts, primary_domain, coalesce(flags, '') AS flags, fingerprint, CASE WHEN fingerprint = was THEN v ELSE coalesce(v, 0) + 1 END::INTEGER AS version
FROM m LEFT JOIN em USING (cluster) LEFT JOIN dv USING (cluster) LEFT JOIN rc USING (cluster) LEFT JOIN fl USING (cluster) LEFT JOIN p0 USING (cluster)""")
def j1b(t: Tables) -> DataFrame:
    """Persons stand for clusters; what was projected before is what the log held by 2001."""
    c = contributions(t)
    rank = F.struct((~F.col("verified")).alias("a"), (-F.unix_micros(F.col("fetched_at").cast("timestamp"))).alias("b"), F.col("id").alias("c"))
    digest = F.concat(F.lit("r"), F.col("id").cast("string"))
    log = J.stated(c, "person", {p: F.col(p) for p in (*RECORD, "employer", "domain")}, rank, digest)
    flags = c.filter("id % 90 = 0").select("id", F.lit("opt_out").alias("flag"), (F.col("id") % 3).alias("source"))
    old = c.filter("fetched_at < TIMESTAMP '2001-01-01'").groupBy(F.col("person").alias("cluster"))
    prior = old.agg(F.sum(F.conv(F.substring(F.md5(F.concat(F.lit("r"), F.col("id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("fingerprint"))
    prior = prior.withColumn("version", (F.col("cluster") % 3 + 1).cast("int"))
    return J.project_leads(log, list(RECORD), "email", "employer", "domain", P.compliance_reports(c.select("id", F.col("person").alias("cluster")), flags, c), prior)
