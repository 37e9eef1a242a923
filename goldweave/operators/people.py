"""People and companies as components: whom to ask, and by which anchor; work lists, anchors, contacts, flags.

A record has: id (its place in the work list), linkedin, email, name, domains (array);
all but id may be null.  A person is a component over shared addresses and profiles, a
company one over shared domains; a person's records never join two companies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.functions.text import is_role_address, normalize_email
from goldweave.operators.graph import label_all, star_edges
from goldweave.operators.sequence import number_groups
from goldweave.storage import materialize

# Anchors of an answer and rungs of a ladder, strongest first.
ANCHORS = ("linkedin_url", "email", "name", "own")
RUNGS = ("id", "linkedin", "email", "name_domain")


def identities(records: DataFrame) -> DataFrame:
    """(id, identity): what a record shares with others of its person."""
    held = F.array(F.concat(F.lit("l:"), "linkedin"), F.concat(F.lit("e:"), "email"))
    return records.select("id", F.explode(F.array_compact(held)).alias("identity"))


def person_labels(records: DataFrame) -> DataFrame:
    """(id, person): the smallest id of each person."""
    return label_all(records.select("id").distinct(), "id", star_edges(identities(records), "id", "identity"), "person")


def company_labels(records: DataFrame) -> DataFrame:
    """(id, company) of the records with domains: the smallest id of each company."""
    flat = records.select("id", F.explode("domains").alias("domain"))
    return label_all(flat.select("id").distinct(), "id", star_edges(flat, "id", "domain"), "company")


def company_work_list(records: DataFrame) -> DataFrame:
    """(id, company, person): the first record of each company; of people without any company, their first record.

    ``company`` is null for the latter.  Records without a domain of people who have one
    elsewhere are left out.
    """
    people, companies = person_labels(records), company_labels(records)
    rows = materialize(people.join(companies, "id", "left"), "labels")
    placed = rows.filter("company is not null").select("person").distinct()
    first = rows.filter("company is not null").groupBy("company").agg(F.min_by(F.struct("id", "person"), "id").alias("f")).select("f.id", "company", "f.person")
    loose = rows.filter("company is null").join(placed, "person", "left_anti").groupBy("person").agg(F.min("id").alias("id"))
    return first.unionByName(loose.select("id", F.lit(None).cast(rows.schema["company"].dataType).alias("company"), "person"))


def company_anchors(records: DataFrame, source: str, echoed: str) -> DataFrame:
    """(company, domain, sources): the domains of each company, and how many sources name it other than by echo of a request."""
    named = materialize(records.join(company_labels(records), "id"), "named")
    sources = named.groupBy("company").agg(F.count_distinct(F.when(~F.col(echoed), F.col(source))).alias("sources"))
    return named.select("company", F.explode("domains").alias("domain")).distinct().join(sources, "company")


def ask_people(records: DataFrame, lookups: Column, anchor: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Askers (asker, person, anchor, linkedin), their ladders (asker, rung, lookup), and (person) whom no answer could reach.

    ``lookups`` is an array of struct(rung, lookup), ``anchor`` the record's own strongest
    anchor or null.  The records of a person share one ladder and one answer, on the
    strongest anchor of a record that has lookups of its own; a component with two
    profiles or two names is nobody, and each of its records asks for itself.
    """
    asked = records.select("id", lookups.alias("lookups"))
    rank = F.array_position(F.array(*map(F.lit, ANCHORS)), anchor)
    stated = records.select("id", "linkedin", "name", (F.size(lookups) > 0).alias("able"), anchor.alias("anchor"), rank.alias("rank"))
    rows = materialize(stated.join(person_labels(records), "id"), "people")
    # Of values that are all equal the least is the greatest; counting different ones would shuffle each row three times.
    alike = lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True))
    best = F.min(F.when(F.col("able") & F.col("anchor").isNotNull(), F.struct("rank", "id", "anchor")))
    sums = rows.groupBy("person").agg(F.count("*").alias("n"), alike("linkedin").alias("profiles"), alike("name").alias("names"), F.max("linkedin").alias("profile"), F.max("able").alias("any"), best.alias("best"))
    one = materialize(sums.filter("n > 1 and profiles and names").select("person", "profile", "any", "best"), "one")
    own = rows.filter("able").join(one, "person", "left_anti")
    shared = one.filter("best is not null").select(F.col("best.id").alias("asker"), "person", "best.anchor", F.col("profile").alias("linkedin"))
    askers = shared.unionByName(own.filter("anchor is not null").select(F.col("id").alias("asker"), "person", "anchor", "linkedin"))
    asks = rows.filter("able").join(one.select("person", "best", F.lit(True).alias("one")), "person", "left")
    asks = asks.select("id", F.when(F.col("one"), F.col("best.id")).when(F.col("anchor").isNotNull(), F.col("id")).alias("asker")).filter("asker is not null")
    ladder = asks.join(asked, "id").select("asker", F.inline("lookups")).distinct()
    lost = one.filter("any and best is null").select("person").unionByName(own.filter("anchor is null").select("person")).distinct()
    return askers, ladder, lost


def role_contacts(stated: DataFrame, cluster: str, email: str, chosen: str) -> DataFrame:
    """(cluster, contact): generic inboxes stated for a lead, other than its chosen address."""
    address = normalize_email(F.col(email))
    rows = stated.select(cluster, address.alias("contact"), normalize_email(F.col(chosen)).alias("_chosen"))
    return rows.filter(is_role_address(F.col("contact")) & ~F.col("contact").eqNullSafe(F.col("_chosen"))).select(cluster, "contact").distinct()


def compliance_reports(members: DataFrame, flags: DataFrame, records: DataFrame) -> DataFrame:
    """(cluster, flag, source): flags stated by a lead's records, and those that any record with one of their identities states.

    ``members`` is (id, cluster), ``flags`` (id, flag, source) of flags that are set.
    """
    ids = identities(records)
    blocked = ids.join(flags, "id").select("identity", "flag", "source").distinct()
    linked = ids.join(blocked, "identity").select("id", "flag", "source")
    return flags.select("id", "flag", "source").unionByName(linked).join(members, "id").select("cluster", "flag", "source").distinct()


def numbered_ids(anchors: DataFrame, cluster: str, digest: str, content: str) -> DataFrame:
    """(cluster, cluster_id): the digest of a cluster's anchor; of equal ones the second gets -2 and so on, in order of content, then cluster.

    Digests that stand once, nearly all, are never sorted.
    """
    several = anchors.groupBy(digest).agg(F.count("*").alias("_n")).filter("_n > 1").select(digest)
    several = materialize(several, "equal-digests")
    once = anchors.join(several, digest, "left_anti").select(cluster, F.col(digest).alias("cluster_id"))
    again = number_groups(anchors.join(several, digest, "left_semi").select(cluster, digest, content), [digest], content, cluster)
    named = F.when(F.col("place") == 1, F.col(digest)).otherwise(F.concat_ws("-", digest, F.col("place").cast("string")))
    return once.unionByName(again.select(cluster, named.alias("cluster_id")))
