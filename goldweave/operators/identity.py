"""Identity resolution over contributions by ranked match keys.

A contribution row has: id, linkedin, email, verified (boolean), name, domain, title,
employer, fetched_at; all but id may be null. Results are functions of the set of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.functions.text import is_role_address
from goldweave.operators.graph import connected_components, label_all, star_edges
from goldweave.storage import materialize

SEPARATOR = "\u001f"


def name_domain(name: Column, domain: Column) -> Column:
    return F.when(name.isNotNull() & domain.isNotNull(), F.concat(name, F.lit(SEPARATOR), domain))


def conflict(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys whose addresses name two people: two verified ones, or no verified and two guesses."""
    verified = F.count_distinct(F.when(F.col("verified"), F.col("email")))
    guessed = F.count_distinct(F.when(~F.col("verified"), F.col("email")))
    sums = rows.filter(F.col("email").isNotNull()).groupBy(*keys).agg(verified.alias("v"), guessed.alias("g"))
    return sums.filter((F.col("v") > 1) | ((F.col("v") == 0) & (F.col("g") > 1))).select(*keys)


def shared_addresses(c: DataFrame) -> DataFrame:
    """(email): addresses of several names or profiles, and of generic inboxes."""
    by = c.filter(F.col("email").isNotNull()).groupBy("email").agg(F.count_distinct("name").alias("names"), F.count_distinct("linkedin").alias("urls"))
    return by.filter((F.col("names") > 1) | (F.col("urls") > 1) | is_role_address(F.col("email"))).select("email")


def ambiguous_names(c: DataFrame, addresses: DataFrame) -> DataFrame:
    """(candidate): name and domain of several profiles, or of bare rows whose addresses conflict."""
    named = c.withColumn("candidate", name_domain(F.col("name"), F.col("domain"))).filter(F.col("candidate").isNotNull())
    several = named.groupBy("candidate").agg(F.count_distinct("linkedin").alias("n")).filter("n > 1").select("candidate")
    bare = named.filter(F.col("linkedin").isNull()).join(addresses, "email", "left_anti")
    return several.unionByName(conflict(bare, "candidate")).distinct()


def match_keys(c: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """(id, kind, value, barred): kinds 1 profile, 2 verified address, 3 name and domain."""
    addresses = shared_addresses(c) if addresses is None else addresses
    names = ambiguous_names(c, addresses)
    keys = c.select(
        "id",
        F.explode(F.array(
            F.struct(F.lit(1).alias("kind"), F.col("linkedin").alias("value")),
            F.struct(F.lit(2).alias("kind"), F.when(F.col("verified"), F.col("email")).alias("value")),
            F.struct(F.lit(3).alias("kind"), name_domain(F.col("name"), F.col("domain")).alias("value")),
        )).alias("k"),
    ).select("id", "k.kind", "k.value").filter(F.col("value").isNotNull())
    bars = addresses.select(F.lit(2).alias("kind"), F.col("email").alias("value")).unionByName(names.select(F.lit(3).alias("kind"), F.col("candidate").alias("value")))
    return keys.join(bars.withColumn("barred", F.lit(True)), ["kind", "value"], "left").select("id", "kind", "value", F.coalesce("barred", F.lit(False)).alias("barred"))


def email_links(c: DataFrame, keys: DataFrame) -> DataFrame:
    """(u, v): holders of a verified address hang on its smallest holder without a profile, if there is one."""
    bare = c.filter(F.col("linkedin").isNull()).select("id")
    mail = keys.filter(~F.col("barred") & (F.col("kind") == 2)).join(bare.withColumn("bare", F.lit(True)), "id", "left")
    hub = mail.groupBy("value").agg(F.min(F.when(F.col("bare"), F.col("id"))).alias("u")).filter("u is not null")
    return mail.join(hub, "value").select("u", F.col("id").alias("v")).filter("u <> v")


def link_edges(c: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(u, v): all links of the three kinds as stars; what several of them need is stored once."""
    addresses = materialize(shared_addresses(c), "addresses")
    keys = materialize(match_keys(c, addresses), "keys") if keys is None else keys
    usable = keys.filter(~F.col("barred"))
    bare = c.filter(F.col("linkedin").isNull()).select("id")
    by_profile = star_edges(usable.filter("kind = 1"), "id", "value")
    by_mail = email_links(c, keys)

    named = usable.filter("kind = 3").join(bare, "id", "left_semi").join(c.select("id", "title", "employer"), "id")
    kinds = F.array(F.struct(F.lit("title").alias("k"), F.col("title").alias("x")), F.struct(F.lit("employer").alias("k"), F.col("employer").alias("x")))
    buckets = named.select("id", "value", F.explode(kinds).alias("b")).filter("b.x is not null")
    near = materialize(star_edges(buckets, "id", "value", F.col("b.k"), F.col("b.x")), "near")
    groups = connected_components(near).withColumnRenamed("node", "id")
    stated = c.join(addresses, "email", "left_anti").select("id", "email", "verified")
    split = conflict(groups.join(stated, "id"), "component")
    by_name = near.join(groups.join(split, "component", "left_semi").select(F.col("id").alias("u")), "u", "left_anti")
    return by_profile.unionByName(by_mail).unionByName(by_name).distinct()


def clusters(c: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id of each identity."""
    return label_all(c.select("id"), "id", link_edges(c), "cluster")


def cluster_ids(c: DataFrame, labels: DataFrame, content: Column) -> DataFrame:
    """(cluster, cluster_id): the digest of the earliest-fetched member's content."""
    first = F.min_by(F.sha2(content, 256), F.struct("fetched_at", content))
    return c.join(labels, "id").groupBy("cluster").agg(first.alias("cluster_id"))


def join_keyless(c: DataFrame, labels: DataFrame, keys: DataFrame, record: Column) -> DataFrame:
    """(id, cluster): rows without any key join the one cluster that holds their source record."""
    loose = c.join(keys.select("id").distinct(), "id", "left_anti").select("id", record.alias("record")).filter("record is not null")
    held = c.select("id", record.alias("record")).filter("record is not null").join(keys.select("id").distinct(), "id", "left_semi").join(labels, "id")
    owner = held.groupBy("record").agg(F.min("cluster").alias("owner"), F.count_distinct("cluster").alias("owners"))
    least = loose.groupBy("record").agg(F.min("id").alias("least"))
    target = loose.join(owner, "record", "left").join(least, "record")
    moved = target.select("id", F.when(F.col("owners").isNull(), F.col("least")).when(F.col("owners") == 1, F.col("owner")).otherwise(F.col("id")).alias("moved"))
    return labels.join(moved, "id", "left").select("id", F.coalesce("moved", "cluster").alias("cluster"))


def over_merged(c: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, names): clusters with two or more distinct names that are not masked."""
    named = c.filter(F.col("name").isNotNull() & (F.instr("name", "*") == 0)).join(labels, "id")
    return named.groupBy("cluster").agg(F.count_distinct("name").alias("names")).filter("names > 1")


def prune_flagged(c: DataFrame, labels: DataFrame, flagged: DataFrame) -> DataFrame:
    """Rows of ``c`` whose identity holds no flagged row."""
    lost = labels.join(flagged.select("id"), "id", "left_semi").select("cluster").distinct()
    return c.join(labels.join(lost, "cluster", "left_semi").select("id"), "id", "left_anti")


def blocked_identities(c: DataFrame, flags: DataFrame) -> DataFrame:
    """(id, flag, source): flags of every row that shares a profile or address with a flagged one."""
    ids = c.select("id", F.explode(F.array_compact(F.array(F.concat(F.lit("l:"), "linkedin"), F.concat(F.lit("e:"), "email")))).alias("identity"))
    blocked = ids.join(flags, "id").select("identity", "flag", "source").distinct()
    return ids.join(blocked, "identity").select("id", "flag", "source").distinct()


def company_clusters(rows: DataFrame, record: str, domains: str) -> DataFrame:
    """(record, cluster): records whose domain sets overlap, through others too."""
    flat = rows.select(record, F.explode(domains).alias("domain"))
    return label_all(rows.select(record).distinct(), record, star_edges(flat, record, "domain"), "cluster")


def unambiguous(rows: DataFrame, question: str, identity: str) -> DataFrame:
    """Rows whose question is asked by one identity only."""
    once = rows.groupBy(question).agg(F.count_distinct(identity).alias("n")).filter("n <= 1").select(question)
    return rows.join(once, question, "left_semi")


def all_keys_match(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lead) that hold every wanted key: relational division."""
    need = wanted.select(F.count_distinct("key").alias("need"))
    held = index.join(wanted.select("key").distinct(), "key").groupBy("lead").agg(F.count_distinct("key").alias("n"))
    return held.join(F.broadcast(need)).filter("n = need").select("lead")
