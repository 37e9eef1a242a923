"""Merges as a whole: employments, stored leads, mappings, logs, profiles, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.functions.values import still_employed
from goldweave.operators.reports import capped
from goldweave.operators.resolve import assign_leads
from goldweave.storage import materialize


def employments(jobs: DataFrame, key: str, company: str) -> DataFrame:
    """(key, employments): one struct(company, is_current) a company, sorted; null where it is not stated."""
    stated = F.collect_list(F.struct(F.col("is_current").alias("c")))
    one = jobs.groupBy(key, company).agg(stated.alias("j")).select(key, F.col(company).alias("company"), still_employed(F.transform("j", lambda x: x["c"])).alias("is_current"))
    return one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("company", "is_current"))).alias("employments"))


def resolve_ties(asked: DataFrame, valid: list[str]) -> DataFrame:
    """(tie_key, answer, source): the first valid answer of each tie stays for good."""
    good = asked.filter(F.col("answer").isin(*valid))
    first = good.groupBy("tie_key").agg(F.min_by("answer", "seq").alias("answer"), F.bool_or("stored").alias("stored"))
    return first.select("tie_key", "answer", F.when(F.col("stored"), "stored").otherwise("resolved").alias("source"))


def swap_company(companies: Column, shared: Column, own: Column) -> Column:
    """A company id that a lead owns in place of the shared one."""
    return F.transform(companies, lambda c: F.when(c == shared, own).otherwise(c))


def merge_log(labels: DataFrame, cluster: str, member: str, shown: int) -> DataFrame:
    """(cluster, members, omitted) of clusters of two or more."""
    several = labels.groupBy(cluster).agg(F.count("*").alias("n")).filter("n > 1").select(cluster)
    log = capped(labels.join(several, cluster), cluster, member, shown)
    return log.select(cluster, F.col("first").alias("members"), "omitted")


def assemble(base: DataFrame, key: str, sides: dict[str, DataFrame], defaults: dict[str, Column]) -> DataFrame:
    """``base`` with all side tables, each grouped by key beforehand: a fixed number of joins."""
    for side in sides.values():
        base = base.join(side, key, "left")
    return base.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def one_each(leads: DataFrame, verdicts: DataFrame, key: str, status: str) -> DataFrame:
    """(key, status, missing): exactly one decision a lead; a lead without a verdict is marked."""
    one = verdicts.groupBy(key).agg(F.min(status).alias(status))
    return leads.distinct().join(one, key, "left").withColumn("missing", F.col(status).isNull())


def to_profile(words: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """(term, one column a source): its words, sorted; null where a source has none."""
    listed = {s: F.array_sort(F.collect_set(F.when(F.col("source") == s, F.col("word")))) for s in sources}
    return words.groupBy("term").agg(*[F.when(F.size(v) > 0, F.array_join(v, ",")).alias(s) for s, v in listed.items()])


def merge_mapping(labels: DataFrame, prior: DataFrame, fresh: Column) -> DataFrame:
    """(key, lead): kept leads where a cluster continues one, ``fresh`` ids elsewhere."""
    kept, _ = assign_leads(labels, prior)
    return labels.join(kept, "cluster", "left").select("key", F.coalesce("lead", fresh).alias("lead"))


def manifest_faults(files: DataFrame, manifest: DataFrame, today: Column) -> DataFrame:
    """(file, fault): files that no manifest lists, and entries dated ahead."""
    both = files.join(manifest, "file", "left")
    fault = F.when(F.col("recorded_on").isNull(), "unlisted").when(F.col("recorded_on") > today, "dated_ahead")
    return both.select("file", fault.alias("fault")).filter("fault is not null")


def merge_tables(c: DataFrame, labels: DataFrame, keys: DataFrame, prior: DataFrame, won: DataFrame) -> dict[str, DataFrame]:
    """All that a merge stores, by name.

    ``c`` are contributions (id, fetched_at, ...), ``labels`` (id, cluster), ``keys`` (id, kind,
    value, barred), ``prior`` (key, lead, seniority) and ``won`` the winners (cluster, path,
    source, value). A cluster without a lead of old gets a new one, behind the last.
    What several of the tables need is stored once.
    """
    assigned, retired = assign_leads(labels.withColumnRenamed("id", "key"), prior)
    last = prior.agg(F.coalesce(F.max("lead"), F.lit(0)).alias("last"))
    leads = materialize(assigned.join(F.broadcast(last)).select("cluster", F.coalesce("lead", F.col("cluster") + F.col("last") + 1).alias("lead")), "leads")
    mapping = materialize(labels.join(leads, "cluster").select("id", "lead"), "mapping")
    members = c.select("id", "fetched_at").join(mapping, "id").groupBy("lead")
    identities = members.agg(F.count("*").alias("members"), F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_seen"))
    succession = retired.join(leads, retired["successor"] == leads["cluster"]).select(retired["lead"].alias("retired"), leads["lead"].alias("successor")).distinct()
    held = materialize(won.join(leads, "cluster").select("lead", "path", "source", "value"), "held")
    index = keys.filter(~F.col("barred")).join(mapping, "id").select("lead", "kind", "value").distinct()
    return {
        "identities": identities, "succession": succession, "mapping": mapping, "canonical": held.select("lead", "path", "value"),
        "provenance": held.select("lead", "path", "source"), "index": index,
    }


def persist_merge(tables: dict[str, DataFrame], root: str) -> int:
    """Stores the tables of a merge as one version; readers see all of them or none."""
    from goldweave.storage import commit_tables

    return commit_tables(tables, root)
