"""A lead as a whole from its log: record, employments, contacts, flags, primary domain and version, in one aggregation.

The log has a row for each stated value: cluster, path, value, rank (a struct, the least
wins), and one with the path ``MEMBER`` for each contribution, with its digest.  It is exchanged once, by cluster, with what all
parts need combined beforehand; flags and earlier versions are joined to the result, which
lies by cluster already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.functions.text import is_role_address


#: The path of a contribution's own row.
MEMBER = "member"


def stated(rows: DataFrame, cluster: str, paths: dict[str, Column], rank: Column, digest: Column) -> DataFrame:
    """(cluster, path, value, rank) of the values of ``rows`` that are not null, and of the rows themselves."""
    cells = [F.struct(F.lit(p).alias("path"), v.alias("value")) for p, v in (paths | {MEMBER: digest}).items()]
    return rows.select(F.col(cluster).alias("cluster"), rank.alias("rank"), F.inline(F.array(*cells))).filter("value is not null")


def project_leads(log: DataFrame, record: list[str], email: str, employer: str, domain: str, flags: DataFrame, prior: DataFrame) -> DataFrame:
    """(cluster, *record, employers, contacts, primary_domain, flags, fingerprint, version).

    Employers and contacts are sorted and joined by commas; contacts are generic inboxes
    other than the chosen address; the primary domain is the one stated most often, the
    lowest on ties; ``flags`` is (cluster, flag, source), ``prior`` (cluster, fingerprint,
    version).  The version rises by one where the fingerprint of the members is new.
    """
    of = lambda path: F.when(F.col("path") == path, F.col("value"))
    won = [F.min_by(of(p), F.when(F.col("path") == p, F.col("rank"))).alias(p) for p in record]
    boxes = F.collect_set(F.when((F.col("path") == email) & is_role_address(F.col("value")), F.col("value"))).alias("_boxes")
    member = F.when(F.col("path") == MEMBER, F.conv(F.substring(F.md5(F.col("value").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)"))
    sums = log.groupBy("cluster").agg(
        *won, F.array_join(F.array_sort(F.collect_set(of(employer))), ",").alias("employers"), boxes,
        F.mode(of(domain), True).alias("primary_domain"), F.sum(member).cast("string").alias("fingerprint"),
    )
    contacts = F.array_join(F.array_sort(F.filter("_boxes", lambda x: ~x.eqNullSafe(F.col(email)))), ",").alias("contacts")
    leads = sums.select("cluster", *record, "employers", contacts, "primary_domain", "fingerprint")
    set_flags = flags.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "flag", F.col("source").cast("string")))), ",").alias("flags"))
    old = prior.select("cluster", F.col("fingerprint").alias("_was"), F.col("version").alias("_version"))
    joined = leads.join(set_flags, "cluster", "left").join(old, "cluster", "left")
    version = F.when(F.col("fingerprint").eqNullSafe(F.col("_was")), F.col("_version")).otherwise(F.coalesce("_version", F.lit(0)) + 1)
    return joined.select("cluster", *record, "employers", "contacts", "primary_domain", F.coalesce("flags", F.lit("")).alias("flags"), "fingerprint", version.cast("int").alias("version"))
