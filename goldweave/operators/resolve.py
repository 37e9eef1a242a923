"""Conflict resolution under a total order, and what follows from the ranks.

A candidate row has: cluster, path, source, value (canonical text), trust, tier,
confidence, fetched_at, raw_path, and may have preferred (lower first) and echo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What tells one contribution to a cluster from another.
CONTRIBUTION = ("source", "raw_path", "fetched_at")
#: Names of the order's components, in order; the last decides nothing but ties.
RULES = ("preferred", "trust", "origin", "confidence", "recency", "source", "value_hash")


def observed_first(candidates: DataFrame) -> DataFrame:
    """Echoes of a request count only where nothing was observed."""
    w = Window.partitionBy("cluster", "path")
    seen = candidates.withColumn("_seen", F.max((~F.col("echo")).cast("int")).over(w) == 1)
    return seen.filter(~F.col("_seen") | ~F.col("echo")).drop("_seen")


def order_columns() -> list[Column]:
    """Ascending components of the total order; an absent confidence ranks as zero."""
    return [
        F.col("preferred"), -F.col("trust"), -F.col("tier"), -F.coalesce("confidence", F.lit(0.0)),
        -F.unix_micros(F.col("fetched_at").cast("timestamp")), F.col("source"), F.sha2("value", 256), F.col("raw_path"),
    ]


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """``candidates`` with rank (1 wins), winner's value, and role: winner, agreeing, superseded."""
    rows = candidates if "preferred" in candidates.columns else candidates.withColumn("preferred", F.lit(0))
    w = Window.partitionBy("cluster", "path").orderBy(*order_columns())
    ranked = rows.withColumn("rank", F.row_number().over(w)).withColumn("winning_value", F.first("value").over(w))
    role = F.when(F.col("rank") == 1, "winner").when(F.col("value") == F.col("winning_value"), "agreeing").otherwise("superseded")
    return ranked.withColumn("role", role)


def winners(candidates: DataFrame) -> DataFrame:
    """One row a (cluster, path) without sorting: the least order struct wins by partial aggregation."""
    rows = candidates if "preferred" in candidates.columns else candidates.withColumn("preferred", F.lit(0))
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_columns())])
    return rows.groupBy("cluster", "path").agg(F.min_by(F.struct("source", "value"), key).alias("w")).select("cluster", "path", "w.*")


def paired_status(candidates: DataFrame, path: str, status_path: str) -> DataFrame:
    """(cluster, value, status): the winning value of ``path`` and the status that came with it.

    Of the contributions that hold the winning value, the best one that also states a
    status gives it; a status from elsewhere never counts. Without one it is unknown.
    """
    seen = observed_first(candidates)
    rows = seen.filter(F.col("path") == path)
    won = winners(rows).select("cluster", "value")
    stated = seen.filter(F.col("path") == status_path).select("cluster", *CONTRIBUTION, F.col("value").alias("status"))
    keyed = rows if "preferred" in rows.columns else rows.withColumn("preferred", F.lit(0))
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_columns())])
    held = keyed.select("cluster", "value", *CONTRIBUTION, key.alias("key")).join(won, ["cluster", "value"]).join(stated, ["cluster", *CONTRIBUTION])
    best = held.groupBy("cluster").agg(F.min_by("status", F.struct("key", "status")).alias("status"))
    return won.join(best, "cluster", "left").select("cluster", "value", F.coalesce("status", F.lit("unknown")).alias("status"))


def decided_by(ranked: DataFrame) -> DataFrame:
    """(cluster, path, decided_by): the first component on which the winner beats the best other value."""
    parts = [c.alias(f"o{i}") for i, c in enumerate(order_columns())]
    won = F.min_by(F.struct(*parts), F.when(F.col("role") == "winner", F.col("rank")))
    lost = F.min_by(F.struct(*parts), F.when(F.col("role") == "superseded", F.col("rank")))
    both = ranked.groupBy("cluster", "path").agg(won.alias("a"), lost.alias("b"))
    rule = F.lit("tie_break")
    for i, name in reversed(list(enumerate(RULES))):
        rule = F.when(F.col(f"a.o{i}") != F.col(f"b.o{i}"), name).otherwise(rule)
    return both.select("cluster", "path", F.when(F.col("b").isNotNull(), rule).alias("decided_by"))


def flagged_first(ranked: DataFrame, is_flag: Column) -> DataFrame:
    """The first candidate that sets a flag leads its path, whatever its trust."""
    w = Window.partitionBy("cluster", "path").orderBy(F.desc(is_flag), "rank")
    return ranked.withColumn("rank", F.row_number().over(w))


def agreement(ranked: DataFrame) -> DataFrame:
    """(cluster, path, agreeing_sources): distinct sources of the winning value."""
    same = F.when(F.col("role") != "superseded", F.col("source"))
    return ranked.groupBy("cluster", "path").agg(F.count_distinct(same).alias("agreeing_sources"))


def elect(votes: DataFrame, group: str, voter: str, choice: str, weight: Column) -> DataFrame:
    """(group, choice, tied, tied_choices): weighted votes, one a voter and choice; the lowest of a tie."""
    sums = votes.select(group, voter, choice, weight.alias("w")).distinct().groupBy(group, choice).agg(F.sum("w").alias("w"))
    best = sums.groupBy(group).agg(F.max("w").alias("top"), F.collect_list(F.struct("w", choice)).alias("all"))
    lead = F.array_sort(F.transform(F.filter("all", lambda x: x["w"] == F.col("top")), lambda x: x[choice]))
    out = best.select(group, lead.alias("l"))
    tied = F.size("l") > 1
    return out.select(group, F.element_at("l", 1).alias(choice), tied.alias("tied"), F.when(tied, F.array_join("l", ",")).otherwise("").alias("tied_choices"))


def union_signals(rows: DataFrame, group: str, label: str, strength: str, order: str) -> DataFrame:
    """(group, label, strength): each label once, with the strength of its first candidate."""
    return rows.groupBy(group, label).agg(F.min_by(strength, order).alias(strength))


def latest(rows: DataFrame, keys: list[str], value: str, at: str, tie: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(at, tie)).alias(value))


def golden_record(won: DataFrame, cluster: str, paths: list[str], keep_if_any: list[str]) -> DataFrame:
    """Winners as columns; a cluster without any of ``keep_if_any`` has no record."""
    wide = won.groupBy(cluster).agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(p) for p in paths])
    return wide.filter(F.coalesce(*[F.col(c) for c in keep_if_any]).isNotNull())


def assign_leads(clusters: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which prior lead each cluster keeps, and the successors of retired ones.

    ``clusters`` is (key, cluster), ``prior`` (key, lead, seniority). A lead continues
    where one cluster holds all its keys; of several the most senior stays.
    """
    held = clusters.join(prior, "key").groupBy("lead").agg(F.collect_set("cluster").alias("c"), F.min("seniority").alias("seniority"))
    going = held.filter(F.size("c") == 1).select("lead", "seniority", F.element_at("c", 1).alias("cluster"))
    kept = going.groupBy("cluster").agg(F.min_by("lead", F.struct("seniority", "lead")).alias("lead"))
    assigned = clusters.select("cluster").distinct().join(kept, "cluster", "left")
    retired = held.join(kept.select("lead"), "lead", "left_anti").select("lead", F.explode("c").alias("successor"))
    return assigned, retired


def changed_clusters(before: DataFrame, after: DataFrame, key: str = "key", cluster: str = "cluster") -> DataFrame:
    """(cluster) of ``after`` whose exact member set is no cluster of ``before``.

    Sets are never held together: clusters whose count and two sums of member hashes agree
    are compared member by member through a join.
    """
    rows = [d.select(F.col(cluster).alias("c"), F.col(key).alias("k")).distinct() for d in (before, after)]
    digest = (F.count("*").alias("n"), F.sum(F.xxhash64("k").cast("decimal(20,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "k")).alias("x"))
    old, new = (d.groupBy("c").agg(*digest) for d in rows)
    alike = new.join(old.groupBy("n", "h", "x").agg(F.min("c").alias("was")), ["n", "h", "x"]).select("c", "was", "n")
    members = rows[1].join(alike, "c").join(rows[0].select(F.col("c").alias("was"), "k"), ["was", "k"])
    same = members.groupBy("c", "n").agg(F.count("*").alias("common")).filter("common = n")
    return new.select("c").join(same, "c", "left_anti").withColumnRenamed("c", cluster)


def version_stamp(now: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint, version): one more where the fingerprint is new."""
    old = prior.select(key, F.col("fingerprint").alias("was"), F.col("version").alias("v"))
    same = F.col("fingerprint").eqNullSafe(F.col("was"))
    return now.join(old, key, "left").select(key, "fingerprint", F.when(same, F.col("v")).otherwise(F.coalesce("v", F.lit(0)) + 1).alias("version"))
