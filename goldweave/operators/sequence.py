"""Event sequences: what is due, ticks, seeded acceptance, rate limits, ledgers, lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.functions.values import unit_interval
from goldweave.storage import materialize

KINDS = ("invite", "accepted", "email", "fallback_email", "stalled", "halted")
FINAL = ("email", "fallback_email", "stalled")


def first_per_kind(events: DataFrame, key: str, kind: str, at: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(key, one column a kind): when each kind first happened; one aggregation, no sort."""
    return events.groupBy(key).agg(*[F.min(F.when(F.col(kind) == k, F.col(at))).alias(k) for k in kinds])


def due_action(now: Column, opted_out: Column, usable_email: Column, accept_days: int = 2, timeout_days: int = 5) -> Column:
    """The action that is owed now, or null; over the columns of ``first_per_kind``."""
    days = lambda n: F.make_dt_interval(F.lit(n))
    final = F.coalesce(*[F.col(k) for k in FINAL]).isNotNull()
    answered = F.when(now >= F.col("accepted") + days(accept_days), "email")
    timed_out = F.when(now >= F.col("invite") + days(timeout_days), F.when(usable_email, "fallback_email").otherwise("stalled"))
    return (
        F.when(F.col("halted").isNotNull(), None).when(opted_out, "halted").when(final, None).when(F.col("invite").isNull(), "invite")
        .when(F.col("accepted").isNotNull(), answered).otherwise(timed_out)
    )


def seeded_acceptance(ident: Column, invited_at: Column, seed: int, rate: float, max_days: int) -> Column:
    """When a seeded person accepts an invitation, or null for never."""
    days = F.least(F.floor(unit_interval(seed, ident, "delay") * (max_days + 1)), F.lit(max_days)).cast("int")
    return F.when(unit_interval(seed, ident, "accept") < rate, invited_at + F.make_dt_interval(days))


def tick(events: DataFrame, now: Column, facts: DataFrame, seed: int, rate: float, max_days: int) -> DataFrame:
    """(key, kind, at): events that a tick at ``now`` appends: acceptances that came, then what is due.

    A second tick at the same ``now`` over the appended log appends nothing.
    """
    first = first_per_kind(events, "key", "kind", "at").join(facts, "key")
    came = seeded_acceptance(F.col("key"), F.col("invite"), seed, rate, max_days)
    fresh = F.when(F.col("accepted").isNull() & F.col("invite").isNotNull() & F.col("halted").isNull() & (came <= now), came)
    first = first.withColumn("fresh", fresh).withColumn("accepted", F.coalesce("accepted", "fresh"))
    acted = first.withColumn("act", due_action(now, F.col("opted_out"), F.col("usable_email")))
    rows = F.array_compact(F.array(
        F.when(F.col("fresh").isNotNull(), F.struct(F.lit("accepted").alias("kind"), F.col("fresh").alias("at"))),
        F.when(F.col("act").isNotNull(), F.struct(F.col("act").alias("kind"), now.alias("at"))),
    ))
    return acted.select("key", F.inline(rows))


def backoff_ceiling(attempt: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))


def last_status(ledger: DataFrame, key: str, status: str, seq: str) -> DataFrame:
    return ledger.groupBy(key).agg(F.max_by(status, seq).alias(status), F.count("*").alias("calls"))


def finish_runs(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """Running runs take their end; a finished one never changes. (run, status)"""
    end = ended.groupBy("run").agg(F.min_by("status", "seq").alias("end"))
    return runs.join(end, "run", "left").select("run", F.when(F.col("status") == "running", F.coalesce("end", "status")).otherwise(F.col("status")).alias("status"))


def number_all(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``place``: 1 for the first under a total order, without a gap."""
    return number_groups(rows, [], *order)


def number_groups(rows: DataFrame, groups: list[str], *order: Column | str) -> DataFrame:
    """``rows`` with ``place``: 1 for the first of its group under a total order, without a gap.

    Numbered in two levels: rows are dealt by ranges of group and order, numbered within
    their range, and ranges start behind the rows of their group before them. A group that
    holds most rows is spread over many tasks; one row a range and group is all that meets.
    """
    dealt = materialize(rows.repartitionByRange(*groups, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*groups, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("part", *groups).orderBy(*order))
    same = F.col("part") == F.col("_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    ranked = dealt.withColumn("inner", inner).join(starts, same)
    return ranked.withColumn("place", F.col("before") + F.col("inner")).select(*rows.columns, "place")
