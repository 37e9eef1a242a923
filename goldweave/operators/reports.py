"""Counts, funnels, ledgers and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_with_zero(keys: DataFrame, rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows of every key; a key without rows counts zero."""
    return keys.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").select(key, F.coalesce(name, F.lit(0)).alias(name))


def count_kinds(rows: DataFrame, group: str, kind: str, kinds: dict[str, str]) -> DataFrame:
    """One column a kind, named by the mapping."""
    return rows.groupBy(group).agg(*[F.count_if(F.col(kind) == k).alias(n) for k, n in kinds.items()])


def scorecard(rows: DataFrame, group: str, expected: Column, predicted: Column) -> DataFrame:
    """Confusion counts and precision, recall, F1; null where nothing is divided by."""
    tp, fp, fn, tn = (F.count_if(x) for x in (expected & predicted, ~expected & predicted, expected & ~predicted, ~expected & ~predicted))
    c = rows.groupBy(group).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    share = lambda a, b: F.when(b != 0, a / b)
    return c.select(
        group, "tp", "fp", "fn", "tn", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def breakdown(rows: DataFrame, wanted: str, got: str) -> DataFrame:
    """(wanted, right, wrong): wrong answers as ``answer:count``, sorted."""
    n = rows.groupBy(wanted, got).agg(F.count("*").alias("n"))
    wrong = F.array_sort(F.collect_list(F.when(F.col(wanted) != F.col(got), F.concat_ws(":", got, F.col("n").cast("string")))))
    right = F.sum(F.when(F.col(wanted) == F.col(got), F.col("n")).otherwise(0))
    return n.groupBy(wanted).agg(right.alias("right"), F.array_join(wrong, ",").alias("wrong"))


def confusion(rows: DataFrame, wanted: str, got: str) -> DataFrame:
    """(wanted, got, n, share): how often each answer was given, and its share of the wanted label; no answer is ``dropped``."""
    n = rows.groupBy(wanted, F.coalesce(F.col(got).cast("string"), F.lit("dropped")).alias(got)).agg(F.count("*").alias("n"))
    every = n.groupBy(wanted).agg(F.sum("n").alias("_all")).withColumnRenamed(wanted, "_wanted")
    return n.join(every, F.col(wanted).eqNullSafe(F.col("_wanted"))).select(wanted, got, "n", (F.col("n") / F.col("_all")).alias("share"))


def match_answers(records: DataFrame, answers: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(id, person): who of ``answers`` (person, one column a kind) a record (id, the same columns) is, by the first kind that finds someone."""
    flat = lambda df, key: df.select(key, F.inline(F.array(*[F.struct(F.lit(i).alias("_rank"), F.col(k).alias("_value")) for i, k in enumerate(kinds)]))).filter("_value is not null")
    hits = flat(records, "id").join(flat(answers, "person"), ["_rank", "_value"])
    return hits.groupBy("id").agg(F.min_by("person", F.struct("_rank", "person")).alias("person"))


def tally(rows: DataFrame, group: str, outcome: Column) -> DataFrame:
    """(group, passed, failed, skipped) of a three-valued outcome."""
    return rows.groupBy(group).agg(F.count_if(outcome).alias("passed"), F.count_if(~outcome).alias("failed"), F.count_if(outcome.isNull()).alias("skipped"))


def capped(rows: DataFrame, group: str, value: str, shown: int) -> DataFrame:
    """(group, first, omitted): the first ``shown`` distinct values and how many more there are."""
    different = rows.select(group, value).distinct()
    sizes = different.groupBy(group).agg(F.count(value).cast("int").alias("_n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(value))  # only the first rows of a group leave a task
    first = different.filter(F.col(value).isNotNull()).withColumn("_place", place).filter(F.col("_place") <= shown)
    lists = first.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("first")).withColumnRenamed(group, "_group")
    out = sizes.join(lists, F.col(group).eqNullSafe(F.col("_group")), "left")
    return out.select(group, F.coalesce("first", F.lit("")).alias("first"), F.greatest(F.col("_n") - shown, F.lit(0)).alias("omitted"))


def leads_of_company(employments: DataFrame, lead: str, company: str, wanted) -> DataFrame:
    """(lead): who has ever worked at one company; the filter reaches the scan, and nobody else's rows are read further."""
    return employments.filter(F.col(company) == wanted).select(lead).distinct()


def ledger_totals(rows: DataFrame, group: str, cumulative: str, amount: str, seq: str) -> DataFrame:
    """Last cumulative figure and sum over phases; a total of nothing stays null."""
    return rows.groupBy(group).agg(F.max_by(cumulative, seq).alias(cumulative), F.sum(amount).alias(amount))


def exit_codes(rows: DataFrame, group: str, succeeded: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.when(F.bool_or(succeeded), 0).otherwise(1).alias("exit_code"))


def to_lines(rows: DataFrame, *keys: str) -> DataFrame:
    """One JSON line a row."""
    return rows.select(*keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys])).alias("line"))


def to_markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A table of a report, at most ``limit`` rows."""
    head = [f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}"]
    return "\n".join(head + [f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows.limit(limit).collect()])
