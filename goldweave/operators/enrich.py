"""Lookups of providers as joins: ladders, routing, budgets of questions, echoes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.functions.text import normalize_email

RUNGS = ("id", "linkedin", "email", "name_domain", "name_org")


def ladder(people: DataFrame, key: str, answers: DataFrame, rungs: tuple[str, ...]) -> DataFrame:
    """(key, rung, answer): the first rung whose value has an answer.

    ``people`` has a column a rung; ``answers`` is (rung, value, answer). One join serves
    all rungs, and the first hit wins by aggregation.
    """
    asked = people.select(key, F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(r).alias("rung"), F.col(r).cast("string").alias("value")) for i, r in enumerate(rungs)])))
    hits = asked.filter(F.col("value").isNotNull()).join(answers, ["rung", "value"])
    best = F.min_by(F.struct("rung", "answer"), F.struct("place", "answer"))
    return hits.groupBy(key).agg(best.alias("b")).select(key, "b.rung", "b.answer")


def route(email: Column, name: Column, domain: Column) -> Column:
    """The cheapest question that answers: verify what is known, find a name, else search the domain."""
    return F.when(email.isNotNull(), "verifier").when(name.isNotNull() & domain.isNotNull(), "finder").when(domain.isNotNull(), "domain_search")


def union_of_hits(hits: DataFrame, record: str, term: str, seq: str) -> DataFrame:
    """(record, seq, terms): a record found by several questions once, with all their terms."""
    return hits.groupBy(record).agg(F.min(seq).alias(seq), F.array_join(F.array_sort(F.collect_set(term)), ",").alias("terms"))


def open_deals(contacts: DataFrame, deals: DataFrame, key: str) -> DataFrame:
    """(key, open_deals): deals not stated to be closed; a contact without deals has none."""
    n = deals.groupBy(key).agg(F.count_if(F.col("closed") == "false").alias("open_deals"))
    return contacts.select(key).distinct().join(n, key, "left").select(key, F.coalesce("open_deals", F.lit(0)).alias("open_deals"))


def anchored(results: DataFrame, search: list[str], order: list[str], dedupe: str, cap: int) -> DataFrame:
    """Results of each search, each page once, the first ``cap`` in order."""
    first = results.groupBy(*search, dedupe).agg(F.min(F.struct(*order)).alias("o"))
    w = Window.partitionBy(*search).orderBy("o")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap).select(*search, dedupe, "o.*", "place")


def attach(answers: DataFrame, asker_linkedin: Column, answer_linkedin: Column, rung: Column) -> DataFrame:
    """``answers`` with identity: kept, dropped (weak rung) or none where the profiles differ."""
    differ = asker_linkedin.isNotNull() & answer_linkedin.isNotNull() & (asker_linkedin != answer_linkedin)
    weak = rung.isin("name_domain", "name_org")
    return answers.withColumn("identity", F.when(differ, "discarded").when(weak, "dropped").otherwise("kept"))


def attach_corroborated(answers: DataFrame) -> DataFrame:
    """``answers`` with outcome and reason: kept, dropped (identity only) or discarded.

    A row is an answer beside its asker: asker_linkedin, linkedin, rung, anchor, and the
    texts asker_title, asker_employer, title, employer. Another profile is another person.
    Who is anchored by name alone needs the same title or employer; that anchor and weak
    rungs give facts but never an identity.
    """
    other = F.col("asker_linkedin").isNotNull() & F.col("linkedin").isNotNull() & (F.col("asker_linkedin") != F.col("linkedin"))
    by_name = F.coalesce(F.col("anchor") == "name", F.lit(False))
    same = F.coalesce(F.col("asker_title") == F.col("title"), F.lit(False)) | F.coalesce(F.col("asker_employer") == F.col("employer"), F.lit(False))
    weak = ~F.coalesce(F.col("rung").isin("id", "linkedin", "email"), F.lit(False)) | by_name
    reason = F.when(other, "other_profile").when(by_name & ~same, "uncorroborated").when(by_name, "by_name").when(weak, "weak_rung")
    outcome = F.when(other | (by_name & ~same), "discarded").when(weak, "dropped").otherwise("kept")
    return answers.withColumns({"outcome": outcome, "reason": reason})


def withheld(rows: DataFrame, question: str) -> DataFrame:
    """(question, reason): why a requester's identity is not echoed; null where it is."""
    n = rows.groupBy(question).agg(F.count_distinct("linkedin").alias("urls"), F.count_distinct("name").alias("names"), F.count_distinct("contact").alias("contacts"))
    reason = F.when(F.col("contacts") > 1, "multiple_contacts").when(F.col("urls") > 1, "several_profiles").when(F.col("names") > 1, "several_names")
    return n.select(question, reason.alias("reason"))


def merge_askers(rows: DataFrame, group: str, key: str, rank: Column) -> DataFrame:
    """(key, asker): people of one group ask once, by the strongest anchor; groups of several profiles or names ask each for itself."""
    g = rows.groupBy(group).agg(F.count_distinct("linkedin").alias("urls"), F.count_distinct("name").alias("names"), F.min_by(key, F.struct(rank, key)).alias("asker"))
    alone = (F.col("urls") > 1) | (F.col("names") > 1)
    return rows.select(key, group).join(g, group).select(key, F.when(alone, F.col(key)).otherwise(F.col("asker")).alias("asker"))


def unseen(rows: DataFrame, seen: DataFrame, identity: str) -> DataFrame:
    return rows.join(seen.select(identity).distinct(), identity, "left_anti")


def until_short_page(pages: DataFrame, ask: str, page: str, found: str, per_page: int, cap: int = 100) -> DataFrame:
    """``pages`` of each question up to its first page with fewer than ``per_page`` finds, ``cap`` pages at most.

    A question whose pages have a gap ends before it, as nobody asks on after a missing page.
    """
    short = F.min(F.when(F.size(found) < per_page, F.col(page)))
    ends = pages.groupBy(ask).agg(short.alias("_short"), F.collect_set(page).alias("_held"))
    gap = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(cap)), "_held"))
    ends = ends.select(ask, F.least(F.coalesce("_short", F.lit(cap)), F.coalesce(gap - 1, F.lit(cap)), F.lit(cap)).alias("_last"))
    return pages.join(ends, ask).filter(F.col(page) <= F.col("_last")).drop("_last")


def ask_once(leads: DataFrame, key: str, route_: Column, question: Column) -> tuple[DataFrame, DataFrame]:
    """Questions (route, question), each once, and which lead waits for which: (key, route, question)."""
    waits = leads.select(key, route_.alias("route"), question.alias("question")).filter("route is not null and question is not null")
    return waits.select("route", "question").distinct(), waits


def answered(waits: DataFrame, answers: DataFrame) -> DataFrame:
    """``waits`` with the columns of ``answers`` (route, question, ...): one answer serves all who wait for it."""
    return waits.join(answers, ["route", "question"])


def echoes(requesters: DataFrame, contacts: DataFrame) -> DataFrame:
    """(email, reason, linkedin, verified): whose identity a found contact may echo, or why it is withheld.

    ``requesters`` is (email, linkedin, name, verified), ``contacts`` (email, own), the
    address that was asked for and the one that the contact itself states.  A contact
    counts only if it is the only one and states that address; an identity is echoed only
    where all requesters are one person.
    """
    asked = requesters.groupBy("email").agg(
        F.count_distinct("linkedin").alias("profiles"), F.count_distinct("name").alias("names"), F.min("linkedin").alias("linkedin"), F.bool_or("verified").alias("verified")
    )
    found = contacts.groupBy("email").agg(F.count("*").alias("n"), F.min("own").alias("own"))
    several = (F.col("profiles") > 1) | (F.col("names") > 1)
    own = normalize_email(F.col("own"))
    reason = (
        F.when(F.col("n") > 1, "multiple_contacts").when(F.coalesce(F.trim("own"), F.lit("")) == "", "email_unconfirmed")
        .when(~own.eqNullSafe(F.col("email")), "email_mismatch").when(several, "two_people")
    )
    rows = asked.join(found, "email").select("email", reason.alias("reason"), "linkedin", "verified")
    may = F.col("reason").isNull()
    return rows.select("email", "reason", F.when(may, F.col("linkedin")).alias("linkedin"), F.when(may & F.col("verified"), F.col("email")).alias("verified"))
