"""Seeded provider tables over companies and people, their answer key, and a scan that routes questions to them.

Every value is a hash of an id and a seed, so the tables are the same on any cluster and
are made in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.functions.values import unit_interval
from goldweave.sources.catalog import synthetic_people

ENDPOINTS = ("people.match", "crm.contact", "mail.verify", "web.search")


def companies(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(company, domain, name, uses): ``uses`` is the truth that evidence hints at."""
    u = lambda purpose: unit_interval(seed, F.col("company"), purpose)
    rows = spark.range(n).select(F.col("id").alias("company"))
    text = F.col("company").cast("string")
    uses = F.when(u("uses") < 0.3, "uses_now").when(u("uses") < 0.4, "used_past").otherwise("never")
    return rows.select("company", F.concat(F.lit("c"), text, F.lit(".example")).alias("domain"), F.concat(F.lit("Company "), text).alias("name"), uses.alias("uses"))


def tables(spark: SparkSession, n_companies: int, per_company: int, seed: int) -> dict[str, DataFrame]:
    """The four provider tables and the answer key, by name."""
    firms = companies(spark, n_companies, seed)
    people = synthetic_people(spark, n_companies, per_company, seed)
    u = lambda purpose: unit_interval(seed, F.col("id"), purpose)
    crm = people.filter(u("crm") < 0.25).select("email", F.col("full_name").alias("name"), F.when(u("deal") < 0.3, 1).otherwise(0).alias("open_deals"), "opt_out").filter("email is not null")
    said = F.concat("name", F.when(F.col("uses") == "uses_now", " runs Astra in production.").when(F.col("uses") == "used_past", " moved off Astra.").otherwise(" compared Astra with others."))
    w = lambda purpose: unit_interval(seed, F.col("company"), purpose)
    web = firms.filter(w("web") < 0.8).select("domain", F.concat(F.lit("https://www."), "domain", F.lit("/blog")).alias("url"), said.alias("snippet"))
    key = people.join(firms.select("company", "uses"), "company").select("id", "company", "linkedin", "email", "uses", "opt_out", ((F.col("uses") == "uses_now") & ~F.col("opt_out")).alias("wanted"))
    return {"people": people, "crm": crm, "mail": people.select("email", "email_status").filter("email is not null"), "web": web, "answer_key": key}


def index(named: dict[str, DataFrame]) -> DataFrame:
    """(endpoint, key, answer): every value under which a table can be asked, each key once."""

    def entries(endpoint: str, rows: DataFrame, key: Column, answer: Column) -> DataFrame:
        return rows.select(F.lit(endpoint).alias("endpoint"), key.alias("key"), answer.alias("answer"))

    person = F.concat(F.lit("p"), F.col("id").cast("string"))
    people, crm = named["people"], named["crm"]
    parts = [
        entries("people.match", people, F.concat(F.lit("id:"), F.col("id").cast("string")), person),
        entries("people.match", people, F.concat(F.lit("linkedin:"), "linkedin"), person),
        entries("people.match", people, F.concat(F.lit("email:"), F.lower("email")), person),
        entries("crm.contact", crm, F.concat(F.lit("email:"), F.lower("email")), F.concat(F.lit("deals="), F.col("open_deals").cast("string"))),
        entries("mail.verify", named["mail"], F.concat(F.lit("email:"), F.lower("email")), F.col("email_status")),
        entries("web.search", named["web"], F.concat(F.lit("domain:"), "domain"), F.col("snippet")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("key is not null").groupBy("endpoint", "key").agg(F.min("answer").alias("answer"))


def routed(asks: DataFrame, answers: DataFrame, faults: bool = False) -> DataFrame:
    """(ask, attempt, status, answer) of (ask, endpoint, key).

    One join serves all endpoints. An endpoint that nobody declared is refused with 404, a
    key without an answer is an empty 200. With ``faults`` the first question to each
    endpoint is turned away once with 429 and asked again.
    """
    known = F.col("endpoint").isin(*ENDPOINTS)
    found = asks.join(answers, ["endpoint", "key"], "left")
    status = F.when(known, 200).otherwise(404)
    if not faults:
        return found.select("ask", F.lit(1).alias("attempt"), status.alias("status"), "answer")
    first = asks.filter(known).groupBy("endpoint").agg(F.min("ask").alias("first"))
    turned = found.join(F.broadcast(first), "endpoint", "left").withColumn("turned", F.coalesce(F.col("ask") == F.col("first"), F.lit(False)))
    again = F.struct(F.when(F.col("turned"), 2).otherwise(1).alias("attempt"), status.alias("status"), F.col("answer").alias("answer"))
    away = F.struct(F.lit(1).alias("attempt"), F.lit(429).alias("status"), F.lit(None).cast("string").alias("answer"))
    return turned.select("ask", F.inline(F.when(F.col("turned"), F.array(away, again)).otherwise(F.array(again))))
