"""Rules of robots files as tables, pages that may be read, and the cache of those that were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.functions import urls as U

RULES = "array<struct<line:int,allow:boolean,path:string>>"


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(origin, rules, closed) of (origin, status, body): the rules that hold for ``agent``, in order.

    A group of rules stands under one or more agent lines; the first group that names the
    agent holds, else the one for all. A file that may not be read closes its origin, one
    that is not there opens it. A file is small, so its rules make one array.
    """
    lines = files.filter("status = 200").select("origin", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r?\n")).alias("line", "text"))
    text = F.trim(F.regexp_replace("text", "#.*", ""))
    fields = lines.withColumn("field", F.lower(F.trim(F.regexp_extract(text, "^([^:]*):", 1)))).withColumn("value", F.trim(F.regexp_extract(text, "^[^:]*:(.*)$", 1)))
    fields = fields.filter(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("origin").orderBy("line")
    begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = fields.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(order)).filter("group > 0")
    named = F.when(F.col("value") == "*", 1).when((F.col("value") != "") & F.contains(F.lit(agent.split("/")[0].lower()), F.lower("value")), 0)
    held = grouped.filter("field = 'user-agent'").groupBy("origin").agg(F.min(F.when(named.isNotNull(), F.struct(named.alias("rank"), "group"))).alias("g"))
    own = grouped.filter("field <> 'user-agent'").join(held.select("origin", F.col("g.group").alias("group")), ["origin", "group"])
    rule = F.struct("line", ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("path"))
    rules = own.groupBy("origin").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    closed = (F.col("status").isin(401, 403) | (F.col("status") >= 500) | F.col("status").isNull()).alias("closed")
    return files.select("origin", closed).join(rules, "origin", "left")


def origin(url: Column) -> Column:
    return F.concat(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1))


def allowed(path: Column, rules: Column, closed: Column) -> Column:
    """By the first rule whose path begins the page's path; without one it is allowed."""
    first = F.get(F.filter(rules, lambda r: path.startswith(r["path"])), F.lit(0))
    return ~F.coalesce(closed, F.lit(False)) & F.coalesce(first["allow"], F.lit(True))


def judged(pages: DataFrame, rules: DataFrame, key: str, url: str) -> DataFrame:
    """``pages`` with ``allowed``; pages of origins without a file are allowed."""
    place = F.concat(F.when(U.path(F.col(url)) == "", "/").otherwise(U.path(F.col(url))), F.when(U.query_part(F.col(url)) != "", F.concat(F.lit("?"), U.query_part(F.col(url)))).otherwise(F.lit("")))
    both = pages.withColumn("_origin", origin(F.col(url))).join(rules.withColumnRenamed("origin", "_origin"), "_origin", "left")
    return both.withColumn("allowed", allowed(place, F.coalesce("rules", F.array().cast(RULES)), F.col("closed"))).select(*pages.columns, "allowed")


def to_read(pages: DataFrame, cache: DataFrame, key: str, url: str) -> DataFrame:
    """(url, key): addresses that no run has read yet, each once, by its smallest page."""
    return pages.join(cache.select(url).distinct(), url, "left_anti").groupBy(url).agg(F.min(key).alias(key))
