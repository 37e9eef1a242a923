"""Evidence: page text, passages, offline classification, grades and verdicts.

An evidence row has: company, product, class, relationship, observed_on (may be null),
confidence. Grades are one grouped aggregation after one for the newest past use.
"""

from __future__ import annotations

import re
from functools import reduce
from html.entities import html5
from html.parser import HTMLParser
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldweave.functions.text import has_any_phrase
from goldweave.operators.sequence import number_groups

# Default strength of an evidence class (3 strong, 2 medium, 1 weak).
CLASS_STRENGTH = {
    "vendor_customer_ref": 3, "job_posting": 3, "code_dependency": 3, "own_domain_content": 2,
    "third_party_content": 1, "linkedin_public": 2, "technographic": 2, "person_self_stated": 2,
}
# Classes that are no content.
NOT_CONTENT = ("technographic", "person_self_stated")
# Cues of a sentence, in the order in which they decide.
CUES = {
    "vendor_or_partner": ("partner of", "our partner", "reseller", "we are a vendor", "sponsored by"),
    "used_past": ("migrated off", "moved off", "moved away from", "no longer use", "used to use", "switched from", "replaced", "sunset"),
    "evaluating": (" vs ", "versus", "compared to", "comparison", "evaluating", "considering", "alternative", "proof of concept"),
    "uses_now": (
        "we use", "we run", "we rely on", "powered by", "built on", "migrated to",
        "moved to", "switched to", "runs on", "in production", "our stack", "dependency",
    ),
}
# Phrases that try to steer a classifier.
INJECTION = ("ignore previous", "ignore all", "ignore the above", "disregard", "system prompt", "mark as", "mark acme", "classify", "as customer")
# Families of queries, in order; grades, from low to high; elements without text.
FAMILIES = ("vendor_customer", "job_posting", "code", "own_site", "third_party", "linkedin_public")
GRADES = ("unverified", "negative", "likely", "verified")
SKIPPED_ELEMENTS = ("script", "style", "noscript", "template")


class Events(HTMLParser):
    """A page as a list of (change of depth, text): tags change the depth of skipped elements, text has none."""

    def reset(self) -> None:
        super().reset()
        self.list: list[tuple[int, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.list.append((int(tag in SKIPPED_ELEMENTS), ""))

    def handle_endtag(self, tag: str) -> None:
        self.list.append((-int(tag in SKIPPED_ELEMENTS), ""))

    def handle_data(self, data: str) -> None:
        self.list.append((0, data))


#: An ampersand, with the whole reference where one follows.
AMPERSAND = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def _closed_reference(found: re.Match) -> str:
    """The reference where its semicolon stands and its name is known; else its ampersand is text."""
    name = found[1]
    return found[0] if name and (name[0] == "#" or name in html5) else "&amp;" + (name or "")


def page_text(page: str, open_references: bool = True) -> str:
    """What stands at depth 0, where an end tag without its start changes nothing.

    Old names like ``&amp`` are references without their semicolon too, as the standard has
    it, unless ``open_references`` is false.
    """
    events = Events()
    events.feed(page if open_references else AMPERSAND.sub(_closed_reference, page))
    if not events.list:
        return ""
    steps = np.cumsum([step for step, _ in events.list])
    depth = steps - np.minimum(np.minimum.accumulate(steps), 0)
    return " ".join(" ".join([text for (_, text), d in zip(events.list, depth.tolist(), strict=True) if d == 0]).split())


def html_to_text(html: Column | str, open_references: bool = True) -> Column:
    """Text of a page without scripts, styles and tags, references resolved, white space collapsed."""

    @F.pandas_udf(T.StringType())
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: None if page is None else page_text(page, open_references))

    return text(html)


def skip_reason(host: Column, url: Column, snippet_named: Column, disallowed: Column, within_budget: Column, size: Column, limit: int) -> Column:
    """Why a page is not read, first reason first; null where it is read."""
    return (
        F.when(host.rlike(r"(^|\.)linkedin\.com$"), "linkedin").when(~url.rlike(r"^https?://"), "http_error").when(~snippet_named, "no_alias")
        .when(disallowed, "robots_disallowed").when(~within_budget, "budget_exhausted").when(size > limit, "too_large")
    )


def passages(docs: DataFrame, key: str, text: str, aliases: list[str], width: int) -> DataFrame:
    """(key, low, high): true unions of windows of ``width`` characters around mentions, end exclusive."""
    found = []
    for a in aliases:
        gaps = F.transform(F.split(F.lower(text), F.lit("\\Q" + a.lower() + "\\E"), -1), lambda p: F.char_length(p))
        found.append(docs.select(key, F.char_length(text).alias("n"), F.lit(len(a)).alias("a"), F.posexplode(F.slice(gaps, F.lit(1), F.size(gaps) - 1)).alias("i", "gap")))
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    run = Window.partitionBy(key, "a").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum("gap").over(run) + F.col("i") * F.col("a")
    spans = hits.withColumn("at", at).select(key, F.greatest(F.col("at") - width, F.lit(0)).alias("low"), F.least(F.col("at") + F.col("a") + width, F.col("n")).alias("high"))
    w = Window.partitionBy(key).orderBy("low", "high")
    begun = spans.withColumn("before", F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    islands = begun.withColumn("island", F.sum(F.when(F.col("low") <= F.col("before"), 0).otherwise(1)).over(w))
    return islands.groupBy(key, "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def polarity(sentence: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(sentence), F.lit(" "))
    out = F.lit("mentions_only")
    for kind, cues in reversed(CUES.items()):
        hit = F.lit(False)
        for c in cues:
            hit = hit | F.contains(padded, F.lit(c))
        out = F.when(hit, kind).otherwise(out)
    return out


def cue_rank(kind: Column) -> Column:
    out = F.lit(len(CUES))
    for i, k in enumerate(CUES):
        out = F.when(kind == k, i).otherwise(out)
    return out


def is_injection(text: Column) -> Column:
    """Whether any phrase stands in ``text``, which is put into lower case once for all of them."""
    return F.exists(F.array(F.lower(text)), lambda low: reduce(or_, [F.contains(low, F.lit(m)) for m in INJECTION]))


def classify(docs: DataFrame, key: str, text: str, alias: str) -> DataFrame:
    """(key, relationship, quote): the strongest sentence that names the alias, first found on ties.

    Texts that try to steer a classifier say nothing.
    """
    sentences = F.regexp_extract_all(F.col(text), F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0))
    flat = docs.filter(~is_injection(F.col(text))).select(key, F.posexplode(sentences).alias("i", "s")).withColumn("s", F.trim("s"))
    named = flat.filter(F.lower("s").rlike(r"(^|[^a-z0-9_])" + alias.lower() + r"($|[^a-z0-9_])"))
    kinds = named.withColumn("relationship", polarity(F.col("s")))
    best = F.min_by(F.struct("relationship", "s"), F.struct(cue_rank(F.col("relationship")), "i"))
    return kinds.groupBy(key).agg(best.alias("b")).select(key, "b.relationship", F.col("b.s").alias("quote"))


def quotes_hold(quotes: Column, texts: Column) -> Column:
    """Whether every quote says something and stands in some text word for word."""
    return F.forall(quotes, lambda q: (F.trim(q) != "") & F.exists(texts, lambda p: F.contains(p, q)))


def effective_strength(kind: Column, observed_on: Column, today: Column, max_age: int) -> Column:
    base = F.lit(2)
    for k, v in CLASS_STRENGTH.items():
        base = F.when(kind == k, v).otherwise(base)
    old = F.datediff(today, observed_on) > max_age
    return F.when(observed_on.isNull(), F.least(base, F.lit(2))).when(old, F.greatest(base - 1, F.lit(1))).otherwise(base)


def grade(evidence: DataFrame, today: Column, max_age: int = 730, ecosystem: Column | None = None) -> DataFrame:
    """(company, product, grade, reason): from dated uses; a newest past use is negative."""
    day = F.coalesce("observed_on", F.lit("0001-01-01").cast("date"))
    used = evidence.filter(F.col("relationship").isin("uses_now", "used_past")).withColumn("day", day)
    dates = used.groupBy("company", "product").agg(
        F.max(F.when(F.col("relationship") == "used_past", F.col("day"))).alias("past"), F.max(F.when(F.col("relationship") == "uses_now", F.col("day"))).alias("now")
    )
    counted = F.col("counts")
    kind = F.col("class")
    content = ~kind.isin(*NOT_CONTENT)
    rows = used.join(dates, ["company", "product"]).withColumn("counts", (F.col("relationship") == "uses_now") & (F.col("past").isNull() | (F.col("day") > F.col("past"))))
    rows = rows.withColumn("strength", effective_strength(kind, F.col("observed_on"), today, max_age))
    sums = rows.groupBy("company", "product").agg(
        F.first("past").alias("past"), F.first("now").alias("now"), F.count_distinct(F.when(counted, kind)).alias("classes"),
        F.coalesce(F.bool_or(counted & content & (F.col("strength") == 3)), F.lit(False)).alias("strong"), F.bool_or(counted & content).alias("content"),
        F.bool_or(counted & (kind == "technographic")).alias("tech"), F.bool_or(counted & (kind != "technographic") & (F.col("strength") > 1)).alias("other"),
    )
    every = evidence.select("company", "product").distinct().join(sums, ["company", "product"], "left")
    negative = F.col("past").isNotNull() & (F.col("now").isNull() | (F.col("past") >= F.col("now")))
    reason = (
        F.when(negative, "newest_used_past").when((F.col("classes") >= 2) & F.col("strong"), "independent_classes").when(F.col("content"), "content_class")
        .when(F.col("tech") & F.col("other"), "technographic_plus_medium").when((F.col("classes") == 1) & F.col("tech"), "technographic_only").otherwise("no_usage_evidence")
    )
    out = every.withColumn("reason", reason)
    if ecosystem is not None:
        out = out.withColumn("reason", F.when(ecosystem & (F.col("reason") == "independent_classes"), "ecosystem_cap").otherwise(F.col("reason")))
    named = {"newest_used_past": "negative", "independent_classes": "verified", "content_class": "likely", "technographic_plus_medium": "likely", "ecosystem_cap": "likely"}
    g = F.lit("unverified")
    for k, v in named.items():
        g = F.when(F.col("reason") == k, v).otherwise(g)
    return out.select("company", "product", g.alias("grade"), "reason")


def person_fit(text: Column, core: tuple[str, ...], adjacent: tuple[str, ...], irrelevant: tuple[str, ...], confirmed: Column) -> Column:
    """struct(fit, boosted): what never fits wins; a confirmed statement lifts adjacent."""
    is_core, is_near = has_any_phrase(text, core), has_any_phrase(text, adjacent)
    fit = F.when(has_any_phrase(text, irrelevant), "irrelevant").when(is_core, "core").when(is_near, F.when(confirmed, "core").otherwise("adjacent")).otherwise("irrelevant")
    boosted = ~has_any_phrase(text, irrelevant) & ~is_core & is_near & confirmed
    return F.struct(fit.alias("fit"), boosted.alias("boosted"))


def verdict(grade_: Column, reason: Column, fit: Column, boosted: Column, strictness: Column, exclusion: Column) -> Column:
    """struct(status, reason) by the first rule that applies."""
    core = fit == "core"
    rules = [
        (exclusion.isNotNull(), "rejected", exclusion),
        (grade_ == "negative", "rejected", F.lit("usage_negative")),
        ((grade_ == "unverified") & (reason == "technographic_only") & core, "manual_review", F.lit("technographic_only")),
        (grade_ == "unverified", "rejected", F.lit("usage_unproven")),
        ((grade_ == "likely") & (strictness == "verified_only"), "rejected", F.lit("strictness_verified_only")),
        (fit == "irrelevant", "rejected", F.lit("person_irrelevant")),
        ((grade_ == "verified") & core, "selected", F.lit("verified_core")),
        ((grade_ == "verified") & boosted, "selected", F.lit("verified_adjacent_boosted")),
        (grade_ == "verified", "manual_review", F.lit("person_unboosted")),
        (~core, "rejected", F.lit("person_not_core")),
        (boosted, "selected", F.lit("likely_core_boosted")),
    ]
    status, why = F.lit("manual_review"), F.lit("person_unboosted")
    for test, s, w in reversed(rules):
        status, why = F.when(test, s).otherwise(status), F.when(test, w).otherwise(why)
    return F.struct(status.alias("status"), why.alias("reason"))


def exclusions(vendor_staff: Column, vendor_partner: Column, left_company: Column) -> Column:
    """All exclusions that apply, in order."""
    return F.array_compact(F.array(F.when(vendor_staff, "vendor_staff"), F.when(vendor_partner, "vendor_partner"), F.when(left_company, "left_company")))


def best_product(grades: DataFrame) -> DataFrame:
    """(company, product): the best grade, the first product on ties."""
    rank = F.lit(0)
    for i, g in enumerate(GRADES):
        rank = F.when(F.col("grade") == g, i).otherwise(rank)
    return grades.groupBy("company").agg(F.max_by("product", F.struct(rank, -F.col("product"))).alias("product"))


def within_budget(rows: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """``rows`` with granted: the first ``limit`` of each group, numbered in two levels."""
    return number_groups(rows, group, *order).withColumn("granted", F.col("place") <= limit).drop("place")


def walk_until(rows: DataFrame, group: str, order: str, done: Column) -> DataFrame:
    """Rows up to and including the first one that is done, in order."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_done", F.coalesce(F.max(done.cast("int")).over(before), F.lit(0))).filter("_done = 0").drop("_done")


def family_queries(company: Column, aliases: list[str], vendor_domain: str, company_domain: Column, job_sites: tuple[str, ...]) -> Column:
    """Array of struct(family, query) in fixed order."""
    terms = F.concat(F.lit('"'), company, F.lit('" (' + " OR ".join(f'"{a}"' for a in aliases) + ")"))
    jobs = F.concat(F.lit("(" + " OR ".join(f"site:{s}" for s in job_sites) + " OR site:"), company_domain, F.lit("/careers)"))
    scopes = {
        "vendor_customer": F.lit(f"site:{vendor_domain}"), "job_posting": jobs, "code": F.lit("site:github.com"),
        "own_site": F.concat(F.lit("site:"), company_domain), "third_party": F.lit(""),
        "linkedin_public": F.lit("(site:linkedin.com/posts OR site:linkedin.com/pulse)"),
    }
    return F.array(*[F.struct(F.lit(f).alias("family"), F.trim(F.concat(scopes[f], F.lit(" "), terms)).alias("query")) for f in FAMILIES])


def technographic_uid(stated: Column, wanted: list[str]) -> Column:
    """The lowest wanted technology that is stated, or null."""
    return F.array_min(F.array_intersect(stated, F.array(*map(F.lit, wanted))))
