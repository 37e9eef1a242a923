"""Scores, hard rejections and decisions; message checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the score's terms.
WEIGHTS = {"competitor_evidence": "0.35", "icp_fit": "0.25", "intent": "0.15", "contactability": "0.15", "source_agreement": "0.10"}
FIT_VALUES = {"core": "1", "adjacent": "0.5", "irrelevant": "0"}
THRESHOLD = "0.5"
# Words of a retelling that assert nothing, and those that negate.
FREE_WORDS = (
    "a an the this that these those there here and or but so as if then than of to in on at by for from with about into over under "
    "is are was were be been being has have had do does did i me my mine we us our ours you your yours they them their theirs "
    "he him his she her hers it its who whose which what when where how too very just also still yet s re ve ll d m"
).split()
NEGATIONS = ("not", "no", "nor", "never", "t")


def dec(text: str) -> Column:
    return F.lit(text).cast("decimal(6,3)")


def weighted_score(terms: dict[str, Column]) -> Column:
    """Weighted mean of the terms that apply (not null), three places, half to even; 0 without any."""
    weight = {k: F.when(v.isNotNull(), dec(WEIGHTS[k])) for k, v in terms.items()}
    total, part = F.lit(0).cast("decimal(10,3)"), F.lit(0).cast("decimal(20,6)")
    for k, v in terms.items():
        total = total + F.coalesce(weight[k], dec("0"))
        part = part + F.coalesce(weight[k] * v.cast("decimal(6,3)"), F.lit(0).cast("decimal(20,6)"))
    share = part.cast("decimal(20,6)") / total.cast("decimal(10,3)")
    return F.when(total > 0, F.bround(share, 3)).otherwise(F.lit(0)).cast("decimal(6,3)")


def rejections(checks: dict[str, Column]) -> Column:
    """Codes of all hard rejections that apply, in order."""
    return F.array_compact(F.array(*[F.when(v, k) for k, v in checks.items()]))


def contactability(has_profile: Column, email_status: Column, is_role: Column) -> Column:
    mail = F.when(email_status.isNull() | is_role, dec("0")).when(email_status == "verified", dec("0.5")).when(email_status.isin("accept_all", "unverified"), dec("0.25")).otherwise(dec("0"))
    return (F.when(has_profile, dec("0.5")).otherwise(dec("0")) + mail).cast("decimal(6,3)")


def share_met(*checks: Column) -> Column:
    """Share of the checks met; null ones are not asked."""
    met = sum((F.when(c, 1).otherwise(0) for c in checks), F.lit(0))
    asked = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in checks), F.lit(0))
    return F.bround(met.cast("decimal(10,6)") / asked, 3).cast("decimal(6,3)")


def decide(rejected: Column, verdict_status: Column, has_profile: Column, score: Column, threshold: str = THRESHOLD) -> Column:
    """Hard rejection, then verdict, then the missing profile, then the threshold."""
    hard = F.size(rejected) > 0
    gated = verdict_status.isNotNull()
    return (
        F.when(hard, "rejected").when(gated & (verdict_status != "selected"), verdict_status)
        .when(~has_profile, "needs_enrichment").when(gated | (score >= dec(threshold)), "selected").otherwise("rejected")
    )


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_'-]+"), lambda w: w != ""))


def negated(words: Column) -> Column:
    return F.exists(words, lambda w: w.isin(*NEGATIONS) | w.endswith("n't"))


def retells(claim: Column, quote: Column) -> Column:
    """Whether every word that the claim asserts is the quote's, give or take a plural, with its polarity."""
    said, known = tokens(claim), tokens(quote)
    asserted = F.filter(said, lambda w: ~w.isin(*FREE_WORDS))
    holds = F.forall(asserted, lambda w: F.array_contains(known, w) | F.array_contains(known, F.regexp_replace(w, "s+$", "")) | F.array_contains(known, F.concat(w, F.lit("s"))))
    return (F.size(asserted) > 0) & holds & (negated(said) == negated(known))


# Kinds of facts that a claim may retell; words that name things or people without claiming anything.
RETOLD = ("usage", "evidence")
UNCLAIMED = ("linkedin", "i", "i'd", "i'm", "i've", "i'll")
# What must stand in the facts when a message says it: names in capitals and numbers.
ENTITY = r"(?<![\p{L}\p{N}_'-])(?:[A-Z][\p{L}\p{N}_'-]*|[0-9][0-9.,]*)"
# A capital that only begins a sentence.
SENTENCE_CAPITAL = r"(^|[.!?]\s+|\n\s*)[A-Z][\p{L}\p{N}_'-]*"


def claim_problem(claim: Column, body: Column, facts: Column) -> Column:
    """A code and the fact it is about, ``CODE:fact_id``, for a claim struct(fact_id, text), or null. ``facts`` are struct(id, kind, value)."""
    held = F.filter(facts, lambda f: f["id"] == claim["fact_id"])
    text = F.lower(claim["text"])

    def judge(f: Column) -> Column:
        value = F.lower(f["value"])
        states = F.when(f["kind"].isin(*RETOLD), retells(claim["text"], f["value"])).otherwise(F.contains(value, text) | F.contains(text, value))
        return F.when(~F.contains(F.lower(body), text), "UNSAID:").when(~states, "UNSUPPORTED:")

    found = F.when(F.size(held) == 0, "NO_FACT:").otherwise(judge(F.get(held, F.lit(0))))
    return F.concat(found, claim["fact_id"])


def ungrounded(texts: list[Column], facts: Column) -> Column:
    """Names and numbers of a message that no fact holds, each once, in order."""
    known = F.flatten(F.transform(facts, lambda f: tokens(f["value"])))
    said = F.flatten(F.array(*[F.regexp_extract_all(F.regexp_replace(F.coalesce(t, F.lit("")), SENTENCE_CAPITAL, "$1"), F.lit(ENTITY), F.lit(0)) for t in texts]))
    plain = F.transform(said, lambda w: F.regexp_replace(w, "[.,]+$", ""))
    loose = F.filter(plain, lambda w: ~F.lower(w).isin(*UNCLAIMED) & ~F.array_contains(known, F.lower(w)))
    return F.array_distinct(loose)


def grounding_problems(subject: Column, body: Column, claims: Column, facts: Column) -> Column:
    """All that keeps a message from being grounded: no claim, claims without their fact, words from nowhere."""
    wrong = F.array_compact(F.transform(claims, lambda c: claim_problem(c, body, facts)))
    loose = F.transform(ungrounded([subject, body], facts), lambda w: F.concat(F.lit("UNKNOWN_WORD:"), w))
    return F.concat(F.when(F.size(claims) == 0, F.array(F.lit("NO_CLAIM"))).otherwise(F.array().cast("array<string>")), wrong, loose)


def schema_problems(kind: Column, subject: Column, body: Column) -> Column:
    marker = r"\{[^{}]*\}"
    return F.array_compact(F.array(
        F.when(F.trim(body) == "", "BODY_MISSING"), F.when((kind == "invite") & subject.isNotNull(), "SUBJECT_ON_INVITE"),
        F.when((kind == "email") & (F.trim(F.coalesce(subject, F.lit(""))) == ""), "SUBJECT_MISSING"),
        F.when(body.rlike(marker) | F.coalesce(subject, F.lit("")).rlike(marker), "MARKER_LEFT"),
    ))


def length_ok(kind: Column, body: Column, subject: Column, invite_max: int, email_max: int, subject_max: int) -> Column:
    size = F.char_length(body)
    mail = (size <= email_max) & (F.char_length(F.coalesce(subject, F.lit(""))) <= subject_max)
    return F.when(kind == "invite", size <= invite_max).otherwise(mail)


def banned(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p.lower())), p) for p in phrases]))
