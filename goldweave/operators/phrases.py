"""Whole-word phrases of a dictionary in texts: an inverted index, one pass for any number of phrases.

A token is a run of word characters or one other character, in lower case.  A phrase
stands in a text where its tokens follow each other and neither neighbour would lengthen
a word at its ends, so ``c++`` is found in "c++." and not in "abc++".  Each token is looked up
among the heads of the phrases; from where it is one, the runs of as many tokens as phrases
with that head have are looked up in the index, so the work follows the texts and not the
number of phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.operators.evidence import cue_rank, is_injection, polarity
from goldweave.storage import materialize

TOKEN = r"(?U)\w+|\W"
WORD = r"(?U)^\w"
#: Phrases, or heads, that a list may hold to be sent to all tasks; larger dictionaries are shuffled.
SENT_PHRASES = 200_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def index(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """(phrase, head, _gram, _size, _opens, _closes) of different phrases; opens and closes say whether it begins and ends with a word."""
    rows = phrases.select(F.col(phrase).alias("phrase")).filter(F.trim("phrase") != "").distinct().withColumn("t", tokens(F.col("phrase")))
    return rows.select(
        "phrase", F.lower("phrase").alias("_gram"), F.col("t")[0].alias("head"), F.size("t").alias("_size"),
        F.col("t")[0].rlike(WORD).alias("_opens"), F.element_at("t", -1).rlike(WORD).alias("_closes"),
    )


def find(rows: DataFrame, keys: list[str], text: str, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """(*keys, phrase): which phrases stand in which rows, each once.

    Runs are built only where a token is the head of some phrase; a list of heads that is
    too long to be sent is left out, and every token tried.
    """
    held = materialize(index(phrases, phrase), "phrases")  # stored, as it is counted and read for heads and for phrases
    sent = lambda df: F.broadcast(df) if df.limit(SENT_PHRASES + 1).count() <= SENT_PHRASES else df
    heads = held.select("head", "_size").distinct()
    few = heads.limit(SENT_PHRASES + 1).count() <= SENT_PHRASES
    word = lambda c: F.coalesce(c.rlike(WORD), F.lit(False))
    t, p = F.col("_t"), F.col("_p")
    # Outer, as an inner one would have the tokens cut a second time, to leave out texts without any.
    spots = rows.select(*keys, tokens(F.col(text)).alias("_t")).select(*keys, "_t", F.posexplode_outer("_t").alias("_p", "head"))
    if few:
        spots = spots.join(F.broadcast(heads), "head")
    else:
        kinds = held.select("_size", (F.trim("head") == "").alias("blank")).distinct().collect()  # lengths of phrases in tokens: few
        begun = F.col("head").isNotNull() if any(r["blank"] for r in kinds) else F.trim("head") != ""
        spots = spots.filter(begun).withColumn("_size", F.explode(F.array(*[F.lit(n) for n in sorted({r["_size"] for r in kinds})])))
    run = F.array_join(F.slice(t, p + 1, F.col("_size")), "").alias("_gram")
    grams = spots.select(*keys, "_size", run, word(F.when(p > 0, F.get(t, p - 1))).alias("_before"), word(F.get(t, p + F.col("_size"))).alias("_after"))
    hits = grams.join(sent(held.drop("head")), ["_gram", "_size"]).filter((F.col("_opens") | ~F.col("_before")) & (F.col("_closes") | ~F.col("_after")))
    return hits.select(*keys, "phrase").distinct()


def classify(passages: DataFrame, keys: list[str], text: str, aliases: DataFrame) -> DataFrame:
    """(*keys, product, relationship, quote): for each product the strongest sentence that names it, first alias, then first sentence, on ties.

    ``aliases`` is (product, place, alias, co_terms); an alias with co-terms counts only in
    passages that hold one of them as a word.  Passages that try to steer a classifier say
    nothing.
    """
    calm = passages.filter(~is_injection(F.col(text))).select(*keys, F.col(text).alias("_text"))
    cut = F.regexp_extract_all(F.col("_text"), F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0))
    sentences = calm.select(*keys, F.posexplode(F.transform(cut, lambda s: F.trim(s))).alias("_i", "_s")).filter("_s <> ''")
    # Found once and stored, with their sentences: both kinds of aliases and the quotes are read from there.
    named = materialize(find(sentences, [*keys, "_i", "_s"], "_s", aliases, "alias").withColumnRenamed("phrase", "alias"), "named")
    wanted = aliases.select("product", "place", "alias", F.explode_outer("co_terms").alias("term"))
    terms = wanted.filter("term is not null").select("term").distinct()
    beside = find(calm, keys, "_text", terms, "term").withColumnRenamed("phrase", "term")
    free = wanted.filter("term is null").select("product", "place", "alias")
    bound = wanted.filter("term is not null")
    kept = [*keys, "_i", "_s", "product", "place"]
    allowed = named.join(bound, "alias").join(beside, [*keys, "term"], "left_semi").select(*kept)
    said = named.join(free, "alias").select(*kept).unionByName(allowed).withColumn("relationship", polarity(F.col("_s")))
    best = F.min_by(F.struct("relationship", "_s"), F.struct(cue_rank(F.col("relationship")), "place", "_i"))
    return said.groupBy(*keys, "product").agg(best.alias("b")).select(*keys, "product", "b.relationship", F.col("b._s").alias("quote"))
