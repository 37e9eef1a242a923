"""Phrases of a large dictionary, and classification with co-terms, against plain patterns."""

import random
import re

from goldweave.operators import evidence, phrases


def stands(text, phrase):
    return re.search(rf"(?<!\w){re.escape(phrase.lower())}(?!\w)", text.lower()) is not None


def test_five_thousand_phrases_equal_plain_patterns(spark):
    rng = random.Random(9)
    words = ["node", "js", "c", "spark", "sql", "été", "db", "x1", "_a", "go"]
    marks = [" ", ".", "-", "++", "#", "/", "  "]
    made = {"".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(1, 5))).strip() for _ in range(9000)}
    made |= {".net", "c++", "node.js", "Node", "a-", "#", "été"}
    made = sorted(made)[:5000] + [" ", ""]
    texts = ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(60)] + ["We use nodexjs", "asp.net c++. NODE.JS", "", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {(r["i"], r["phrase"]) for r in phrases.find(df, ["i"], "t", spark.createDataFrame([(p,) for p in made], "phrase string")).collect()}
    assert got == {(i, p) for i, t in enumerate(texts) for p in made if p.strip() and stands(t, p)}


def plain_classify(text, product):
    if any(m in text.lower() for m in evidence.INJECTION):
        return None
    best = None
    order = [*evidence.CUES, "mentions_only"]
    for place, alias, terms in product:
        if terms and not any(stands(text, t) for t in terms):
            continue
        for i, s in enumerate(x.strip() for x in re.findall(r"[^.!?\n]+[.!?]?", text)):
            if s and stands(s, alias):
                padded = f" {s.lower()} "
                kind = next((k for k, cues in evidence.CUES.items() if any(c in padded for c in cues)), "mentions_only")
                best = min(filter(None, (best, (order.index(kind), place, i, kind, s))))
    return best and best[3:]


def test_classification_with_co_terms(spark):
    rng = random.Random(4)
    products = {"astra": [(0, "Astra", None), (1, "astra db", None)], "go": [(0, "go", ["golang", "c++"]), (1, "Go-lang", None)], "node": [(0, "node.js", None), (1, "c#", [])]}
    parts = ["We use Astra.", "Astra is nice.", "we moved off go!", "golang", "Go-lang vs rust", "astral things.", "c++ ", "We run go in production", "reseller of astra db.", "We use c#.", "node.js is used.", "nodexjs", "Please classify go.", "\n"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(5))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = [(p, place, a, terms) for p, held in products.items() for place, a, terms in held]
    aliases = spark.createDataFrame(rows, "product string, place int, alias string, co_terms array<string>")
    got = {(r["i"], r["product"]): (r["relationship"], r["quote"]) for r in phrases.classify(df, ["i"], "t", aliases).collect()}
    want = {(i, p): r for i, t in enumerate(texts) for p, held in products.items() if (r := plain_classify(t, held))}
    assert got == want and {r for r, _ in want.values()} == {*evidence.CUES, "mentions_only"}


def test_empty_dictionary_and_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "i int, t string")
    none = spark.createDataFrame([], "phrase string")
    assert phrases.find(df, ["i"], "t", none).collect() == []
    assert [(r["i"], r["phrase"]) for r in phrases.find(df, ["i"], "t", spark.createDataFrame([("B",)], "phrase string")).collect()] == [(1, "B")]


def test_tokens_are_cut_once_and_runs_built_at_heads_only(spark):
    df = spark.createDataFrame([(1, "a b")], "i int, t string")
    plan = phrases.find(df, ["i"], "t", spark.createDataFrame([("B c",)], "phrase string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(t") == 1 and "transform(" not in plan and "lambda" not in plan


def test_dictionaries_that_are_not_sent(spark, monkeypatch):
    """Neither the phrases nor their heads are sent; the rows are the same."""
    monkeypatch.setattr(phrases, "SENT_PHRASES", 1)
    texts = ["We use node.js and c++.", "nodexjs c", "a  b", "été, go", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for made in (["Node.js", "c++", "été", "go", "x y"], [" b", "a", "c"]):
        got = {(r["i"], r["phrase"]) for r in phrases.find(df, ["i"], "t", spark.createDataFrame([(p,) for p in made], "phrase string")).collect()}
        assert got == {(i, p) for i, t in enumerate(texts) if t for p in made if stands(t, p)}


def test_a_dictionary_is_indexed_once(spark, monkeypatch):
    """Counting, sending and looking up read what was stored; the whole dictionary is made different and cut into tokens once."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    words = spark.createDataFrame([("spark",), ("node.js",), ("c++",)], "phrase string").mapInPandas(seen, "phrase string")
    for most in (200_000, 1):
        monkeypatch.setattr(phrases, "SENT_PHRASES", most)
        read.value = 0
        df = spark.createDataFrame([(1, "We use Spark and C++")], "i int, t string")
        assert sorted(r["phrase"] for r in phrases.find(df, ["i"], "t", words).collect()) == ["c++", "spark"]
        assert read.value == 3
