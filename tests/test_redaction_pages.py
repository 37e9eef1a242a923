"""Redaction by an automaton, and page text, against plain versions."""

import html.entities
import random
import re
import time

from pyspark.sql import functions as F

from goldweave.functions import text as X
from goldweave.operators.evidence import html_to_text


def plain_mask(text, secrets):
    """Marks every character of every occurrence, one form at a time."""
    hidden = [False] * len(text)
    joined = [False] * (len(text) + 1)  # whether a character and the one before lie in one occurrence or touch
    for f in X.secret_forms(secrets):
        for m in re.finditer(f"(?={re.escape(f)})", text):
            a, b = m.start(), m.start() + len(f)
            word = lambda c: bool(re.fullmatch("[A-Za-z0-9_]", c))
            if len(f) < X.PART_CHARS and (word(text[a - 1 : a] or " ") or word(text[b : b + 1] or " ")):
                continue
            hidden[a:b] = [True] * len(f)
    return re.sub("\0+", X.MASK, "".join("\0" if h else c for c, h in zip(text, hidden))) if any(hidden) or not any(joined) else text


def test_masks_equal_the_plain_version(spark):
    rng = random.Random(6)
    letters = "ab/c "
    secrets = ["".join(rng.choices(letters, k=rng.randrange(3, 12))) for _ in range(60)] + ["aaaaaaaa", "ab/ab/ab", "päss wörd/1"]
    texts = ["".join(rng.choices(letters + "_%2F", k=rng.randrange(120))) for _ in range(300)]
    texts += [rng.choice(texts) + rng.choice(X.secret_forms(secrets)) + rng.choice(["", "x", "_", " "]) for _ in range(300)] + ["", "a" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", X.redact(F.col("t"), secrets).alias("m")).collect():
        assert r["m"] == plain_mask(texts[r["i"]], secrets), texts[r["i"]]


def test_chains_of_three_are_one_mask():
    a = X.Automaton(X.secret_forms(["abcdefgh", "fghijklm", "klmnopqr"]))
    assert a.mask("x abcdefghijklmnopqr y") == "x *** y"
    assert a.mask("abcdefgh abcdefgh") == "*** ***" and a.mask("abcdefghabcdefgh") == "***"


def test_two_thousand_secrets_within_the_guard():
    rng = random.Random(1)
    secrets = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789/+", k=rng.randrange(8, 40))) for _ in range(2000)]
    line = ("word " * 350 + secrets[7] + " " + secrets[1999])[:1800]
    began = time.monotonic()
    mask = X.automaton(tuple(secrets)).mask
    for _ in range(50):
        mask(line)
    assert time.monotonic() - began < 5
    assert len(X.secret_forms(secrets)) <= 14 * len(secrets)


def test_page_text(spark):
    pages = {
        "<p>caf&eacute; &#8211; &hellip; &#x41;&amp;lt; &nbsp; x</p>": "café – … A&lt; x",
        "a<template>b<template>c</template>d</template>e": "a e",
        "<a title='x > y'>in</a> <br/>out": "in out",
        "<script>if (a < b) { '<p>' }</script>text<STYLE>p{}</STYLE >!": "text !",
        "x </noscript> y <noscript>gone": "x y",
        "no tags &unknown; & alone": "no tags &unknown; & alone",
        "<!-- a > b -->c<!doctype html>": "c",
        "": "",
        " \n\t ": "",
    }
    rows = [*pages, None]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "i int, p string").select("i", html_to_text("p").alias("t")).collect()
    assert {rows[r["i"]]: r["t"] for r in got} == {**pages, None: None}
    every = [n for n in html.entities.html5 if n.endswith(";")]
    t = spark.createDataFrame([(" ".join("&" + n for n in every),)], "p string").select(html_to_text("p")).first()[0]
    assert t == " ".join(" ".join(html.entities.html5[n] for n in every).split())


def test_page_text_with_closed_references_only(spark):
    pages = {
        "<title>a &amp; b&amp</title><a href='?x=1&copy=2'>c</a>": ("a & b& c", "a & b&amp c"),
        "&amp;amp; &ampx; &notit; &#65; &#65 &#x41 &#x41; &copy<p>": ("&amp; &x; ¬it; A A A A ©", "&amp; &ampx; &notit; A &#65 &#x41 A &copy"),
        "<!-- &amp --><script>x &lt</script>&nbsp;d&&lt;": ("d&<", "d&<"),
    }
    df = spark.createDataFrame(list(enumerate(pages)), "i int, p string")
    got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", html_to_text("p").alias("a"), html_to_text("p", open_references=False).alias("b")).collect()}
    assert got == dict(enumerate(pages.values()))
