"""Secret scans by patterns and sliding-window entropy; DataFrame operations only.

Three patterns give the base spans.  Beyond them, long strings of code-like characters
are candidates: a window slides over each, with a count for every character that is
carried from one window to the next (the character that enters adds one, the one that
leaves takes one off), and so is the window's Shannon entropy.  A candidate whose densest
window reaches the threshold of its character class is a secret unless the allow-list
knows it.  Candidates inside a base span add nothing and are left out.

Work grows with the length of a text, and with n log n of its n spans: positions and the
reach of spans are running sums and maxima over whole arrays, never arrays that grow by
appending.

Spans are ranges of code points, end exclusive.

Defined results: null text is empty and has no spans; very long texts are scanned whole;
of repeated rows each has the same spans; an empty table gives an empty result; columns
whose names clash with those used inside are kept.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.llm.ids import free_mark

#: kind -> (pattern, group whose length counts, least length), in the order in which kinds sort.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: Patterns equal to those of BASE less their failing matches, where that is so: cheaper to scan for.
LONG_ONLY = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
WINDOW = 20
#: Character class -> (pattern of the whole candidate, least entropy in bits of a window).
CLASSES = {
    "hex": (r"^[0-9a-fA-F]+$", 2.9),
    "upper": (r"^[A-Z0-9]+$", 3.4),
    "base64": (r"^[A-Za-z0-9+/_=-]+$", 3.6),
}
#: Code-like strings that are no secrets: UUIDs, dated names, the alphabet, numbers, words joined by single marks.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^\d{4}-\d{2}-\d{2}([T_-][0-9-]*)?$",
    r"(?i)abcdefghijkl",
    r"^[0-9+/_=-]+$",
    r"^(?![/_-])(?=[A-Za-z]*[/_-])(?!.*[/_-][/_-])[A-Za-z/_-]+\d{0,4}$",
)
SPAN = "struct<start:int,rank:int,kind:string,end:int>"
#: A count of at most 31 takes five bits; a long holds twelve.
COUNT_BITS, COUNTS_IN_LONG = 5, 12


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join) -> Column:
    """The running ``join`` (a sum, a maximum) of an array, by rounds that double the distance joined."""

    def grow(acc: Column, i: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), i)
        left = F.greatest(F.size(acc) - far, F.lit(0))
        return F.concat(F.slice(acc, F.lit(1), far), F.zip_with(F.slice(acc, F.lit(1), left), F.slice(acc, far + 1, left), join))

    rounds = lambda v: F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)
    return _bind(values, lambda v: F.when(F.size(v) > 1, F.aggregate(rounds(v), v, grow)).otherwise(v))


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _no(kind: str) -> Column:
    return F.from_json(F.lit("[]"), f"array<{kind}>")


def _hits(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of struct(hit, shown, end) of all leftmost matches whose ``group`` has ``least`` characters."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    shown = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    size = lambda gap, hit: F.char_length(gap) + F.coalesce(F.char_length(hit), F.lit(0))
    ends = running(F.zip_with(F.split(text, pattern, -1), hits, size), lambda a, b: a + b)
    rows = F.arrays_zip(hits.alias("hit"), shown.alias("shown"), ends.alias("end"))
    return F.filter(rows, lambda r: F.char_length(r["shown"]) >= least)


def find_spans(text: Column, kind: str, rank: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of spans of all leftmost matches whose ``group`` has ``least`` characters."""
    span = lambda r: F.struct(
        (r["end"] - F.char_length(r["hit"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), r["end"].alias("end")
    )
    return F.when(text.rlike(pattern), F.transform(_hits(text, pattern, group, least), span)).otherwise(_no(SPAN))


def densest_window(text: Column, window: int = WINDOW) -> Column:
    """The largest entropy, in bits, of any ``window`` (31 at most) characters of ``text``, which are of ALPHABET.

    Counts, and the sum of n log n over them, change only by the character that leaves
    and the one that enters.
    """
    if not 0 < window < 1 << COUNT_BITS:
        raise ValueError("a count of a window must fit its bits")
    longs = -(-len(ALPHABET) // COUNTS_IN_LONG)
    weights = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)))

    def unit(char: Column) -> Column:
        """Where a character is counted: which long, how far up, and one in that place."""
        slot = F.call_function("locate", char, F.lit(ALPHABET)) - 1
        shift = (slot % COUNTS_IN_LONG) * COUNT_BITS
        return F.struct(F.floor(slot / COUNTS_IN_LONG).cast("int").alias("at"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("one"))

    count = lambda counts, u: F.call_function("shiftright", F.get(counts, u["at"]), u["shift"]).bitwiseAND(31).cast("int")
    weight = lambda n: F.get(weights, n)
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def slide(units: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(units, i), F.get(units, i - window)
            moved = lambda c, k: c + F.when(k == enters["at"], enters["one"]).otherwise(0) - F.when(k == leaves["at"], leaves["one"]).otherwise(0)
            gone = F.coalesce(count(acc["counts"], leaves), F.lit(0))
            here = count(acc["counts"], enters) - F.when((leaves["at"] == enters["at"]) & (leaves["shift"] == enters["shift"]), 1).otherwise(0)
            total = acc["sum"] - F.when(gone > 0, weight(gone) - weight(gone - 1)).otherwise(F.lit(0.0)) + weight(here + 1) - weight(here)
            bits = F.when(i >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
            return F.struct(F.transform(acc["counts"], moved).alias("counts"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(units) - 1), start, step, lambda acc: acc["best"])

    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), unit)
    return F.when(F.char_length(text) >= window, _bind(units, slide)).otherwise(F.lit(0.0))


def is_dense(text: Column) -> Column:
    """Whether a candidate looks random for its character class and is not allowed."""
    mixed = text.rlike("[0-9]") & text.rlike("[A-Za-z]")
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | text.rlike(pattern)
    least = F.lit(99.0)
    for pattern, bits in reversed(CLASSES.values()):
        least = F.when(text.rlike(pattern), F.lit(bits)).otherwise(least)
    return F.when(mixed & ~allowed, densest_window(text) >= least).otherwise(F.lit(False))


def _dense_spans(text: Column, base: Column) -> Column:
    """Spans of dense candidates outside the spans in ``base``."""
    # A look-ahead for a digit keeps long words of prose from being cut out at all.
    pattern = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])" + CANDIDATE
    mark = lambda start, end, found, body: F.struct(start.alias("start"), (-end).alias("back"), F.lit(found).alias("found"), body.alias("body"))
    known = F.transform(base, lambda s: mark(s["start"], s["end"], 0, F.lit("")))
    found = F.transform(_hits(text, pattern, 0, 0), lambda r: mark(r["end"] - F.char_length(r["hit"]), r["end"], 1, r["hit"]))

    def outside(marks: Column) -> Column:
        """A base span around a candidate stands before it; the farthest end so far tells whether there is one."""
        reach = running(F.transform(marks, lambda m: F.when(m["found"] == 0, -m["back"]).otherwise(-1)), _larger)
        rows = F.filter(F.arrays_zip(marks.alias("m"), reach.alias("reach")), lambda r: (r["m"]["found"] == 1) & (r["reach"] < -r["m"]["back"]))
        return F.filter(rows, lambda r: is_dense(r["m"]["body"]))

    span = lambda r: F.struct(r["m"]["start"].alias("start"), F.lit(len(BASE)).alias("rank"), F.lit("entropy").alias("kind"), (-r["m"]["back"]).alias("end"))
    added = F.transform(_bind(F.array_sort(F.concat(known, found)), outside), span)
    return F.when(text.rlike(pattern), added).otherwise(_no(SPAN))


def scan(docs: DataFrame, mark: str = "") -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of spans by start and kind (names behind ``mark``)."""
    t, base, spans = (f"{mark}{n}" for n in ("_scanned", "base", "spans"))
    out = docs.withColumn(t, F.coalesce(F.col("text"), F.lit("")))
    parts = [find_spans(F.col(t), kind, rank, LONG_ONLY.get(kind, p), group, least) for rank, (kind, (p, group, least)) in enumerate(BASE.items())]
    out = out.withColumn(base, F.array_sort(F.concat(*parts)))
    return out.withColumn(spans, F.array_sort(F.concat(F.col(base), _dense_spans(F.col(t), F.col(base)))))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    found = scan(docs.select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping ones, replaced by the kind of its first."""

    def put(chars: Column, reach: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0))
            clear = F.array_join(F.slice(chars, at + 1, F.greatest(s["start"] - at, F.lit(0))), "")
            return F.when(s["start"] >= at, F.concat(clear, F.lit("[SECRET:"), s["kind"], F.lit("]"))).otherwise(F.lit(""))

        last = F.element_at(reach, -1)
        rest = F.slice(chars, last + 1, F.greatest(F.size(chars) - last, F.lit(0)))
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.array_join(rest, ""))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    reach = running(F.transform(spans, lambda s: s["end"]), _larger)
    return _bind(F.struct(chars.alias("chars"), reach.alias("reach")), lambda b: put(b["chars"], b["reach"]))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret replaced by its kind and n_chars set to the new length."""
    mark = free_mark(docs.columns, "_secret")
    found = scan(docs, mark)
    spans = F.col(f"{mark}spans")
    out = found.withColumn("text", F.when(F.size(spans) > 0, _redacted(F.col("text"), spans)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
