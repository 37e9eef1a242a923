"""Personal data: format-preserving Feistel pseudonyms; DataFrame operations only.

One pattern finds candidates of all kinds; a candidate counts only if it is valid
(check digits, ranges, calendar).  The digits of a valid number go through a keyed
Feistel network over numbers of the same length and keep their separators; check digits
are set anew; dates move within the calendar and keep the order and padding in which they
are written; the letters and digits of a mail address go through a network over strings
of the same length and keep their punctuation, behind the reserved name ``example``.
Each network is a permutation, so equal values get equal pseudonyms in every document
and different values of a kind different ones.  Whoever knows the key can invert them.

Every repeat in the pattern is bounded or never given back, so a text of any length takes
time in proportion and no more than a bounded depth of the pattern engine's stack.  The
name of a mail address is the whole run of its characters before the sign, however long;
dots, dashes and per cent signs that it begins with are not part of the value.

Defined results: null text stays null with no finds; very long texts are read whole;
repeated rows get equal results; an empty table gives an empty result; extra columns are
kept, and finds are in ``pii`` or, where that is taken, ``pii_``, and so on.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.llm.ids import free_mark, free_name

ROUNDS = 8
#: Times that a value is permuted again when it falls outside its kind; the odds of more are nil.
WALK = 64
KINDS = ("email", "iban", "ip", "ssn", "card", "date", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,63}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}",
    "date": r"(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2}",
    "phone": r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,5}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
}
EDGE_BEFORE, EDGE_AFTER = r"(?<![A-Za-z0-9_+@])(?<![0-9][.,-])", r"(?![A-Za-z0-9_@])(?![.,-][0-9])"
#: A date may also stand before the time of a timestamp.
BEFORE_TIME = r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}:?[0-9]{2})"
#: A mail address begins where its run of characters does, or behind the find before, and ends with its top domain.
ANY_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)" + PATTERNS["email"] + "(?![A-Za-z0-9])"
ANY = f"{ANY_EMAIL}|{EDGE_BEFORE}(?:(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in KINDS if k != "email") + f"){EDGE_AFTER}|{BEFORE_TIME})"
#: What may stand before the value in a run.
LEADING = "^[.%-]+"
#: Characters of a name or host that are permuted together.
MAIL_BLOCK = 128
ALPHABET = string.ascii_lowercase + string.digits
#: Days in a block of dates; the first block starts on DATE_ORIGIN.
DATE_SIDE = 270
DATE_ORIGIN = "1900-01-01"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0))


def _round_value(key: str, kind: str, n: Column, i: Column, half: Column) -> Column:
    mixed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(mixed, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: str, tweak: Column) -> Column:
    """A keyed permutation of pairs from [0, size_a) x [0, size_b): struct(a, b)."""
    start = F.struct(a.alias("a"), b.alias("b"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved_a = F.pmod(acc["a"] + F.pmod(_round_value(key, kind, tweak, i, acc["b"]), size_a), size_a)
        moved_b = F.pmod(acc["b"] + F.pmod(_round_value(key, kind, tweak, i, acc["a"]), size_b), size_b)
        return F.struct(F.when(even, moved_a).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(moved_b).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permute_digits(number: Column, key: str, kind: str) -> Column:
    """Digits (up to 36) to as many digits."""
    n = F.char_length(number)
    u = F.floor(n / 2).cast("int")
    v = n - u
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    a, b = _number(F.substring(number, F.lit(1), u)), _number(F.substring(number, u + 1, v))
    out = lambda p: F.concat(F.when(u > 0, F.lpad(p["a"].cast("string"), u, "0")).otherwise(F.lit("")), F.lpad(p["b"].cast("string"), v, "0"))
    return F.when(n == 0, number).otherwise(_bind(feistel(a, b, ten(u), ten(v), key, kind, n), out))


def permute_letters(text: Column, key: str, kind: str, tweak: Column) -> Column:
    """A string over ALPHABET, of 256 characters at most, to another of the same length."""
    u = F.floor(F.char_length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), u).alias("a"), F.substring(text, u + 1, F.char_length(text)).alias("b"))

    def shifted(half: Column, other: Column, i: Column) -> Column:
        seed = lambda block: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), tweak, i.cast("string"), F.lit(block), other), 512)
        amount = lambda stream, j: F.conv(F.substring(stream, j * 2 + 1, F.lit(2)), 16, 10).cast("int")
        place = lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1
        moved = lambda c, j, stream: F.substring(F.lit(ALPHABET), (place(c) + amount(stream, j)) % len(ALPHABET) + 1, F.lit(1))
        chars = F.filter(F.split(half, ""), lambda c: c != "")
        return _bind(F.concat(seed("0"), seed("1")), lambda stream: F.array_join(F.transform(chars, lambda c, j: moved(c, j, stream)), ""))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.when(even, shifted(acc["a"], acc["b"], i)).otherwise(acc["a"])
        return F.struct(a.alias("a"), F.when(even, acc["b"]).otherwise(shifted(acc["b"], acc["a"], i)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def refill(shape: Column, filler: Column, what: str = "[0-9]") -> Column:
    """``shape`` with its characters of the class ``what`` replaced in order by those of ``filler``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def put(fill: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            free = c.rlike(f"^{what}$")
            return F.struct(
                F.concat(acc["s"], F.when(free, F.substring(fill, acc["i"], F.lit(1))).otherwise(c)).alias("s"),
                F.when(free, acc["i"] + 1).otherwise(acc["i"]).alias("i"),
            )

        return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["s"])

    return _bind(filler, put)  # else every character would make the filler anew


def luhn_sum(number: Column) -> Column:
    """The Luhn sum of digits of which the last has weight one."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), add)


def mod97(text: Column) -> Column:
    """The remainder by 97 of letters and digits, letters as 10 to 35."""

    def add(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _octets(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda p: p.cast("int"))


def _date_parts(text: Column) -> Column:
    """struct(day, order) of a match, read as year first, else day first, else month first; ``day`` is null if none fits."""

    def read(p: Column) -> Column:
        two = lambda i: F.lpad(F.get(p, i), 2, "0")
        at = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", F.get(p, F.lit(y)), two(F.lit(m)), two(F.lit(d))), F.lit("yyyy-MM-dd")).cast("date")
        orders = {"ymd": at(0, 1, 2), "dmy": at(2, 1, 0), "mdy": at(2, 0, 1)}
        found = lambda k: F.struct(orders[k].alias("day"), F.lit(k).alias("order"))
        later = F.when(orders["dmy"].isNotNull(), found("dmy")).otherwise(found("mdy"))
        return F.when(F.char_length(F.get(p, F.lit(0))) == 4, found("ymd")).otherwise(later)

    return _bind(F.split(text, "[./-]"), read)


def _iban_body(text: Column) -> Column:
    return F.regexp_replace(text, " ", "")


def kind_of(text: Column) -> Column:
    """The kind of a valid candidate, or null."""
    d = digits(text)
    whole = lambda k: text.rlike(f"^(?:{PATTERNS[k]})$")
    body = _iban_body(text)
    tests = {
        "email": text.rlike("[A-Za-z0-9][^@]*@"),
        "iban": F.char_length(body).between(15, 34) & (mod97(F.concat(F.substring(body, F.lit(5), F.lit(30)), F.substring(body, F.lit(1), F.lit(4)))) == 1),
        "ip": F.forall(_octets(text), lambda o: o <= 255),
        "ssn": ~text.rlike("^(000|666|9)") & ~text.rlike("-00-") & ~text.rlike("-0000$"),
        "card": F.char_length(d).between(13, 19) & (luhn_sum(d) % 10 == 0),
        "date": _date_parts(text)["day"].isNotNull(),
        "phone": F.char_length(d).between(8, 15),
    }
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(whole(k) & tests[k], F.lit(k)).otherwise(out)
    return out


def _walk(value: Column, move, fits) -> Column:
    """Permutes until the value fits its kind: still a permutation of the values that fit."""
    start = F.struct(move(value).alias("v"))
    step = lambda acc, i: F.when(fits(acc["v"]), acc).otherwise(F.struct(move(acc["v"]).alias("v")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step, lambda acc: acc["v"])


def in_blocks(text: Column, use, tweak: Column) -> Column:
    """``use(part, tweak)`` of parts of MAIL_BLOCK characters, joined; parts of a longer text get tweaks of their own."""
    n = F.char_length(text)
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{MAIL_BLOCK}}}"), F.lit(0))
    several = lambda head: F.array_join(F.transform(parts, lambda part, i: use(part, F.concat_ws("|", head, i.cast("string")))), "")
    return F.when(n <= MAIL_BLOCK, use(text, tweak)).otherwise(_bind(F.concat_ws("|", tweak, n.cast("string")), several))


def _email(text: Column, key: str) -> Column:
    """Name and host are permuted, each in its own length; the top domain stays, below ``example``."""
    inside = f"[{ALPHABET}]"
    letters = lambda t: F.regexp_replace(t, f"[^{ALPHABET}]", "")

    def make(at: Column) -> Column:
        name, host = F.substring_index(at, "@", 1), F.substring_index(at, "@", -1)
        top = F.substring_index(host, ".", -1)
        body = F.substring(host, F.lit(1), F.char_length(host) - F.char_length(top) - 1)
        moved_name = in_blocks(name, lambda part, tweak: refill(part, permute_letters(letters(part), key, "mail name", tweak), inside), host)
        moved_body = in_blocks(body, lambda part, tweak: refill(part, permute_letters(letters(part), key, "mail host", tweak), inside), top)
        return F.concat(moved_name, F.lit("@"), moved_body, F.lit("."), top, F.lit(".example"))

    return _bind(F.lower(text), make)


def _card(text: Column, key: str) -> Column:
    """The issuer's first digit stays, the check digit is set anew."""

    def make(d: Column) -> Column:
        moved = F.concat(F.substring(d, F.lit(1), F.lit(1)), permute_digits(F.substring(d, F.lit(2), F.char_length(d) - 2), key, "card"))
        return _bind(moved, lambda m: F.concat(m, F.pmod(-luhn_sum(F.concat(m, F.lit("0"))), F.lit(10)).cast("string")))

    return refill(text, _bind(digits(text), make))


def _ip(text: Column, key: str) -> Column:
    def make(o: Column) -> Column:
        side = F.lit(65536).cast("long")
        a = (F.element_at(o, 1) * 256 + F.element_at(o, 2)).cast("long")
        b = (F.element_at(o, 3) * 256 + F.element_at(o, 4)).cast("long")
        text_of = lambda p: F.concat_ws(".", F.floor(p["a"] / 256).cast("string"), (p["a"] % 256).cast("string"), F.floor(p["b"] / 256).cast("string"), (p["b"] % 256).cast("string"))
        return _bind(feistel(a, b, side, side, key, "ip", F.lit(32)), text_of)

    return _bind(_octets(text), make)


def _ssn(text: Column, key: str) -> Column:
    fits = lambda d: ~d.rlike("^(000|666|9)") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
    return refill(text, _walk(digits(text), lambda d: permute_digits(d, key, "ssn"), fits))


def _date(text: Column, key: str) -> Column:
    """Another day of the same block of 270 x 270 days, written in the same order and padding.

    A date that only reads month first stays one: the network is walked until the day is
    above 12.
    """
    origin = F.lit(DATE_ORIGIN).cast("date")

    def move(day: Column) -> Column:
        block = F.floor(day / DATE_SIDE**2)
        inner = (day - block * DATE_SIDE**2).cast("long")
        side = F.lit(DATE_SIDE).cast("long")
        moved = feistel(F.floor(inner / DATE_SIDE).cast("long"), inner % DATE_SIDE, side, side, key, "date", block)
        return _bind(moved, lambda p: (block * DATE_SIDE**2 + p["a"] * DATE_SIDE + p["b"]).cast("int"))

    def write(found: Column) -> Column:
        fits = lambda day: (found["order"] != "mdy") | (F.dayofmonth(F.date_add(origin, day)) > 12)
        day = F.date_add(origin, _walk(F.datediff(found["day"], origin), move, fits))
        padded = ~text.rlike("(^|[./-])[0-9]([./-]|$)")
        part = lambda p, f: F.when(padded, F.lpad(f(p).cast("string"), 2, "0")).otherwise(f(p).cast("string"))

        def order(d: Column) -> Column:
            parts = {"y": F.year(d).cast("string"), "m": part(d, F.month), "d": part(d, F.dayofmonth)}
            mark = F.regexp_extract_all(text, F.lit("[./-]"), F.lit(0))
            put = lambda k: F.concat(parts[k[0]], F.get(mark, F.lit(0)), parts[k[1]], F.get(mark, F.lit(1)), parts[k[2]])
            return F.when(found["order"] == "ymd", put("ymd")).when(found["order"] == "dmy", put("dmy")).otherwise(put("mdy"))

        return _bind(day, order)

    return _bind(_date_parts(text), write)


def _phone(text: Column, key: str) -> Column:
    """The country code stays."""
    head = F.regexp_extract(text, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(text, F.char_length(head) + 1, F.char_length(text))
    return F.concat(head, refill(rest, permute_digits(digits(rest), key, "phone")))


def _iban(text: Column, key: str) -> Column:
    """Digits behind the check digits are permuted, letters stay, check digits are set anew."""
    body = _iban_body(text)
    inner = F.substring(body, F.lit(5), F.lit(30))
    moved = refill(inner, permute_digits(digits(inner), key, "iban"))

    def make(m: Column) -> Column:
        check = 98 - mod97(F.concat(m, F.substring(body, F.lit(1), F.lit(2)), F.lit("00")))
        return F.concat(F.substring(body, F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), m)

    spaced = lambda m: F.aggregate(
        F.split(text, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda acc, c: F.when(c == " ", F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))).otherwise(
            F.struct(F.concat(acc["s"], F.substring(m, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))
        ),
        lambda acc: acc["s"],
    )
    return _bind(_bind(moved, make), spaced)


MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "ssn": _ssn, "card": _card, "date": _date, "phone": _phone}


def pseudonym(text: Column, kind: Column, key: str) -> Column:
    out = text
    for k, make in MAKERS.items():
        out = F.when(kind == k, make(text, key)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, finds: str = "pii") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and the array ``finds`` of struct(kind, value, pseudonym).

    ``key`` is a secret of the caller: keep it out of the code.
    """
    mark, finds = free_mark(docs.columns, "_pii"), free_name(docs.columns, finds)
    hits, gaps = f"{mark}_hits", f"{mark}_gaps"
    text = F.col("text")
    any_hit = text.rlike(ANY)
    found = docs.withColumns({
        hits: F.when(any_hit, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")),
        gaps: F.when(any_hit, F.split(text, ANY, -1)).otherwise(F.array(text)),
    })
    judged = F.transform(hits, lambda h: F.struct(kind_of(h).alias("kind"), h.alias("value")))
    lead = lambda h: F.when(h["kind"] == "email", F.regexp_extract(h["value"], LEADING, 0)).otherwise(F.lit(""))
    judged = F.transform(judged, lambda h: F.struct(h["kind"].alias("kind"), F.substring(h["value"], F.char_length(lead(h)) + 1, F.char_length(h["value"])).alias("value"), lead(h).alias("lead")))
    named = F.transform(judged, lambda h: F.struct(h["kind"].alias("kind"), h["value"].alias("value"), pseudonym(h["value"], h["kind"], key).alias("pseudonym"), h["lead"].alias("lead")))
    found = found.withColumn(hits, named)
    put = F.zip_with(gaps, F.transform(hits, lambda h: F.concat(h["lead"], h["pseudonym"])), lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))))
    valid = F.filter(hits, lambda h: h["kind"].isNotNull())
    shown = F.transform(valid, lambda h: F.struct(*(h[n].alias(n) for n in ("kind", "value", "pseudonym"))))
    out = found.withColumns({"text": F.when(any_hit, F.array_join(put, "")).otherwise(text), finds: shown})
    return out.drop(hits, gaps)


def pseudonymize_documents(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_pii, kinds (sorted, comma-joined), text of every row."""
    out = pseudonymize(docs.select("doc_id", "text"), key)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda p: p["kind"]))), ",")
    return out.select("doc_id", F.size("pii").cast("long").alias("n_pii"), kinds.alias("kinds"), "text")
