"""Column expressions over text: folding, names, addresses, phrases, clipping, masking."""

from __future__ import annotations

import base64
import json
import unicodedata
from array import array
from functools import lru_cache
from urllib.parse import quote, quote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Local parts of generic inboxes.
ROLE_WORDS = (
    "accounts", "admin", "billing", "careers", "contact", "enquiries", "finance", "hello", "help", "hr",
    "info", "inquiries", "jobs", "legal", "marketing", "media", "no-reply", "noreply", "office", "postmaster",
    "press", "privacy", "recruiting", "sales", "security", "service", "support", "team", "webmaster",
)
UNTRUSTED_LIMIT = 4000
CELL_LIMIT = 32767


def squeeze(text: Column) -> Column:
    """Lower case, outer white space off, inner runs to one space: ASCII folding inside codegen."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """NFKC, case folding, white space collapsed; no built-in function has these."""
    return text.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split()))


def normalize_email(text: Column) -> Column:
    """Lower case and trimmed; null unless both sides of the first @ have something."""
    e = F.lower(F.trim(text))
    at = F.instr(e, "@")
    return F.when((at > 1) & (F.length(e) > at), e)


def stated_email(personal: Column, bare: Column) -> Column:
    """The personal field where it is present, even if unreadable, else the bare one."""
    return normalize_email(F.coalesce(personal, bare))


def is_role_address(email: Column) -> Column:
    local = F.substring_index(F.substring_index(email, "@", 1), "+", 1)
    return F.coalesce(local.isin(*ROLE_WORDS), F.lit(False))


def person_name(full: Column, first: Column, last: Column) -> Column:
    """The full name, else first and last together; a masked name is none."""
    joined = F.when(first.isNotNull() & last.isNotNull(), F.concat_ws(" ", first, last))
    name = squeeze(F.coalesce(full, joined))
    return F.when((F.instr(name, "*") == 0) & (name != ""), name)


def bounded(text: Column, limit: int = UNTRUSTED_LIMIT) -> Column:
    """struct(value, truncated, original_length) of text from outside."""
    size = F.char_length(text)
    return F.struct(F.substring(text, 1, limit).alias("value"), (size > limit).alias("truncated"), size.alias("original_length"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column) -> Column:
    """Lower-case words of letters and digits between single spaces, spaces at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the words of ``phrase`` follow each other in ``text``."""
    want = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in phrase.lower()).split())
    return F.contains(words(text), F.lit(f" {want} ")) if want else F.lit(False)


def has_any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | has_phrase(text, p)
    return F.coalesce(out, F.lit(False))


def query_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9+#.]+", " "))


def holds(text: Column, phrase: str) -> Column:
    """Whether a phrase stands in query words, not inside a longer word."""
    quoted = "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in phrase)
    return text.rlike(f"(^|[^a-z0-9]){quoted}($|[^a-z0-9])")


def mentions(text: Column, aliases: list[str]) -> Column:
    """Whether any alias is a part of the text, whatever its case."""
    out = F.lit(False)
    for a in aliases:
        out = out | (F.instr(F.lower(text), a.lower()) > 0)
    return out


def fill(template: Column | str, values: dict[str, Column]) -> Column:
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def tidy(text: Column) -> Column:
    """Doubled spaces to one, no spaces at line ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, " {2,}", " "), r" +(\n|$)", "$1"))


def first_name(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), 1)


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def mask_email(email: Column, keep: int = 0) -> Column:
    """``***@domain``, or the first ``keep`` characters before the stars."""
    return F.concat(F.substring(email, 1, keep), F.lit("***@"), F.substring_index(email, "@", -1))


def clip(text: Column, limit: int) -> Column:
    """Whole words up to ``limit`` characters, braces removed; a hard cut where no word ends."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"[{}]", ""), r"\s+", " "))
    cut = F.substring(flat, 1, limit)
    whole = F.regexp_extract(cut, r"^(.*) ", 1)
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.when(whole != "", whole).otherwise(cut))


def printable(text: Column, limit: int) -> Column:
    """Control characters as question marks, cut to ``limit`` with an ellipsis."""
    clean = F.regexp_replace(text, r"[\x00-\x1f\x7f]", "?")
    return F.when(F.char_length(clean) > limit, F.concat(F.substring(clean, 1, limit - 1), F.lit("…"))).otherwise(clean)


def safe_cell(text: Column) -> Column:
    """A spreadsheet cell: no formula start, no control characters, bounded."""
    clean = F.substring(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), 1, CELL_LIMIT)
    return F.when(clean.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), clean)).otherwise(clean)


#: A secret shorter than this counts only as a word of its own; still shorter ones are no secrets.
PART_CHARS, WORD_CHARS = 8, 4
MASK = "***"


def secret_forms(secrets: list[str]) -> list[str]:
    """The secrets and the ways in which they may be written down: a bounded number for each, longest first."""
    forms: set[str] = set()
    for secret in secrets:
        for s in {secret, secret.strip()} - {""}:
            raw = s.encode()
            forms |= {s, quote(s, safe=""), quote_plus(s), json.dumps(s)[1:-1], base64.b64encode(raw).decode().rstrip("="), base64.urlsafe_b64encode(raw).decode().rstrip("="), raw.hex()}
    return sorted((f for f in forms if len(f) >= WORD_CHARS and f.strip()), key=lambda f: (-len(f), f))


class Automaton:
    """All forms in one trie with failure links; a text is read once, whatever their number.

    ``step`` holds the trie's arcs by (state, character) as one number, ``longest`` the
    longest form of PART_CHARS or more that ends in a state, ``short`` the lengths of the
    shorter ones, which count only as words of their own.
    """

    def __init__(self, forms: list[str]):
        self.step: dict[int, int] = {}
        self.fail, self.longest = array("q", [0]), array("q", [0])
        self.short: dict[int, tuple[int, ...]] = {}
        depth_first: list[list[tuple[int, int, int]]] = []  # arcs (state, character, to) by depth
        for f in forms:
            state = 0
            for depth, c in enumerate(map(ord, f)):
                to = self.step.get(state << 21 | c)
                if to is None:
                    to = self.step[state << 21 | c] = len(self.fail)
                    self.fail.append(0), self.longest.append(0)
                    while len(depth_first) <= depth:
                        depth_first.append([])
                    depth_first[depth].append((state, c, to))
                state = to
            if len(f) >= PART_CHARS:
                self.longest[state] = len(f)
            else:
                self.short[state] = (len(f),)
        for arcs in depth_first:
            for state, c, to in arcs:
                if state:
                    self.fail[to] = link = self._next(self.fail[state], c)
                    self.longest[to] = max(self.longest[to], self.longest[link])
                    if link in self.short:
                        self.short[to] = self.short.get(to, ()) + self.short[link]

    def _next(self, state: int, c: int) -> int:
        while (to := self.step.get(state << 21 | c)) is None and state:
            state = self.fail[state]
        return to or 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Unions of all occurrences that overlap or touch, in order."""
        step, fail, longest, short = self.step, self.fail, self.longest, self.short
        out: list[tuple[int, int]] = []
        state = 0
        for end, c in enumerate(map(ord, text), 1):
            while (to := step.get(state << 21 | c)) is None and state:
                state = fail[state]
            state = to or 0
            if not state:
                continue
            size = longest[state]
            for n in short.get(state, ()):
                if n > size and not (end > n and _in_word(text[end - n - 1])) and not (end < len(text) and _in_word(text[end])):
                    size = n
            if size:
                begin = end - size
                while out and out[-1][1] >= begin:
                    begin = min(begin, out.pop()[0])
                out.append((begin, end))
        return out

    def mask(self, text: str) -> str:
        found = self.spans(text)
        if not found:
            return text
        ends = [0, *(b for _, b in found)]
        return "".join([text[a:b] + MASK for a, (b, _) in zip(ends, found, strict=False)]) + text[ends[-1] :]


def _in_word(c: str) -> bool:
    return c == "_" or (c.isascii() and c.isalnum())


@lru_cache(maxsize=4)
def automaton(secrets: tuple[str, ...]) -> Automaton:
    """Built once in each worker."""
    return Automaton(secret_forms(list(secrets)))


def redact(text: Column, secrets: list[str]) -> Column:
    """``text`` with every secret, however it is written, masked; what overlaps or touches becomes one mask."""
    held = tuple(sorted(set(secrets)))

    @F.pandas_udf(T.StringType())
    def masked(texts: pd.Series) -> pd.Series:
        mask = automaton(held).mask
        return texts.map(lambda t: None if t is None else mask(t))

    return masked(text) if secret_forms(list(held)) else text


def redact_row(row: Column, secrets: list[str], limit: int = 2000) -> Column:
    """A nested value as JSON text with all its strings and keys redacted, cut to ``limit`` characters behind a mark."""
    clean = redact(F.to_json(row), secrets)
    return F.when(F.char_length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("..."))).otherwise(clean)
