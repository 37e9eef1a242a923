"""Endpoints that could send or write: judged by the words of their paths and by their method."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a path must not name, stems that no word of it may hold, and
# names of placeholders that choose the operation.
SEND_WORDS = """
send sends sender mailing mailings message messages messaging emails sms outreach invite invitation invitations
connection connections mail mails mailer mailers inmail communication communications meeting meetings conversation
conversations reply forward broadcast notification notifications recipient recipients drip
sequence sequences campaign campaigns emailer emailers enroll enrol enrolls enrols enrollment enrollments enrolment
enrolments trigger schedule launch dispatch publish
engagement engagements call calls task tasks note notes
create add update upsert merge import imports delete destroy remove archive restore submit insert write put patch
webhook webhooks subscribe unsubscribe subscription subscriptions optin optout
""".split()
SEND_STEMS = "send enroll enrol campaign outreach mailer subscribe webhook optout".split()
SELECTORS = "action actions operation op verb method command cmd endpoint function path".split()

#: How often a path is decoded at most: what is encoded more often stays.
DECODED = 5


def sending_words(path: str) -> list[str]:
    """Words and stems for which a declared path is refused; the plain form of ``send_hits``."""
    for _ in range(DECODED):
        path = unquote(path)
    words = lambda s: set(re.findall("[a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", s).lower()))
    named, plain = " ".join(re.findall(r"\{([^}]*)\}", path)), re.sub(r"\{[^}]*\}", " ", path)
    stems = {s for s in SEND_STEMS if s in plain.lower()}
    return sorted(words(named) & {*SEND_WORDS, *SELECTORS} | words(plain) & {*SEND_WORDS} | stems)


def decoded(path: Column) -> Column:
    """A path without percent encoding; what is no encoding stays as it is."""
    for _ in range(DECODED):
        safe = F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
        path = F.url_decode(safe)
    return path


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), F.lit("[a-z0-9]+"), F.lit(0))


def _list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def send_hits(path: Column) -> Column:
    """Sorted words and stems for which a path is refused; empty where it may be asked."""
    whole = decoded(path)
    named = F.array_join(F.regexp_extract_all(whole, F.lit(r"\{([^}]*)\}"), F.lit(1)), " ")
    plain = F.regexp_replace(whole, r"\{[^}]*\}", " ")
    stems = F.filter(_list(SEND_STEMS), lambda s: F.contains(F.lower(plain), s))
    hits = F.concat(F.array_intersect(_words(named), _list([*SEND_WORDS, *SELECTORS])), F.array_intersect(_words(plain), _list(SEND_WORDS)), stems)
    return F.array_sort(F.array_distinct(hits))


def send_problem(method: Column, path: Column, listed: list[str]) -> Column:
    """Why an endpoint is refused: ``names ...`` or ``unlisted_post``; null where it may be asked.

    ``listed`` are the exact paths that may be posted to, as they only read.
    """
    hits = send_hits(path)
    known = path.isin(*listed) if listed else F.lit(False)
    return F.when(F.size(hits) > 0, F.concat(F.lit("names "), F.array_join(hits, ","))).when((F.upper(method) != "GET") & ~known, "unlisted_post")
