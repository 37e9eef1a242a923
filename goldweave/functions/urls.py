"""Column expressions over URLs and domains."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Free-mail domains that name no company.
WEBMAIL = (
    "aol.com", "fastmail.com", "gmail.com", "googlemail.com", "gmx.com", "gmx.de", "hotmail.com", "icloud.com", "live.com",
    "mail.com", "me.com", "msn.com", "outlook.com", "proton.me", "protonmail.com", "qq.com", "yahoo.com", "yandex.com",
)
#: Rules of the public suffix list that stand for the rest where no list is given; any other last label is a suffix of one.
SUFFIX_RULES = """
ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk com.au net.au org.au edu.au gov.au id.au asn.au
ac.jp ad.jp co.jp go.jp ne.jp or.jp *.kawasaki.jp !city.kawasaki.jp com.br net.br org.br gov.br com.cn net.cn org.cn gov.cn edu.cn
co.in net.in org.in gov.in ac.in co.nz net.nz org.nz govt.nz ac.nz co.za org.za web.za gov.za co.kr or.kr go.kr ac.kr com.mx org.mx gob.mx
com.ar com.tr com.sg com.hk com.tw com.my com.pl com.ua co.il org.il co.id co.th *.ck !www.ck *.bd
github.io gitlab.io blogspot.com herokuapp.com netlify.app vercel.app pages.dev web.app firebaseapp.com azurewebsites.net cloudfront.net
*.compute.amazonaws.com s3.amazonaws.com
"""
#: Labels that a suffix has at most.
SUFFIX_LABELS = 5
STRENGTHS = (0.25, 0.5, 0.75, 1.0)


@dataclass(frozen=True)
class Suffixes:
    """Rules of a public suffix list: plain ones, wildcards by their rest, exceptions."""

    plain: tuple[str, ...]
    wild: tuple[str, ...]
    except_: tuple[str, ...]

    @classmethod
    def parse(cls, text: str) -> Suffixes:
        """Of a list in the published format: a rule at the start of a line, // for comments; private rules count too."""
        lines = (line.split("//")[0] for line in text.splitlines())
        rules = [_unicode(w.lower()) for line in lines for w in line.split()]
        return cls(
            tuple(r for r in rules if r[0] not in "*!"), tuple(r[2:] for r in rules if r.startswith("*.")), tuple(r[1:] for r in rules if r[0] == "!")
        )

    @classmethod
    def read(cls, path: str) -> Suffixes:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())


def _unicode(rule: str) -> str:
    return ".".join(x[4:].encode().decode("punycode") if x.startswith("xn--") else x for x in rule.split("."))


SUFFIXES = Suffixes.parse(SUFFIX_RULES)


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that stands once in the plan, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _floor(x: Column) -> Column:
    return F.floor(x).cast("long")


def _next_bias(delta: Column, size: Column, first: Column) -> Column:
    """The decoder's bias after a character: ``delta`` is halved, then divided by 35 until it is 455 at most.

    Each division is by floor, so several are one division by a power; a label of 63
    letters needs four at most.
    """

    def settled(d: Column) -> Column:
        times = sum((F.when(d >= 456 * 35**j, 1).otherwise(0) for j in range(4)), F.lit(0))
        return _bound(F.struct(times.alias("times"), _floor(d / F.pow(F.lit(35.0), times)).alias("d")), lambda x: x["times"] * 36 + _floor(x["d"] * 36 / (x["d"] + 38)))

    halved = _floor(delta / F.when(first, 700).otherwise(2))
    return _bound(_bound(halved, lambda d: d + _floor(d / size)), settled).cast("long")


def _is_character(n: Column) -> Column:
    return n.between(128, 0xD7FF) | n.between(0xE000, 0x10FFFF)


def decode_label(label: Column) -> Column:
    """A label in punycode as Unicode; any other label, and a wrong one, as it is.

    The decoder's state goes from letter to letter: where the next character goes, which
    one it is, and how far the variable-length number has been read.
    """
    body = F.substring(label, F.lit(5), F.char_length(label))
    plain = F.when(F.contains(body, F.lit("-")), F.regexp_extract(body, "^(.*)-", 1)).otherwise(F.lit(""))
    letters = F.split(F.regexp_extract(body, "([^-]*)$", 1), "")
    whole = lambda n: F.lit(n).cast("long")
    start = F.struct(
        F.filter(F.split(plain, ""), lambda c: c != "").alias("out"), whole(128).alias("n"), whole(0).alias("i"), whole(72).alias("bias"),
        whole(0).alias("old"), whole(1).alias("w"), whole(36).alias("k"), F.lit(False).alias("bad"),
    )

    def step(acc: Column, c: Column) -> Column:
        digit = F.when(c.rlike("^[a-z]$"), F.ascii(c) - 97).when(c.rlike("^[0-9]$"), F.ascii(c) - 22).cast("long")
        least = F.least(F.greatest(acc["k"] - acc["bias"], whole(1)), whole(26))
        seen = F.struct(digit.alias("digit"), least.alias("least"), (F.size(acc["out"]) + 1).alias("size"))
        return _bound(seen, lambda s: _bound(acc["i"] + s["digit"] * acc["w"], lambda i: moved(acc, s, i)))

    def moved(acc: Column, s: Column, i: Column) -> Column:
        def put(p: Column) -> Column:
            char = _character(F.when(_is_character(p["n"]), p["n"]).otherwise(63))
            out = F.concat(F.slice(acc["out"], F.lit(1), p["at"]), F.array(char), F.slice(acc["out"], p["at"] + 1, s["size"]))
            bias, after = _next_bias(i - acc["old"], s["size"], acc["old"] == 0), (p["at"] + 1).cast("long")
            return F.struct(
                out.alias("out"), p["n"].alias("n"), after.alias("i"), bias.alias("bias"), after.alias("old"),
                whole(1).alias("w"), whole(36).alias("k"), (~_is_character(p["n"])).alias("bad"),
            )

        place = F.struct((acc["n"] + _floor(i / s["size"])).alias("n"), (i % s["size"]).cast("int").alias("at"))
        more = F.struct(
            acc["out"].alias("out"), acc["n"].alias("n"), i.alias("i"), acc["bias"].alias("bias"), acc["old"].alias("old"),
            (acc["w"] * (36 - s["least"])).alias("w"), (acc["k"] + 36).alias("k"), (i > 10**9).alias("bad"),
        )
        wrong = F.struct(*(F.lit(True).alias("bad") if name == "bad" else acc[name].alias(name) for name in ("out", "n", "i", "bias", "old", "w", "k", "bad")))
        return F.when(acc["bad"] | s["digit"].isNull(), wrong).when(s["digit"] < s["least"], _bound(place, put)).otherwise(more)

    read = F.aggregate(F.filter(letters, lambda c: c != ""), start, step, lambda acc: F.when(~acc["bad"] & (acc["k"] == 36), F.array_join(acc["out"], "")))
    return F.when(label.startswith("xn--"), F.coalesce(read, label)).otherwise(label)


def host(url: Column) -> Column:
    """The lower-case host without user, port and trailing dots."""
    rest = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"(:[0-9]*)?\.*$", ""))


def path(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def query_part(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def port(url: Column) -> Column:
    """The stated port that is no default one, or empty."""
    rest = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    stated = F.regexp_extract(rest, r"^[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    return F.when(stated.isin("80", "443"), F.lit("")).otherwise(stated)


def linkedin_url(url: Column) -> Column:
    """host/path of a profile, every linkedin.com subdomain as one; null without host or path."""
    h = F.when(host(url).rlike(r"(^|\.)linkedin\.com$"), F.lit("linkedin.com")).otherwise(host(url))
    p = F.lower(F.try_url_decode(F.regexp_replace(F.trim(path(url)), r"\+", "%2B")))
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), "/$", "")
    return F.when((h != "") & (p != ""), F.concat(h, p))


def registrable_domain(name: Column, suffixes: Suffixes = SUFFIXES) -> Column:
    """The label before the longest public suffix, with it, in Unicode; null for addresses and bare suffixes."""

    def cut(labels: Column) -> Column:
        n = F.size(labels)
        last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
        lengths = F.array(*map(F.lit, range(2, SUFFIX_LABELS + 1)))
        listed = F.filter(lengths, lambda k: (k <= n) & (last(k).isin(*suffixes.plain) | last(k - 1).isin(*suffixes.wild)))
        excepted = F.filter(lengths, lambda k: (k <= n) & last(k).isin(*suffixes.except_))
        length = F.coalesce(F.array_max(excepted) - 1, F.array_max(listed), F.lit(1))
        return _bound(length, lambda k: F.when(n > k, F.array_join(F.slice(labels, n - k, k + 1), ".")))

    labels = F.transform(F.split(F.lower(name), r"\."), decode_label)
    return F.when(~name.rlike(r"^[0-9.]+$") & ~name.rlike(r"\.\."), _bound(labels, cut))


def url_host(url: Column, suffixes: Suffixes = SUFFIXES) -> Column:
    return registrable_domain(host(url), suffixes)


def company_domains(domains: Column) -> Column:
    """Sorted distinct registrable domains of an array of names, free mail left out."""
    found = F.filter(F.transform(domains, lambda d: registrable_domain(d)), lambda d: d.isNotNull())
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, WEBMAIL))))


def company_id(domains: Column) -> Column:
    return F.concat(F.lit("co-"), F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(domains)), "\u001f"), 256), 1, 16))


def dedupe_key(url: Column) -> Column:
    """What two URLs of the same result share: no scheme, fragment, default port, end slash."""
    p, q = port(url), query_part(url)
    place = F.concat(host(url), F.when(p != "", F.concat(F.lit(":"), p)).otherwise(F.lit("")))
    return F.concat(place, F.regexp_replace(path(url), "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def names_domain(text: Column, domain: Column) -> Column:
    """Whether the text names the whole domain: no label before, none behind."""
    quoted = F.regexp_replace(F.lower(domain), r"\.", r"\\.")
    pattern = F.concat(F.lit("(^|[^a-z0-9-])"), quoted, F.lit(r"($|[^a-z0-9.-]|\.$|\.[^a-z0-9])"))
    return F.regexp_like(F.lower(text), pattern)


def attachment(url: Column, texts: list[Column], domain: Column) -> Column:
    """How a result relates to the company of ``domain``."""
    mentioned = F.lit(False)
    for t in [F.concat(path(url), F.lit("?"), query_part(url)), *texts]:
        mentioned = mentioned | F.coalesce(names_domain(t, domain), F.lit(False))
    own = url_host(url)
    return F.when(url.isNull() | own.isNull(), "unattached").when(own == domain, "own_domain").when(mentioned, "third_party_mention").otherwise("unattached")


def signal_strength(hosts: Column, own_domain: Column, corroborating: Column, medium: int = 2, strong: int = 3, agreeing: int = 2) -> Column:
    level = F.when((hosts >= strong) | (own_domain & (hosts >= medium)), 3).when(hosts >= medium, 2).otherwise(1)
    level = level + F.when(corroborating >= agreeing, 1).otherwise(0)
    return F.when(hosts >= 1, F.element_at(F.array(*map(F.lit, STRENGTHS)), F.least(level, F.lit(len(STRENGTHS)))))

