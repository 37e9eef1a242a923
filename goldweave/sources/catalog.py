"""Catalogues, search plans and synthetic data: small tables made on the driver."""

from __future__ import annotations

import glob
import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.functions.text import holds, query_words
from goldweave.functions.values import unit_interval

# Seniorities that a query may ask for.
SENIORITIES = ("founder", "owner", "vp", "head", "director", "manager", "senior")
# Fixed value: titles that a query may ask for.
ROLE_TITLE = r"(?:[a-z]+ )?(?:engineer|architect|developer|analyst)s?"


@dataclass(frozen=True)
class Product:
    key: str
    vendor: str
    name: str
    aliases: tuple[str, ...]
    draft: bool = False
    uids: tuple[str, ...] = ()


@dataclass(frozen=True)
class Catalog:
    """Products and vendor domains of a folder, roles by kind, and the names of drafts that are not used."""

    products: list[Product]
    domains: dict[str, str]
    roles: dict[str, tuple[str, ...]] = field(default_factory=dict)
    drafts: tuple[str, ...] = ()

    def workers_plan(self, vendor: str) -> dict[str, list[str]]:
        """People who work at the vendor: its domain."""
        return {"domains": [self.domains[vendor]] if self.domains.get(vendor) else [], "labels": []}

    def users_plan(self, vendor: str, product: str | None = None) -> dict[str, list[str]]:
        """People at companies that use the vendor's products: what their signals are called."""
        chosen = [p for p in self.products if p.vendor == vendor and product in (None, p.key)]
        if not chosen:
            raise KeyError(f"{vendor} has no product {product or ''}".rstrip())
        return {"domains": [], "labels": sorted(f"uses:{p.key}" for p in chosen)}


def _parsed(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml  # only where a catalogue is written in it

    return yaml.safe_load(text)


def load_catalog(folder: str, listed_uids: set[str] | None = None) -> Catalog:
    """A folder of one file a vendor (JSON or YAML), ``roles`` beside them, unfinished ones in ``drafts``.

    The files are settings of the driver, as small as what people write by hand. A vendor
    or product that two files name, and a technology that ``listed_uids`` lacks, is refused.
    """
    files = lambda *parts: sorted(p for e in ("json", "yaml", "yml") for p in glob.glob(os.path.join(folder, *parts, f"*.{e}")))
    stem = lambda p: os.path.splitext(os.path.basename(p))[0]
    if not os.path.isdir(folder):
        raise FileNotFoundError(f"{folder} is not a directory")
    products, domains, roles = [], {}, {}
    for path in files():
        found = _parsed(path)
        if stem(path) == "roles":
            kinds = ("core", "adjacent", "irrelevant")
            roles = {k: tuple(t for f in found["families"] for t in f.get(k, ())) for k in kinds} | {"seniority": tuple(found.get("seniority", ()))}
            continue
        vendor = found["vendor"]["key"]
        if vendor in domains:
            raise ValueError(f"{path}: vendor {vendor} stands in two files")
        domains[vendor] = found["vendor"].get("domain", "")
        for p in found.get("products", ()):
            names = tuple(dict.fromkeys([p["name"], *p.get("aliases", ())]))
            products.append(Product(p["key"], vendor, p["name"], names, False, tuple(p.get("technology_uids", ()))))
    keys = [p.key for p in products]
    if len(set(keys)) < len(keys):
        raise ValueError(f"products named twice: {sorted({k for k in keys if keys.count(k) > 1})}")
    unknown = sorted({u for p in products for u in p.uids} - listed_uids) if listed_uids is not None else []
    if unknown:
        raise ValueError(f"technologies that the list lacks: {unknown}")
    return Catalog(products, domains, roles, tuple(stem(p) for p in files("drafts")))


#: A catalogue to try things on.
EXAMPLE_CATALOG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "catalog_files")


def parse_catalog(text: str) -> list[Product]:
    """Products of a simple list: ``vendor/key: Name | alias | alias``; ``draft`` lines start with ?."""
    out = []
    for line in text.splitlines():
        m = re.fullmatch(r"\s*(\??)\s*([\w-]+)/([\w-]+)\s*:\s*(.+)", line)
        if m:
            names = [p.strip() for p in m[4].split("|")]
            out.append(Product(m[3], m[2], names[0], tuple(dict.fromkeys(names)), bool(m[1])))
    return out


def catalog_table(spark: SparkSession, products: list[Product]) -> DataFrame:
    """(key, vendor, name, aliases) of products that are no drafts."""
    rows = [(p.key, p.vendor, p.name, list(p.aliases)) for p in products if not p.draft]
    return spark.createDataFrame(rows, "key string, vendor string, name string, aliases array<string>")


def compile_query(query: Column, phrases: dict[str, tuple[str, ...]]) -> Column:
    """struct(terms, seniorities, titles) of a free-text query; no term means no plan."""
    words = query_words(query)

    def any_of(options: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for p in options:
            out = out | holds(words, p)
        return out

    terms = F.array_compact(F.array(*[F.when(any_of(p), t) for t, p in phrases.items()]))
    ranks = F.array_compact(F.array(*[F.when(any_of((s, s + "s")), s) for s in SENIORITIES]))
    titles = F.array_distinct(F.transform(F.regexp_extract_all(words, F.lit(r"\b" + ROLE_TITLE + r"\b"), F.lit(0)), lambda x: F.trim(x)))
    return F.struct(terms.alias("terms"), ranks.alias("seniorities"), titles.alias("titles"))


def effective_vocabulary(profile: DataFrame, sources: DataFrame) -> DataFrame:
    """(term, source, vocabulary): what a term is called at a source; absent or empty is not applicable."""
    return sources.join(profile, "source").filter(F.size("vocabulary") > 0).select("term", "source", "vocabulary")


def synthetic_people(spark: SparkSession, companies: int, per_company: int, seed: int) -> DataFrame:
    """Seeded people at companies: reproducible on any cluster, since every value is a hash of its id."""
    people = spark.range(companies * per_company).select("id", (F.col("id") % companies).alias("company"))
    u = lambda purpose: unit_interval(seed, F.col("id"), purpose)
    domain = F.concat(F.lit("c"), F.col("company").cast("string"), F.lit(".example"))
    name = F.concat(F.lit("Person "), F.col("id").cast("string"))
    return people.select(
        "id", "company", domain.alias("domain"), name.alias("full_name"),
        F.when(u("linkedin") < 0.7, F.concat(F.lit("linkedin.com/in/p"), F.col("id").cast("string"))).alias("linkedin"),
        F.when(u("email") < 0.8, F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("@"), domain)).alias("email"),
        F.when(u("verified") < 0.5, "verified").otherwise("unverified").alias("email_status"),
        (u("opt_out") < 0.05).alias("opt_out"),
    )
