"""What a source declares, and how sources are found: a new source is one subclass.

A subclass declares what it can answer, what a question costs and which endpoints it may
reach, and gives two DataFrame functions, ``fetch_raw`` and ``normalize``.  A declaration
that is wrong fails when the source is made, before anything is asked.
"""

from __future__ import annotations

import importlib
import inspect
import pkgutil
from abc import ABC, abstractmethod
from collections.abc import Mapping
from dataclasses import dataclass
from types import ModuleType
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

from goldweave.functions.endpoints import sending_words

COST_CLASSES = ("free", "paid")
CHARGE_UNITS = ("none", "request", "record", "credit")


@dataclass(frozen=True)
class Endpoint:
    method: str
    path: str
    reads_only: bool = False


@dataclass(frozen=True)
class Bucket:
    """``capacity`` requests in ``seconds``."""

    capacity: int
    seconds: float


class Source(ABC):
    """Declarations of one provider and its two DataFrame functions."""

    name: ClassVar[str] = ""
    capabilities: ClassVar[frozenset[str]] = frozenset()
    cost_class: ClassVar[str] = "free"
    charge_unit: ClassVar[str] = "none"
    suppressing: ClassVar[bool] = False
    evidence_only: ClassVar[bool] = False
    #: Canonical path -> raw fields on which it can be asked.
    surfaces: ClassVar[Mapping[str, frozenset[str]]] = {}
    #: Target term -> what the provider calls it; empty is not applicable.
    vocabulary: ClassVar[Mapping[str, tuple[str, ...]]] = {}
    endpoints: ClassVar[Mapping[str, Endpoint]] = {}
    rates: ClassVar[tuple[Bucket, ...]] = ()

    def __init__(self) -> None:
        if problems := self.problems():
            raise TypeError(f"{type(self).__name__}: {'; '.join(problems)}")

    @classmethod
    def problems(cls) -> list[str]:
        """Everything that is wrong with the declarations."""
        out = []
        if not isinstance(cls.name, str) or not cls.name.strip():
            out.append("a name is missing")
        if not isinstance(cls.capabilities, frozenset):
            out.append("capabilities are not a frozenset")
        if cls.cost_class not in COST_CLASSES or cls.charge_unit not in CHARGE_UNITS:
            out.append("cost class or charge unit is unknown")
        if (cls.cost_class == "free") != (cls.charge_unit == "none"):
            out.append("a free source charges nothing, a paid one something")
        out += [f"{path} has no surface" for path, s in cls.surfaces.items() if isinstance(s, str) or not s or not all(x.strip() for x in s)]
        asked = {p.removeprefix("target.") for p in cls.surfaces if p.startswith("target.")}
        named = {t for t, words in cls.vocabulary.items() if words}
        out += [f"target term {t} lacks a surface or a vocabulary" for t in sorted(asked ^ named)]
        out += [f"endpoint {k} can send" for k, e in cls.endpoints.items() if sending_words(e.path) or (e.method.upper() != "GET" and not e.reads_only)]
        out += ["a bucket holds nothing"] * any(b.capacity < 1 or b.seconds <= 0 for b in cls.rates)
        return out

    @abstractmethod
    def fetch_raw(self, spark: SparkSession, asks: DataFrame) -> DataFrame:
        """Raw payload rows for the questions in ``asks``."""

    @abstractmethod
    def normalize(self, raw: DataFrame) -> DataFrame:
        """Contributions (key, path, value, raw_path) of raw rows."""


def discover(package: ModuleType) -> dict[str, type[Source]]:
    """All sources defined in the modules of a package, by name; a name that two share is refused."""
    found: dict[str, type[Source]] = {}
    for info in sorted(pkgutil.iter_modules(package.__path__), key=lambda i: i.name):
        module = importlib.import_module(f"{package.__name__}.{info.name}")
        for _, kind in sorted(inspect.getmembers(module, inspect.isclass)):
            if not issubclass(kind, Source) or inspect.isabstract(kind) or kind.__module__ != module.__name__:
                continue
            if kind.name in found:
                raise ValueError(f"two sources are called {kind.name}")
            found[kind.name] = kind
    return found


def choose(found: Mapping[str, type[Source]], enabled: list[str], trust: Mapping[str, int]) -> list[Source]:
    """The enabled sources, the most trusted first, then by name; an unknown name is refused."""
    unknown = sorted(set(enabled) | set(trust)) if not found else sorted((set(enabled) | set(trust)) - set(found))
    if unknown:
        raise ValueError(f"no such source: {', '.join(unknown)}")
    return [found[n]() for n in sorted(dict.fromkeys(enabled), key=lambda n: (-trust.get(n, 0), n))]


def declarations(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(source, path, surface, cost_class, charge_unit): one row for each way a path can be asked."""
    rows = [(s.name, p, f, s.cost_class, s.charge_unit) for s in sources for p, fields in s.surfaces.items() for f in sorted(fields)]
    return spark.createDataFrame(rows, "source string, path string, surface string, cost_class string, charge_unit string")
