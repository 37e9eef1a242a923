"""Ids on their way through Python, as text, since pandas would make floats of ids beside a null; names that no column has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def as_long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def free_mark(names: Iterable[str], stem: str) -> str:
    """``stem``, with underscores added until no name begins with it; Spark compares names without case."""
    held = [n.lower() for n in names]
    while any(n.startswith(stem.lower()) for n in held):
        stem += "_"
    return stem


def free_name(names: Iterable[str], name: str) -> str:
    """``name``, with underscores added until no column is called so in any case."""
    held = {n.lower() for n in names}
    while name.lower() in held:
        name += "_"
    return name
