"""What a user may plug in: small protocols, and adapters that run them over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame


class TieResolver(Protocol):
    def answer(self, question: str, choices: list[str]) -> str | None: ...


class TieStore(Protocol):
    """First answers, kept for good."""

    def read(self) -> DataFrame: ...

    def put(self, answers: DataFrame) -> int: ...


class AcceptanceSource(Protocol):
    def accepted(self, invited: DataFrame, now: Any) -> DataFrame: ...


class Classifier(Protocol):
    """Labels of a batch of texts; made anew in each task from what it pickles."""

    def classify(self, texts: list[str | None]) -> list[str | None]: ...


class ModelInvoker(Protocol):
    def invoke(self, prompt: str, schema: Mapping[str, Any]) -> Mapping[str, Any]: ...


class Transport(Protocol):
    def send(self, endpoint: str, params: Mapping[str, Any]) -> Mapping[str, Any]: ...


class SearchBackend(Protocol):
    def results(self, queries: DataFrame) -> DataFrame: ...


class RunRecorder(Protocol):
    def record(self, run: str, status: str, counts: Mapping[str, int]) -> None: ...


def classify_with(docs: DataFrame, classifier: Classifier, key: str, text: str) -> DataFrame:
    """(key, label) of every row, in Arrow batches; a classifier that answers too few texts fails the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            labels = classifier.classify([None if t is None else str(t) for t in pdf[text]])
            if len(labels) != len(pdf):
                raise ValueError(f"{len(labels)} labels for {len(pdf)} texts")
            yield pd.DataFrame({key: pdf[key], "label": pd.Series(labels, dtype=object, index=pdf.index)})

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, label string")


def answer_ties(ties: DataFrame, resolver: TieResolver, key: str, choices: str) -> DataFrame:
    """(key, answer) of ties, each asked once; an answer outside the choices is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = [resolver.answer(str(k), list(c)) for k, c in zip(pdf[key], pdf[choices], strict=True)]
            kept = [a if a in list(c) else None for a, c in zip(said, pdf[choices], strict=True)]
            yield pd.DataFrame({key: pdf[key], "answer": pd.Series(kept, dtype=object, index=pdf.index)})

    once = ties.select(key, choices).dropDuplicates([key])
    return once.mapInPandas(run, f"{key} {dict(ties.dtypes)[key]}, answer string").filter("answer is not null")
