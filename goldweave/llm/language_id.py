"""Language identification by error-correcting output codes.

Every language has a codeword; one binary naive Bayes classifier over hashed byte
n-grams predicts each bit.  Decoding takes the codeword with the least weighted loss;
a classifier's weight for a language is its accuracy on that language's training
texts.  Texts whose nearest codeword is hardly nearer than the next are ambiguous.

The model is fitted on a bounded sample of labelled rows: at most ``TRAIN_PER_LANG``
different texts a language, those with the least hashes, each of at most ``TRAIN_BYTES``
bytes.  Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from.  Predictions
see whole texts and nothing but texts; long ones are counted a part at a time.

Defined results: null texts and texts without letters are ``und`` with score 0; where
no language can be learned (an empty table), every text is ``und``; repeated rows get
equal predictions, and repeated texts of a language are learned once; of training texts
with equal hashes the smaller text comes first; extra columns are kept, and one that is
called like the prediction, in any case, keeps its name and values.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.llm.ids import free_name
from goldweave.llm.storage import materialize

TRAIN_PER_LANG = 400
TRAIN_BYTES = 1 << 16
BINS = 1 << 13
NGRAMS = (2, 3)
#: Below this score the nearest codeword is ambiguous.
AMBIGUOUS = 0.1
UNKNOWN = "und"
CHUNK_BYTES = 1 << 20

_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[[i for i in range(128) if not chr(i).isalpha()]] = 32


def counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts: a row for each text, letters in lower case, the rest as spaces."""
    raw = [b"   " + t.lower().encode() + b"   " for t in texts]
    if len(raw) == 1 and len(raw[0]) > 2 * CHUNK_BYTES:
        return _long_counts(raw[0])
    buf = _KEEP[np.frombuffer(b"".join(raw), np.uint8)]
    row = np.repeat(np.arange(len(raw), dtype=np.int64), [len(r) for r in raw])
    out = np.zeros((len(raw), BINS), np.float32)
    wide = buf.astype(np.uint64)
    for n in NGRAMS:
        code = np.zeros(len(buf) - n + 1, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | wide[i : len(buf) - n + 1 + i]
        blank = code == np.uint64(int.from_bytes(b" " * n, "big"))
        # Stretches that reach into the next text hold spaces only, and none of those count.
        slot = ((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)
        at = row[: len(code)] * BINS + slot.astype(np.int64)
        out += np.bincount(at[~blank], minlength=len(raw) * BINS).reshape(len(raw), BINS)
    return out


def _long_counts(raw: bytes) -> np.ndarray:
    """The counts of one long text, a part at a time; n-grams belong to the part that they begin in."""
    out = np.zeros((1, BINS), np.float64)
    for at in range(0, len(raw), CHUNK_BYTES):
        for n in NGRAMS:
            part = _KEEP[np.frombuffer(raw, np.uint8, min(CHUNK_BYTES + n - 1, len(raw) - at), at)].astype(np.uint64)
            out += np.bincount(_slots(part, n), minlength=BINS)
    return out.astype(np.float32)


def _slots(wide: np.ndarray, n: int) -> np.ndarray:
    """Bins of the n-grams of a run of bytes, without blank ones."""
    code = np.zeros(max(len(wide) - n + 1, 0), np.uint64)
    for i in range(n):
        code = (code << np.uint64(8)) | wide[i : len(wide) - n + 1 + i]
    code = code[code != np.uint64(int.from_bytes(b" " * n, "big"))]
    return (((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)).astype(np.int64)


def codewords(classes: int) -> np.ndarray:
    """+1 / -1 codes, one row a class: all splits for few classes, else the best of random codes."""
    if classes <= 6:
        splits = [(1, *s) for s in itertools.product((1, -1), repeat=classes - 1) if -1 in s]
        return np.array(splits or [(1,)], np.int8).T
    bits = math.ceil(10 * math.log2(classes))
    rng = np.random.default_rng(0)

    def apart(code: np.ndarray) -> int:
        same = code.astype(int) @ code.T.astype(int)
        np.fill_diagonal(same, -bits)
        return -same.max()

    return max((rng.choice(np.array([-1, 1], np.int8), (classes, bits)) for _ in range(50)), key=apart)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.weights) / np.maximum(x.sum(axis=1, keepdims=True), 1) - self.bias) / self.scale

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest class and its share: 0 for a tie with the next, 1 for no doubt."""
        loss = np.logaddexp(0, -2 * margins[:, None, :] * self.code[None]) * self.trust[None]
        near = -loss.sum(axis=2)
        best = near.argmax(axis=1)
        if len(self.langs) == 1:
            return best, np.ones(len(best))
        two = np.sort(near, axis=1)[:, -2:]
        return best, np.tanh(4 * (two[:, 1] - two[:, 0]))

    def predict(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        for part in _chunks(texts):
            best, score = self.decode(self.margins(counts(part)))
            yield [self.langs[i] for i in best], np.round(score, 6)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, held = [], 0
    for t in texts:
        if len(t) > CHUNK_BYTES and part:  # a long text is counted by itself
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
        if held >= CHUNK_BYTES or len(part) >= 128:
            yield part
            part, held = [], 0
    if part:
        yield part


def total_counts(texts: list[str]) -> np.ndarray:
    """Sums of the square roots of counts, so that long texts do not outweigh the others."""
    return sum((np.sqrt(counts(p)).sum(axis=0, dtype=np.float64) for p in _chunks(texts)), np.zeros(BINS))


def from_totals(names: list[str], total: np.ndarray) -> Model:
    """The classifiers of all bits, from a row of total counts for each language."""
    code = codewords(len(names))
    weights = []
    share = total / total.sum(axis=1, keepdims=True)
    for bit in code.T:
        one, two = share[bit == 1], share[bit == -1]
        p, q = (s.mean(axis=0) + 1e-6 if len(s) else np.ones(BINS) for s in (one, two))
        weights.append(np.log(p / q))
    w = np.stack(weights, axis=1).astype(np.float32)
    return Model(names, code, w, np.zeros(w.shape[1]), np.ones(w.shape[1]), np.ones(code.shape))


def calibrate(model: Model, raw: np.ndarray, y: np.ndarray) -> Model:
    """Sets the classifiers' thresholds, scales and weights by their margins on the training texts."""
    code, n = model.code, len(model.langs)
    means = np.stack([raw[y == i].mean(axis=0) for i in range(n)])
    inner = np.where(code == 1, means, np.inf).min(axis=0), np.where(code == -1, means, -np.inf).max(axis=0)
    model.bias = np.where(np.isfinite(inner[0]) & np.isfinite(inner[1]), (inner[0] + inner[1]) / 2, 0.0)
    model.scale = np.maximum(np.abs(raw - model.bias).mean(axis=0), 1e-6)
    right = (raw - model.bias) * code[y] > 0
    trust = np.stack([right[y == i].mean(axis=0) for i in range(n)])
    model.trust = trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, max_bytes: int = TRAIN_BYTES) -> DataFrame:
    """lang, h, text: of each language the ``per_lang`` different texts with the least hashes."""
    known = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= max_bytes)
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    near = F.lit(False)  # so many rows that the least hashes are among them, and few more
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(1 << 40)
    for lang, n in sizes.items():
        near = near | ((F.col("lang") == lang) & (unit < min(1.0, 2.0 * per_lang / n)))
    few = known.filter(near).select("lang", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("h"), "text").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return few.withColumn("place", place).filter(F.col("place") <= per_lang).drop("place")


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, max_bytes: int = TRAIN_BYTES) -> Model | None:
    """Fits on the executors: the driver gets the total counts of each language, then the margins of each training text."""
    rows = materialize(training_rows(docs, per_lang, max_bytes), "training")

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "text"])
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "total": [total_counts(pdf["text"].tolist())]})

    found = {r["lang"]: r["total"] for r in rows.groupBy("lang").applyInPandas(totals, "lang string, total array<double>").collect()}
    if not found:
        return None
    names = sorted(found)
    model = from_totals(names, np.array([found[n] for n in names]))

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = np.concatenate([model.margins(counts(p)) for p in _chunks(pdf["text"].tolist())])
            yield pd.DataFrame({"lang": pdf["lang"], "h": pdf["h"], "raw": list(raw.astype(np.float64))})

    seen = sorted(rows.mapInPandas(margins, "lang string, h long, raw array<double>").collect(), key=lambda r: (r["lang"], r["h"], r["raw"]))
    return calibrate(model, np.array([r["raw"] for r in seen]), np.array([names.index(r["lang"]) for r in seen]))


def predict_column(text: Column, model: Model | None) -> Column:
    """struct(lang_pred, score, ambiguous) of a text column."""
    lettered = F.when(text.rlike(r"\p{L}"), text)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(s: pd.Series) -> pd.DataFrame:
        langs = np.full(len(s), UNKNOWN, object)
        scores = np.zeros(len(s))
        at = np.flatnonzero(s.notna().to_numpy())
        if model is not None and len(at):
            found = list(model.predict([s.iloc[i] for i in at]))
            langs[at] = [x for part, _ in found for x in part]
            scores[at] = np.concatenate([x for _, x in found])
        return pd.DataFrame({"lang_pred": langs, "score": scores, "ambiguous": scores < AMBIGUOUS})

    return predict(lettered)


def identify_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row."""
    model = model or train(docs)
    found = docs.select("doc_id", predict_column(F.col("text"), model).alias("p"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score", "p.ambiguous")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are ``und`` or ambiguous."""
    name = free_name(docs.columns, "_prediction")
    found = docs.withColumn(name, predict_column(F.col("text"), train(docs)))
    return found.filter((F.col(name)["lang_pred"] != UNKNOWN) & ~F.col(name)["ambiguous"]).drop(name)
