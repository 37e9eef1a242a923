"""Byte-level BPE encoding and decoding over overlapping chunks.

Texts longer than a chunk are cut into chunks that overlap.  Chunks are pre-tokenised in
parallel, each from its own first character.  Two neighbours are stitched at the first
position of their overlap where both have a pre-token boundary: from there on they agree,
as pre-tokenising has no state but its position.  Where an overlap holds no such position
(a run of one class of characters covers it) the chunks are joined and pre-tokenised
again from the last stitch.  Then the pre-tokens between two stitches are encoded, and a
text's ids are those of its parts in order.  Shorter texts are one chunk and never move.

The pieces of a batch are encoded together by the merge rounds of ``sentencepieces`` over
byte symbols; pieces longer than ``LONG_PIECE`` bytes by a queue of pairs, so that one
piece of millions of bytes takes n log n steps.  Decoding concatenates the raw bytes of
ids.

Defined results: null text counts as empty; empty text has no ids; special tokens are
plain text; texts of any length are encoded whole; repeated rows give equal results, one
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldweave.llm.ids import as_long, as_text
from goldweave.llm.sentencepieces import NO_RANK, Model
from goldweave.llm.storage import materialize

#: Characters of a chunk, and by how many it reaches into the next.
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10
#: A boundary is sure this many characters before a chunk's end: a contraction looks no further.
SURE_CHARS = 3
#: Bytes from which a piece is merged by a queue.
LONG_PIECE = 1 << 10
#: Pieces whose ids a worker keeps.
CACHE_PIECES = 200_000


class BytePairs(Model):
    """Merge rounds over bytes: a pair's rank is that of its bytes, which is also its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must be gapless from 0 and hold every byte")
        self.ranks = ranks
        self.char_id = {chr(b): ranks[bytes([b])] for b in range(256)}
        self.longest_run = 1
        left, right, out = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), out.append(rank)
        left, right, out = (np.array(x, np.int64) for x in (left, right, out))
        key = left * len(self.pieces) + right
        sort = np.argsort(key)
        self.pair_key, self.pair_id = key[sort], out[sort]
        self.pair_rank = self.pair_id
        self.by_rank = np.arange(len(self.pieces))
        self.leading = np.zeros(len(self.pieces) + 1, bool)
        for part in (left, right):  # a merge that can make a pair of better rank than its own
            self.leading[part[part > out]] = True
        self.bits = 24
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self._slot(self.pair_key)] = True

    def encode_pieces(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of each piece: the piece itself where it is a token, else by merges."""
        short = [p.decode("latin-1") for p in pieces if p not in self.ranks and len(p) < LONG_PIECE]
        merged = ((ids[a:b]) for ids, ends in self.encode_words(short) for a, b in zip([0, *ends], ends))  # noqa: B905
        for p in pieces:
            rank = self.ranks.get(p)
            yield [rank] if rank is not None else next(merged) if len(p) < LONG_PIECE else self.encode_long(p)

    def encode_long(self, piece: bytes) -> list[int]:
        """Merges by a queue of (rank, place); places point to their neighbours."""
        n = len(piece)
        token = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if not token[i] or j >= n or self.ranks.get(token[i] + token[j]) != rank:
                continue  # one of the two has been merged meanwhile
            token[i] += token[j]
            token[j] = b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.ranks.get(token[i] + token[k])) is not None:
                    heapq.heappush(queue, (r, i))
            if (h := before[i]) >= 0 and (r := self.ranks.get(token[h] + token[i])) is not None:
                heapq.heappush(queue, (r, h))
        return [self.ranks[t] for t in token if t]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file, or of the vocabulary of a byte-level ``.json`` file without its added tokens."""
    with open(path, "rb") as f:
        if not path.endswith(".json"):
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        held = json.load(f)
    added = {t["id"] for t in held["added_tokens"]}
    byte_of = {c: b for b, c in byte_characters().items()}
    return {bytes(byte_of[c] for c in token): i for token, i in held["model"]["vocab"].items() if i not in added}


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load(path: str) -> BytePairs:
    return BytePairs(read_ranks(path))


@lru_cache(maxsize=1)
def pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class Encoder:
    """Byte pairs with a bounded store of encoded pieces: each has its ids as text, their count and their raw bytes."""

    def __init__(self, pairs: BytePairs, cache_pieces: int = CACHE_PIECES):
        self.pairs, self.cache_pieces = pairs, cache_pieces
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.split = pattern().findall
        self.number = [str(i) for i in range(len(pairs.pieces))]

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > self.cache_pieces:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        need = list(pieces.difference(self.known))
        known, number, raw = self.known, self.number, self.pairs.pieces
        for p, ids in zip(need, self.pairs.encode_pieces([p.encode() for p in need]), strict=True):
            known[p] = (" ".join([number[i] for i in ids]), len(ids), b"".join([raw[i] for i in ids]))

    def encode_batch(self, split: list[list[str]]) -> Iterator[tuple[str, int, bytes]]:
        """For each list of pre-tokens its ids as decimal numbers, their count, and the decoded bytes."""
        self.learn(set().union(*split))
        known = self.known
        for pieces in split:
            found = [known[p] for p in pieces]
            yield " ".join([f[0] for f in found]), sum([f[1] for f in found]), b"".join([f[2] for f in found])

    def encode_text(self, text: str) -> list[int]:
        """Ids of one text, pre-tokenised in overlapping chunks as tasks do it."""
        return [i for ids, _, _ in self.encode_batch([stitched(text)]) for i in map(int, ids.split())]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(load(path))
    return _encoders[path]


def boundaries(text: str, first: int, last: int) -> list[int]:
    """Where pre-tokens of ``text`` begin, of first to last."""
    out = []
    for m in pattern().finditer(text):
        at = m.start()
        if at > last:
            break
        if at >= first:
            out.append(at)
    return out


def edges(text: str, start: int, overlap: int, chunk: int) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk that begins at ``start``: in its first characters, and in those that the next one shares."""
    sure = len(text) - SURE_CHARS
    found = np.array(boundaries(text, 0, sure), np.int64)
    return (found[found < overlap] + start).tolist(), (found[found >= chunk] + start).tolist() if len(text) > chunk else []


def between(text: str, stop: int | None) -> list[str]:
    """Pre-tokens of a text up to a boundary at ``stop``, or all."""
    out, end = [], 0
    for m in pattern().finditer(text):
        if end == stop:
            break
        out.append(m[0])
        end = m.end()
    if end != (len(text) if stop is None else stop):
        raise ValueError(f"no pre-token ends at {stop}")
    return out


def stitched(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Pre-tokens of one text by its chunks, inside one task."""
    if len(text) <= chunk + overlap:
        return pattern().findall(text)
    starts = range(0, len(text), chunk)
    found = [edges(text[s : s + chunk + overlap], s, overlap, chunk) for s in starts]
    seams = [min({*a[1]} & {*b[0]}, default=None) for a, b in zip(found, found[1:], strict=False)]
    out, entry = [], 0
    for seam, end in zip([*seams, None], [*starts[1:], len(text)], strict=True):
        if seam is not None or end == len(text):
            out += between(text[entry : end + overlap], None if seam is None else seam - entry)
            entry = seam
    return out


def _digests(ids: str, n: int, raw: bytes) -> tuple[int, str, str]:
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


RESULT = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks_path: str, keep: bool = False, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also ids (decimal, spaced) and decoded (bytes)."""
    if chunk < 2 * overlap or overlap <= SURE_CHARS:
        raise ValueError("a chunk must be twice as long as its overlap")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = F.char_length("text") > chunk + overlap
    out = _encode_whole(rows.filter(~long), ranks_path, keep).unionByName(_encode_chunks(rows.filter(long), ranks_path, keep, chunk, overlap))
    return as_long(out, "doc_id")


def _encode_whole(rows: DataFrame, ranks_path: str, keep: bool, batch_chars: int = 1 << 21) -> DataFrame:
    """Texts of one chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(ranks_path)
        for pdf in batches:
            texts = pdf["text"].tolist()
            ends = np.cumsum([len(t) for t in texts]) // batch_chars
            for _, part in pd.Series(range(len(texts))).groupby(ends):
                done = coder.encode_batch([coder.split(texts[i]) for i in part])
                yield _frame(pdf["doc_id"].to_numpy()[part.to_numpy()], [(*_digests(*d), *((d[0], d[2]) if keep else ())) for d in done], keep)

    return as_text(rows, "doc_id").mapInPandas(run, RESULT + (", ids string, decoded binary" if keep else ""))


def _frame(doc_ids, rows: list[tuple], keep: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])])
    out.insert(0, "doc_id", doc_ids)
    return out


def cut_chunks(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """row, doc_id, k, start, text of the chunks of each text; every chunk reaches ``overlap`` into the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, doc_id, text in zip(pdf["row"], pdf["doc_id"], pdf["text"], strict=True):
                out = [(row, doc_id, k, s, text[s : s + chunk + overlap]) for k, s in enumerate(range(0, len(text), chunk))]
                for at in range(0, len(out), 64):  # a very long text leaves in parts
                    yield pd.DataFrame(out[at : at + 64], columns=["row", "doc_id", "k", "start", "text"])

    numbered = as_text(rows.withColumn("row", F.monotonically_increasing_id()), "doc_id").select("row", "doc_id", "text")
    return numbered.mapInPandas(run, "row long, doc_id string, k int, start long, text string")


def find_seams(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """row, k, block, entry, seam: chunks of one block have no seam between them; a block runs from its entry to its last chunk's seam."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [edges(t, s, overlap, chunk) for t, s in zip(pdf["text"], pdf["start"], strict=True)]
            yield pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "head": [f[0] for f in found], "tail": [f[1] for f in found]})

    order = Window.partitionBy("row").orderBy("k")
    found = chunks.select("row", "k", "start", "text").mapInPandas(run, "row long, k int, head array<long>, tail array<long>")
    return (
        found.select("row", "k", F.array_min(F.array_intersect("tail", F.lead("head").over(order))).alias("seam"))
        .withColumn("entry", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.lag("seam").over(order)))
        .withColumn("block", F.max(F.when(F.col("entry").isNotNull(), F.col("k"))).over(order))
    )


def _encode_chunks(rows: DataFrame, ranks_path: str, keep: bool, chunk: int, overlap: int) -> DataFrame:
    """Texts of several chunks: pre-tokenise chunks, stitch, encode what lies between stitches, join."""
    chunks = materialize(cut_chunks(rows, chunk, overlap), "chunks")
    part = F.struct("k", "start", "text")
    blocks = (
        chunks.join(find_seams(chunks, chunk, overlap), ["row", "k"])
        .groupBy("row", "block")
        .agg(F.first("doc_id").alias("doc_id"), F.max("entry").alias("entry"), F.max_by("seam", "k").alias("seam"), F.array_sort(F.collect_list(part)).alias("parts"))
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(ranks_path)
        for pdf in batches:
            out = []
            for row, block, doc_id, entry, seam, parts in pdf.itertuples(index=False):
                text = "".join([p["text"][:chunk] for p in parts[:-1]]) + parts[-1]["text"]
                begin = int(entry) - parts[0]["start"]
                pieces = between(text[begin:], None if pd.isna(seam) else int(seam) - int(entry))
                out.append((row, block, doc_id, *next(coder.encode_batch([pieces]))))
            yield pd.DataFrame(out, columns=["row", "block", "doc_id", "ids", "n", "raw"])

    encoded = blocks.select("row", "block", "doc_id", "entry", "seam", "parts").mapInPandas(encode, "row long, block int, doc_id string, ids string, n long, raw binary")
    texts = encoded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("block", "ids", "n", "raw"))).alias("parts"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for parts in pdf["parts"]:
                ids, raw = " ".join([p["ids"] for p in parts]), b"".join([p["raw"] for p in parts])
                out.append((*_digests(ids, sum(p["n"] for p in parts), raw), *((ids, raw) if keep else ())))
            yield _frame(pdf["doc_id"].to_numpy(), out, keep)

    return texts.select("doc_id", "parts").mapInPandas(join, RESULT + (", ids string, decoded binary" if keep else ""))


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, decoded (bytes) of rows with ids as decimal numbers between spaces; null ids decode to nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = load(ranks_path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "decoded": [pairs.decode_bytes(map(int, ids.split())) for ids in pdf["ids"]]})

    rows = encoded.select("doc_id", F.coalesce("ids", F.lit("")).alias("ids"))
    return as_long(as_text(rows, "doc_id").mapInPandas(run, "doc_id string, decoded binary"), "doc_id")
