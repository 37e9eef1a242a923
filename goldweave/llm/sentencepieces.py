"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All words of a batch lie in one flat numpy array of symbols.  A round looks up the
rank of every adjacent pair, takes the minimum rank of each word (a segmented
minimum), merges all leftmost non-overlapping occurrences of it at once and
compacts the array.  Rounds go on until no word has a pair left.

A word is a run of meta spaces with what follows it.  Words are independent because
no piece of such a model holds a meta space after another character; ``Model``
refuses a vocabulary where that fails.

Merging all occurrences of a piece at once equals the library's queue unless a merge
creates a pair of a better rank than itself.  Pieces that can do so are found when the
model is loaded; of those, a round merges a word's occurrences from the left up to the
first whose neighbours make such a pair, as the library would take that pair next.

Defined results: null text counts as empty; empty text has no ids and decodes to an
empty text; a text of spaces only, or of one very long word, is encoded like any other;
repeated rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from goldweave.llm.ids import as_long, as_text

META = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NO_RANK = np.int64(1) << 40
#: Words whose ids a worker keeps.
CACHE_WORDS = 200_000
#: Symbols that one merge call holds.
MERGE_SYMBOLS = 1 << 20


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = buf[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each field of a protocol buffer message."""
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(buf, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(buf, at)
            value = buf[at : at + size]
            at += size
        yield key >> 3, value


class Model:
    """A byte-fallback BPE model with identity normalisation, as read from its file."""

    def __init__(self, path: str):
        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        with open(path, "rb") as f:
            for field, value in _fields(f.read()):
                if field == 1:
                    d = dict(_fields(value))
                    pieces.append((d.get(1, b"").decode(), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, NORMAL)))
                elif field == 2:
                    trainer = dict(_fields(value))
                elif field == 3:
                    normalizer = dict(_fields(value))
        kinds = {k for _, _, k in pieces}
        if trainer.get(3) != 2 or not trainer.get(35) or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only byte-fallback BPE models without user-defined or unused pieces are read")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only identity normalisation with a dummy prefix is read")
        normal = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        if any(META in p.lstrip(META) for p in normal):
            raise ValueError("a piece holds a meta space after another character")
        self.pieces = pieces
        self.byte_ids = np.full(256, -1, np.int64)
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self._rank(normal)

    def _rank(self, normal: dict[str, int]) -> None:
        order = sorted(normal, key=lambda p: (-self.pieces[normal[p]][1], normal[p]))
        rank = {p: n for n, p in enumerate(order)}
        by_score: dict[float, list[str]] = {}
        for p in normal:
            by_score.setdefault(self.pieces[normal[p]][1], []).append(p)
        tied = {p for ps in by_score.values() if len(ps) > 1 for p in ps}
        runs = {len(p) for p in tied}
        if tied and ({*"".join(tied)} != {META} or min(by_score) != self.pieces[normal[META]][1] or META not in tied):
            raise ValueError("pieces of equal score are only read where they are the runs of spaces and score lowest")
        #: The longest run of spaces that is a piece; runs merge last, always the leftmost pair.
        self.longest_run = max(runs, default=1)
        self.tails = [_merge_run(n, runs) for n in range(self.longest_run + 1)]
        if self.tails[self.longest_run] != [self.longest_run]:
            raise ValueError("the longest run of spaces is not reached from the left")
        left, right, out = [], [], []
        for p in normal:
            if len(p) > 1 and p not in tied:
                for cut in range(1, len(p)):
                    a, b = normal.get(p[:cut]), normal.get(p[cut:])
                    if a is not None and b is not None:
                        left.append(a), right.append(b), out.append(normal[p])
        n = len(self.pieces)
        key = np.array(left, np.int64) * n + np.array(right, np.int64)
        sort = np.argsort(key)
        self.pair_key, self.pair_id = key[sort], np.array(out, np.int64)[sort]
        ranks = np.full(n, NO_RANK)
        for p, i in normal.items():
            ranks[i] = rank[p]
        self.pair_rank = ranks[self.pair_id]
        self.by_rank = np.array([normal[p] for p in order], np.int64)
        # A merge into z that can lead on to a piece of better rank than z.
        self.leading = np.zeros(len(order) + 1, bool)
        for part in (np.array(left, np.int64), np.array(right, np.int64)):
            worse = (ranks[part] > ranks[np.array(out, np.int64)]) & (ranks[part] < NO_RANK)
            self.leading[ranks[part[worse]]] = True
        self.char_id = {p: i for p, i in normal.items() if len(p) == 1}
        # Two-level table of pairs: a bitmap first, since most pairs are no piece.
        self.bits = 24
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self._slot(self.pair_key)] = True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(0x9E3779B97F4A7C1)) >> np.int64(20)) & np.int64((1 << self.bits) - 1)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), NO_RANK)
        key = a * len(self.pieces) + b
        maybe = np.flatnonzero(self.filter[self._slot(key)] & (a >= 0) & (b >= 0))
        at = np.searchsorted(self.pair_key, key[maybe])
        at[at == len(self.pair_key)] = 0
        hit = self.pair_key[at] == key[maybe]
        out[maybe[hit]] = self.pair_rank[at[hit]]
        return out

    def encode_words(self, words: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of words, meta spaces in place of spaces: by batch, flat ids and each word's end."""
        batch: list[str] = []
        held = 0
        for w in words:
            batch.append(w)
            held += len(w)
            if held >= MERGE_SYMBOLS:
                yield self._merge(batch)
                batch, held = [], 0
        if batch:
            yield self._merge(batch)

    def _merge(self, words: list[str]) -> tuple[list[int], list[int]]:
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        distinct, inverse = np.unique(chars, return_inverse=True)
        # Characters that are no piece get negative symbols and never merge.
        known = np.array([self.char_id.get(chr(c), -1 - int(c)) for c in distinct], np.int64)
        sym = known[inverse]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done_sym, done_word = [], []
        rank = np.full(len(sym), NO_RANK)
        if len(sym) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self._pair_ranks(sym[:-1], sym[1:]), NO_RANK)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            best = np.minimum.reduceat(rank, starts)
            over = best == NO_RANK
            if over.any():  # finished words leave, so later rounds touch only the rest
                stay = np.repeat(~over, sizes)
                done_sym.append(sym[~stay]), done_word.append(word[~stay])
                sym, word, rank, best, sizes = sym[stay], word[stay], rank[stay], best[~over], sizes[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # In a run of overlapping pairs every second one merges, from the left.
            joined = np.r_[False, at[1:] == at[:-1] + 1]
            index = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(joined, 0, index))
            at = at[(index - begin) % 2 == 0]
            if self.leading[best].any():
                at = self._until_better(sym, word, rank, at)
            sym[at] = self.by_rank[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            fresh = np.zeros(len(sym), bool)  # pairs whose rank must be looked up again
            fresh[at] = True
            sym, word, rank, fresh = sym[keep], word[keep], rank[keep], fresh[keep]
            fresh[:-1] |= fresh[1:]
            redo = np.flatnonzero(fresh)
            last = redo == len(sym) - 1
            rank[redo[last]] = NO_RANK
            redo = redo[~last]
            same = word[redo] == word[redo + 1]
            rank[redo[~same]] = NO_RANK
            redo = redo[same]
            rank[redo] = self._pair_ranks(sym[redo], sym[redo + 1])
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        sort = np.argsort(word, kind="stable")
        sym, word = self._join_runs(*self._split_bytes(sym[sort], word[sort]))
        return sym.tolist(), np.searchsorted(word, np.arange(1, len(words) + 1)).tolist()

    def _until_better(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the merges ``at``, those of each word up to the first after which a better pair stands."""
        some = np.flatnonzero(self.leading[rank[at]])
        here, last = at[some], len(sym) - 1
        made = self.by_rank[rank[here]]
        left, right = np.maximum(here - 1, 0), np.minimum(here + 2, last)
        before = sym[left]
        behind_merge = np.r_[False, here[1:] == here[:-1] + 2]  # what stands before has been merged already
        before[behind_merge] = made[np.flatnonzero(behind_merge) - 1]
        has_left, has_right = (here > 0) & (word[left] == word[here]), (here + 2 <= last) & (word[right] == word[here])
        new_left = np.where(has_left, self._pair_ranks(before, made), NO_RANK)
        new_right = np.where(has_right, self._pair_ranks(made, sym[right]), NO_RANK)
        better = np.zeros(len(at), bool)
        better[some] = np.minimum(new_left, new_right) < rank[here]
        if not better.any():
            return at
        seen = np.cumsum(better) - better
        starts = np.r_[True, word[at[1:]] != word[at[:-1]]]
        begin = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
        return at[seen == seen[begin]]

    def _split_bytes(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lost = np.flatnonzero(sym < 0)
        if not len(lost):
            return sym, word
        raw = [np.frombuffer(chr(-1 - int(s)).encode(), np.uint8) for s in sym[lost]]
        count = np.ones(len(sym), np.int64)
        count[lost] = [len(r) for r in raw]
        out = np.repeat(sym, count)
        ends = np.cumsum(count)
        for i, r in zip(lost, raw, strict=True):
            out[ends[i] - len(r) : ends[i]] = self.byte_ids[r]
        return out, np.repeat(word, count)

    def _join_runs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of single spaces become pieces of the longest length, from the left."""
        space = self.char_id.get(META, -1)
        is_space = sym == space
        if self.longest_run < 2 or not (is_space[1:] & is_space[:-1]).any():
            return sym, word
        index = np.arange(len(sym))
        starts = is_space & ~np.r_[False, is_space[:-1] & (word[1:] == word[:-1])]
        begin = np.maximum.accumulate(np.where(starts, index, 0))
        place = index - begin
        ends = np.r_[starts[1:] | ~is_space[1:] | (word[1:] != word[:-1]), True]
        size = np.zeros(len(sym), np.int64)
        size[starts] = place[np.flatnonzero(ends & is_space)] + 1
        size = np.maximum.accumulate(np.where(starts, begin * (len(sym) + 1) + size, 0)) % (len(sym) + 1)
        full = size - size % self.longest_run
        head = ~is_space | (place % self.longest_run == 0)
        cuts = np.zeros((self.longest_run + 1, self.longest_run + 1), bool)
        for n, parts in enumerate(self.tails):
            cuts[n, np.cumsum([0, *parts[:-1]])] = True
        tail = np.flatnonzero(is_space & (place >= full))
        head[tail] = cuts[size[tail] - full[tail], place[tail] - full[tail]]
        keep = np.flatnonzero(head)
        length = np.diff(np.r_[keep, len(sym)])
        run_id = {len(p): i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL and p and set(p) == {META}}
        table = np.array([run_id.get(n, -1) for n in range(self.longest_run + 1)])
        out = sym[keep]
        runs = is_space[keep]
        out[runs] = table[length[runs]]
        return out, word[keep]

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text with its dummy prefix; joined, they are the text again."""
        return WORD.findall(META + text.replace(" ", META)) if text else []

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        out: list[bytes] = []
        first = True
        for i in ids:
            p, _, kind = self.pieces[i]
            if kind == BYTE:
                out.append(bytes([int(p[3:5], 16)]))
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            elif kind == NORMAL:
                if first and p.startswith(META):
                    p = p[1:]
                out.append(p.replace(META, " ").encode())
            first = first and kind == CONTROL
        return _decode_utf8(b"".join(out))


def _merge_run(n: int, allowed: set[int]) -> list[int]:
    """Lengths that n spaces end up as when the leftmost pair that is a piece merges first."""
    parts = [1] * n
    while (i := next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in allowed), None)) is not None:
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


WORD = re.compile(f"{META}+[^{META}]*|[^{META}]+")


def _decode_utf8(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


class Encoder:
    """A model with a bounded store of encoded words."""

    def __init__(self, model: Model, cache_words: int = CACHE_WORDS):
        self.model, self.cache_words = model, cache_words
        self.known: dict[str, tuple[str, str, int]] = {}
        self.number = [str(i) for i in range(len(model.pieces))]
        self.plain = [p.replace(META, " ") if k == NORMAL else None for p, _, k in model.pieces]

    def _learn(self, words: list[str]) -> None:
        model, number, plain = self.model, self.number, self.plain
        done = 0
        for ids, ends in model.encode_words(words):
            numbers = [number[i] for i in ids]
            texts = [plain[i] for i in ids]
            begin = 0
            for w, end in zip(words[done : done + len(ends)], ends, strict=True):
                if None in (parts := texts[begin:end]):
                    text = model.decode([model.char_id[META], *ids[begin:end]])
                else:
                    text = "".join(parts)
                self.known[w] = (",".join(numbers[begin:end]), text, end - begin)
                begin = end
            done += len(ends)

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """For each text its ids as decimal numbers, their count, and the decoded text."""
        split = [self.model.words(t) for t in texts]
        need = set().union(*split) if split else set()
        if len(self.known) + len(need) > self.cache_words:
            self.known = {}
        self._learn(list(need.difference(self.known)))
        for words in split:
            found = [self.known[w] for w in words]
            ids = ",".join([f[0] for f in found])
            # The dummy prefix is the first character of the first word.
            yield ids, sum([f[2] for f in found]), "".join([f[1] for f in found])[1:]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(load(path))
    return _encoders[path]


def encode_documents(docs: DataFrame, model_path: str, keep_text: bool = False, chunk_chars: int = 1 << 21) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_text`` also ids and decoded."""
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_text:
        schema += ", ids string, decoded string"

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model_path)
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            ends = np.cumsum([len(t) for t in texts]) // chunk_chars
            for _, part in pd.Series(range(len(texts))).groupby(ends):
                rows = []
                for ids, n, decoded in encoder.encode_batch([texts[i] for i in part]):
                    rows.append((n, digest(ids), digest(decoded), *((ids, decoded) if keep_text else ())))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_text else [])])
                out.insert(0, "doc_id", pdf["doc_id"].to_numpy()[part.to_numpy()])
                yield out

    return as_long(as_text(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, schema), "doc_id")
