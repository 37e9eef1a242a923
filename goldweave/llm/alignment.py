"""Cross-tokenizer alignment: DuckDB over the token intervals of each Arrow partition.

A text is cut where a space follows a character that is no white space.  Both tokenizers
end a token there, so what lies between two cuts, a segment, is tokenised and aligned by
itself, and a batch aligns each of its distinct segments once.

Inside a task DuckDB holds two tables of byte intervals, one for each tokenizer, on one
axis of bytes.  An ASOF join finds for each token of the first the token of the second in
which it begins, a range join those that begin before it ends; running sums of the ends
that both share number the groups.  Links of a batch are counted as (id, id, count); Spark
merges these partial counts, finds the highest count of each id of the second tokenizer,
and hands every batch the counts of its own pairs back.  What a batch must remember in
between (segments of documents, links of segments) is stored in the shared folder.

Defined results: null and empty texts, and texts with U+2581, which the second tokenizer
cannot tell from a space, have no tokens: zeros and an empty string; special tokens are
plain text; white space alone is a text like any other; texts of any length count whole;
repeated rows count and are returned once each; equal counts share the best place; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm import byte_pairs
from goldweave.llm.ids import as_long, as_text
from goldweave.llm.sentencepieces import META
from goldweave.llm.storage import materialize

#: Characters of the texts that a task aligns together.
BATCH_CHARS = 1 << 22
#: Bytes of distinct segments that DuckDB aligns at a time.
SLICE_BYTES = 1 << 18
#: Memory of a task's DuckDB, which never writes to disk.
DUCKDB_MEMORY = "200MB"
#: Texts longer than this are cut into segments one by one.
LONG_TEXT = 1 << 20
#: Characters from which a segment is encoded in chunks.
LONG_SEGMENT = 1 << 14
#: What follows an id in a text of groups: a token, the other side, a group, nothing.
MARKS = (",", "|", ";", "")

#: A segment ends before a space that follows no white space.
SEGMENT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*$)?|\s+")

_LINKS = """
WITH begun AS (SELECT a.seg, a.tok, a.id, a.e, b.tok AS low FROM a ASOF JOIN b ON a.s >= b.s)
SELECT x.seg, x.id AS a, b.id AS b FROM begun x JOIN b ON b.tok >= x.low AND b.s < x.e ORDER BY x.tok, b.tok"""
_GROUPS = """
SELECT x.seg, x.id, coalesce(sum((y.e IS NOT NULL)::INT) OVER (ORDER BY x.tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
FROM {x} x LEFT JOIN {y} y USING (e) ORDER BY x.tok"""
_PAIRS = """
SELECT a, b, sum(n)::BIGINT AS n, row_number() OVER (ORDER BY a, b) - 1 AS i FROM links JOIN weights USING (seg) GROUP BY a, b"""


def segments(text: str) -> Iterator[str]:
    """The segments of a text behind one space; joined, they are that text."""
    full = " " + text
    return (m[0] for m in SEGMENT.finditer(full)) if len(full) > LONG_TEXT else iter(SEGMENT.findall(full))


class Aligner:
    """Tokenises and aligns segments; one for each task."""

    def __init__(self, ranks_path: str, model_path: str):
        import duckdb
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pairs = byte_pairs.encoder(ranks_path)
        self.fast_a = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.pairs.pairs.ranks, special_tokens={})
        self.fast_b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.space_b = self.fast_b.piece_to_id(META)
        pieces = [(self.fast_b.id_to_piece(i), self.fast_b.is_byte(i)) for i in range(self.fast_b.get_piece_size())]
        self.raw = [bytes([int(p[3:5], 16)]) if is_byte else p.replace(META, " ").encode() for p, is_byte in pieces]
        self.widths_a = np.array([len(p) for p in self.pairs.pairs.pieces], np.int64)
        self.widths_b = np.array([len(p) for p in self.raw], np.int64)
        #: Every id as text before each of the marks that may follow it.
        self.marked = np.array([f"{i}{mark}" for mark in MARKS for i in range(max(len(self.widths_a), len(self.raw)))], object)
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})

    def tokens_a(self, segs: list[str]) -> list[list[int]]:
        """Ids by the ranks; segments that are long for the library's pattern are stitched from chunks."""
        encode = self.fast_a.encode_ordinary
        return [encode(s) if len(s) < LONG_SEGMENT else self.pairs.encode_text(s) for s in segs]

    def tokens_b(self, segs: list[str]) -> list[list[int]]:
        """Ids by the model, which puts a space before each segment: its own first one; a single space would vanish."""
        found = self.fast_b.encode([s[1:] for s in segs], num_threads=1)
        return [ids or [self.space_b] for ids in found]

    def align(self, segs: list[str]) -> tuple[pa.Table, list[str], np.ndarray]:
        """Links (seg, a, b) of all segments, the groups of each as text, and n_a, n_b, n_groups, n_links of each.

        A segment whose tokens do not spell it has null groups and zeros.
        """
        shown: list[str | None] = [None] * len(segs)
        counts = np.zeros((4, len(segs)), np.int64)
        links, begin, held = [], 0, 0
        for i, s in enumerate(segs):
            held += len(s)
            if held >= SLICE_BYTES or i == len(segs) - 1:
                links.append(self._slice(segs[begin : i + 1], begin, shown, counts))
                begin, held = i + 1, 0
        empty = pa.table({n: pa.array([], pa.int32()) for n in ("seg", "a", "b")})
        return pa.concat_tables(links) if links else empty, shown, counts

    def _slice(self, segs: list[str], first: int, shown: list, counts: np.ndarray) -> pa.Table:
        ids_a, ids_b = self.tokens_a(segs), self.tokens_b(segs)
        good = self._spelled(segs, ids_b)
        a, b = (self._intervals(ids, widths, good) for ids, widths in ((ids_a, self.widths_a), (ids_b, self.widths_b)))
        duck = self.duck
        duck.register("a", a), duck.register("b", b)
        links = duck.sql(_LINKS).to_arrow_table()
        groups = [duck.sql(_GROUPS.format(x=x, y=y)).to_arrow_table() for x, y in ("ab", "ba")]
        duck.unregister("a"), duck.unregister("b")
        texts, n_groups = self._shown(len(segs), *groups)
        shown[first : first + len(segs)] = [t or None for t in texts]
        of = [np.bincount(t["seg"].to_numpy(), minlength=len(segs)) for t in (a, b, links)]
        counts[:, first : first + len(segs)] = [of[0], of[1], n_groups, of[2]]
        columns = {"seg": links["seg"].to_numpy() + first, "a": links["a"].to_numpy(), "b": links["b"].to_numpy()}
        return pa.table({n: x.astype(np.int32) for n, x in columns.items()})

    def _spelled(self, segs: list[str], ids_b: list[list[int]]) -> list[bool]:
        """Whether the second tokenizer's bytes are the segment's; those of the first always are."""
        raw = self.raw
        if b"".join([raw[i] for ids in ids_b for i in ids]) == "".join(segs).encode() and not any(META in s for s in segs):
            return [True] * len(segs)
        return [b"".join([raw[i] for i in ids]) == s.encode() for s, ids in zip(segs, ids_b, strict=True)]

    def _shown(self, n: int, a: pa.Table, b: pa.Table) -> tuple[list[str], np.ndarray]:
        """For each segment its groups as text, and their number."""
        sides = [{c: t[c].to_numpy() for c in ("seg", "id", "g")} for t in (a, b)]
        side = np.repeat([0, 1], [len(x["seg"]) for x in sides])
        seg, ids, g = (np.concatenate([x[c] for x in sides]) for c in ("seg", "id", "g"))
        order = np.argsort(g * 2 + side, kind="stable")
        seg, ids, g, side = seg[order], ids[order], g[order], side[order]
        if not len(seg):
            return [""] * n, np.zeros(n, np.int64)
        same_g, same_seg = np.r_[g[1:] == g[:-1], False], np.r_[seg[1:] == seg[:-1], False]
        same_side = np.r_[side[1:] == side[:-1], False]
        mark = np.where(same_g, np.where(same_side, 0, 1), np.where(same_seg, 2, 3))
        parts = self.marked[mark * (len(self.marked) // len(MARKS)) + ids].tolist()
        ends = np.searchsorted(seg, np.arange(1, n + 1)).tolist()
        return ["".join(parts[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)], np.bincount(seg[~same_g], minlength=n)

    @staticmethod
    def _intervals(ids: list[list[int]], widths: np.ndarray, good: list[bool]) -> pa.Table:
        """seg, tok, id, s, e of the tokens of good segments, on one axis of bytes."""
        sizes = np.array([len(x) if ok else 0 for x, ok in zip(ids, good, strict=True)], np.int64)
        flat = np.array([i for x, ok in zip(ids, good, strict=True) if ok for i in x], np.int64)
        ends = np.cumsum(widths[flat])
        return pa.table({"seg": np.repeat(np.arange(len(ids)), sizes), "tok": np.arange(len(flat)), "id": flat, "s": ends - widths[flat], "e": ends})

    def pair_counts(self, links: pa.Table, weights: np.ndarray) -> tuple[pa.Table, pa.Table]:
        """Pairs (a, b, n, i) with how many links of the batch's documents hold them, and the links as (seg, i)."""
        duck = self.duck
        duck.register("links", links), duck.register("weights", pa.table({"seg": np.arange(len(weights), dtype=np.int32), "n": weights}))
        pairs = duck.sql(_PAIRS).to_arrow_table()
        duck.register("pairs", pairs)
        held = duck.sql("SELECT seg, i FROM links JOIN pairs USING (a, b) ORDER BY seg").to_arrow_table()
        for name in ("links", "weights", "pairs"):
            duck.unregister(name)
        return pairs, held


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(ranks_path: str, model_path: str) -> Aligner:
    key = (ranks_path, model_path)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def align_batch(aligner: Aligner, doc_ids: list, texts: list[array | None], segs: list[str]) -> dict:
    """One batch: its pairs, and packed its documents, their segments, and the pairs of segments."""
    links, shown, counts = aligner.align(segs)
    broken = np.array([s is None for s in shown], bool)
    codes = [np.frombuffer(t, np.int32) if t else np.zeros(0, np.int32) for t in texts]
    kept = [c if len(c) and not broken[c].any() else c[:0] for c in codes]
    sizes = np.array([len(c) for c in kept], np.int64)
    flat = np.concatenate([*kept, np.zeros(0, np.int32)])
    pairs, held = aligner.pair_counts(links, np.bincount(flat, minlength=len(segs)))
    sums = _sums(counts[:, flat], sizes)
    digests = [hashlib.sha256(";".join([shown[i] for i in c.tolist()]).encode()).hexdigest() if len(c) else "" for c in kept]
    docs = pa.table({
        "doc_id": pa.array(doc_ids, pa.string()), "size": sizes, "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": sums[3], "groups_sha256": digests,
    })
    per_seg = np.bincount(held["seg"].to_numpy(), minlength=len(segs)).astype(np.int32)
    return {
        "pairs": pa.StructArray.from_arrays([pairs["a"].combine_chunks().cast(pa.int32()), pairs["b"].combine_chunks().cast(pa.int32()), pairs["n"].combine_chunks()], names=["a", "b", "n"]),
        "docs": _packed(docs), "segs": _packed(pa.table({"seg": flat})), "sizes": _packed(pa.table({"n": per_seg})),
        "links": _packed(pa.table({"i": held["i"].to_numpy().astype(np.int32)})),
    }


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes along the last axis."""
    total = np.concatenate([np.zeros((*values.shape[:-1], 1), np.int64), np.cumsum(values, axis=-1)], axis=-1)
    ends = np.cumsum(sizes)
    return total[..., ends] - total[..., ends - sizes]


PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
BATCHES = "batch long, pairs array<struct<a: int, b: int, n: bigint>>, docs binary, segs binary, sizes binary, links binary"
RESULT = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def tokenize_batches(docs: DataFrame, ranks_path: str, model_path: str, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """One row for each batch of documents that a task aligned together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(ranks_path, model_path)
        number = TaskContext.get().partitionId() << 32
        ids: list[str | None] = []
        texts: list[array | None] = []
        codes: dict[str, int] = {}
        chars = 0

        def done() -> pa.RecordBatch:
            row = align_batch(aligner, ids, texts, list(codes))
            lists = pa.ListArray.from_arrays(pa.array([0, len(row["pairs"])], pa.int32()), row["pairs"])
            rest = [pa.array([row[n]], pa.binary()) for n in ("docs", "segs", "sizes", "links")]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists, *rest], ["batch", "pairs", "docs", "segs", "sizes", "links"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text.as_py()
                ids.append(doc_id.as_py())
                texts.append(array("i", [codes.setdefault(s, len(codes)) for s in segments(text)]) if text else None)
                chars += len(text or "")
                if chars >= batch_chars:
                    yield done()
                    number, chars, ids, texts, codes = number + 1, 0, [], [], {}
        if ids:
            yield done()

    return as_text(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, BATCHES)


def merged_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count over all batches, and whether no other a has a higher count with this b."""
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = totals.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of the second vocabulary at most
    return totals.join(F.broadcast(highest), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, ranks_path: str, model_path: str, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """One row per document: its tokens, groups and links, and how common its links are in the corpus."""
    batches = materialize(tokenize_batches(docs, ranks_path, model_path, batch_chars), "alignment")
    pairs = batches.select("batch", F.posexplode("pairs").alias("i", "p")).select("batch", "i", "p.a", "p.b", "p.n")
    counts = materialize(merged_counts(pairs), "pair-counts")
    back = pairs.select("batch", "i", "a", "b").join(counts, ["a", "b"]).select(F.col("batch").alias("of"), "i", "count", "best")

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        place = right["i"].to_numpy()
        count[place], best[place] = right["count"].to_numpy(), right["best"].to_numpy()
        out = []
        for docs, segs, sizes, links in zip(*(left[n].to_pylist() for n in ("docs", "segs", "sizes", "links")), strict=True):
            table, seg, i = _unpacked(docs), _unpacked(segs)["seg"].to_numpy(), _unpacked(links)["i"].to_numpy()
            of_seg = _sums(np.stack([best[i], count[i]]), _unpacked(sizes)["n"].to_numpy())
            of_doc = _sums(of_seg[:, seg], table["size"].to_numpy())
            out.append(table.drop_columns("size").add_column(5, "n_best", pa.array(of_doc[0])).add_column(6, "count_sum", pa.array(of_doc[1])))
        return pa.concat_tables(out)

    left = batches.select("batch", "docs", "segs", "sizes", "links")
    return as_long(left.groupBy("batch").cogroup(back.groupBy("of")).applyInArrow(finish, RESULT), "doc_id")


def pair_table(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """a, b, count, best of all pairs of ids that are linked somewhere in the corpus."""
    batches = materialize(tokenize_batches(docs, ranks_path, model_path), "alignment")
    return merged_counts(batches.select(F.explode("pairs").alias("p")).select("p.a", "p.b", "p.n"))
