"""SentencePiece coding, sharding and packing against the libraries and plain versions."""

import hashlib
import random
import time
import zlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from goldweave.llm import packing, sentencepieces, sharding

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encoding_equals_the_library(library):
    rng = random.Random(1)
    model = sentencepieces.load(MODEL)
    pieces = [p.replace("▁", " ") for p, _, k in model.pieces if k == sentencepieces.NORMAL]
    odd = ["a", "the", " ", "  ", "\n", "é", "漢", "😀", "▁", "<s>", "<0x41>", "ing", " " * 17, "\x00", "19", "​", "=="]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(25))) for _ in range(4000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(10))) for _ in range(6000)]
    texts += ["", " ", " " * 1000, "a" * 3000, "=" * 333, " a", "a "]
    texts += [" " * n + t for n in range(40) for t in ("", "x", "漢", "the")]
    encoder = sentencepieces.Encoder(model, cache_words=2000)
    for i in range(0, len(texts), 1000):
        part = texts[i : i + 1000]
        for t, ids, (got, n, decoded) in zip(part, library.encode(part), encoder.encode_batch(part), strict=True):
            assert got == ",".join(map(str, ids)) and n == len(ids), t
            assert decoded == library.decode(ids) == model.decode(ids), t


def test_encoding_of_documents(odd, small, library):
    for docs in (odd, small):
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        got = sentencepieces.encode_documents(docs, MODEL, keep_text=True).collect()
        assert len(got) == docs.count()
        for r in got:
            ids = library.encode(texts[r["doc_id"]])
            assert r["ids_sha256"] == sha(",".join(map(str, ids))) and r["n_tokens"] == len(ids)
            assert r["decoded"] == library.decode(ids) and r["decoded_sha256"] == sha(r["decoded"])


def test_jump_hash_moves_only_what_it_must():
    import numpy as np

    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 20000)
    before = sharding.jump_hash(keys, 1)
    assert not before.any()
    for n in range(2, 40):
        after = sharding.jump_hash(keys, n)
        moved = after != before
        assert (after[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.02
        before = after


def test_slots_are_gapless(odd, empty, small):
    for docs, block in ((odd, 4096), (small, 2), (empty, 4096)):
        rows = sharding.shard_documents(docs, block_rows=block).collect()
        assert len(rows) == docs.count()
        by = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r["slot"])
            assert r["grown_shard"] in (r["shard"], sharding.SHARDS)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    for r in sharding.shard_documents(odd).collect():
        assert r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])


def test_fullest_combination():
    rng = random.Random(3)
    for _ in range(300):
        available = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(0, 90)
        sums = {0}
        for length, n in available.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
        used = packing.fullest(available, room)
        assert sum(k * n for k, n in used.items()) == max(sums)
        assert all(n <= available[k] for k, n in used.items())


def test_packing(odd, empty, small):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (odd, small, empty):
        rows = packing.pack_documents(docs, RANKS, keep_ids=True).collect()
        bins, parts = {}, {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            parts.setdefault(r["doc_id"], []).append((r["piece"], r["start"], list(r["ids"])))
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024
        for r in docs.dropDuplicates(["doc_id"]).collect():
            want = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            pieces = sorted(parts[r["doc_id"]])[:: docs.filter(docs.doc_id.eqNullSafe(r["doc_id"])).count()]
            assert [i for _, _, ids in pieces for i in ids] == want
            assert [s for _, s, _ in pieces] == packing.cut_points(len(want), 1024)
        total = sum(r["length"] for r in rows)
        assert len(bins) <= 1.02 * total / 1024 + 2


def test_added_tokens_inside_texts(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a<|endoftext|>b", "one <|endoftext|> two<|endoftext|><|endoftext|>\n", "<|endoftext|", "<|ENDOFTEXT|> x", "plain"]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, keep_ids=True).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_ids_on_random_texts(spark):
    """Ids of whole documents equal the tokenizer file's, special strings, odd characters and all."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(13)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\t", "the", " Word", "don't", "123", "é", "漢字", "😀", "\u00a0", "ﬁ", "x" * 40, "'s", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, keep_ids=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def plain_jump(key, buckets):
    """Jump consistent hash of one unsigned key."""
    at, nxt = -1, 0
    while nxt < buckets:
        at = nxt
        key = (key * 2862933555777941757 + 1) % 2**64
        nxt = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


def test_shards_against_one_key_at_a_time(spark, odd, small):
    import struct

    import xxhash

    for docs in (odd, small):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r["doc_id"], []).append((r["text"] or "").encode())
        rows = sharding.shard_documents(docs, block_rows=3).collect()
        for r in rows:
            key = 42 if r["doc_id"] is None else xxhash.xxh64(struct.pack("<q", r["doc_id"]), seed=42).intdigest()
            assert (r["shard"], r["grown_shard"], r["law"]) == (plain_jump(key, 24), plain_jump(key, 25), "key")
            assert (r["size"], r["text_crc32"]) in {(len(t) + 8, zlib.crc32(t)) for t in texts[r["doc_id"]]}
        assert len(rows) == docs.count() and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    both = sharding.assign_shards(odd.withColumn("grown_shard", odd["doc_id"]), "doc_id")
    assert both.columns[-2:] == ["shard_", "grown_shard_"]


def test_rows_without_ids_are_numbered_by_many_tasks(spark):
    rows = spark.range(2000).selectExpr("cast(null as long) doc_id", "concat('text ', id) text")
    slots = sharding.shard_documents(rows, block_rows=2).collect()
    assert sorted(r["slot"] for r in slots) == list(range(2000)) and len({r["shard"] for r in slots}) == 1


@pytest.mark.parametrize("unit", ["th", "a", "the", "ab1", "漢", "=", "inging", "nnn"])
def test_one_very_long_word(library, unit):
    """A word without spaces takes rounds by its merges, not by its length."""
    text = unit * (200_000 // len(unit))
    begin = time.monotonic()
    ids, n, decoded = next(iter(sentencepieces.Encoder(sentencepieces.load(MODEL)).encode_batch([text])))
    assert time.monotonic() - begin < 20
    assert ids == ",".join(map(str, library.encode(text))) and decoded == text


def test_long_words_of_pieces(library):
    rng = random.Random(17)
    model = sentencepieces.load(MODEL)
    pieces = [p.replace("▁", "") for p, _, k in model.pieces if k == sentencepieces.NORMAL]
    leading = [model.pieces[i][0].replace("▁", "") for i in model.by_rank[model.leading[:-1]]]
    texts = ["".join(rng.choice(rng.choice((pieces, leading))) for _ in range(rng.randrange(400))) for _ in range(150)]
    few = [rng.sample(leading, 4) for _ in range(150)]
    texts += ["".join(rng.choice(f) for _ in range(200)) for f in few]
    for t, (ids, _, _) in zip(texts, sentencepieces.Encoder(model).encode_batch(texts), strict=True):
        assert ids == ",".join(map(str, library.encode(t))), t


@pytest.mark.parametrize("unit", [" ", "\n", "\t", "x", "!", "é", "a b"])
def test_packing_takes_a_megabyte_of_one_kind(unit, spark):
    """Runs that are too long for the library's pattern, added tokens beside them."""
    text = "a" + unit * (1_048_576 // len(unit)) + "<|endoftext|> b"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert packing.token_ids(packing.load_ranks(RANKS), RANKS, text) == ids
    pieces = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS).collect()
    assert sum(p["length"] for p in pieces) == len(ids) + 1
