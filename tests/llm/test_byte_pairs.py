"""Byte-level BPE over overlapping chunks against the library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from goldweave.llm import byte_pairs
from goldweave.llm.queries import op13_byte_pairs

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["a", "'s", "'ll", "'", "  ", " ", "\n", "\t", " é", "漢", "😀", "1", "!", "'re", "\x1c", "\x85", "　", "the", "ing", "<|endoftext|>", "\r\n", "_"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(RANKS), special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def random_texts(n, parts, seed=2):
    rng = random.Random(seed)
    tokens = [b.decode("utf-8", "ignore") for b in byte_pairs.load(RANKS).pieces]
    return ["".join(rng.choice(rng.choice([ODD, tokens])) for _ in range(rng.randrange(parts))) for _ in range(n)]


def test_both_files_hold_the_same_ranks():
    assert byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_50k.json")) == byte_pairs.read_ranks(RANKS)


def test_encoding_equals_the_library(library):
    coder = byte_pairs.Encoder(byte_pairs.load(RANKS), cache_pieces=500)
    for t in random_texts(3000, 40):
        ids = library.encode_ordinary(t)
        assert coder.encode_text(t) == ids, t
        assert coder.pairs.decode_bytes(ids) == t.encode()


def test_stitched_chunks_are_the_whole_text():
    split = byte_pairs.pattern().findall
    for t in random_texts(2000, 60, seed=3):
        for chunk, overlap in ((8, 4), (30, 12)):
            assert byte_pairs.stitched(t, chunk, overlap) == split(t), t


@pytest.mark.parametrize("unit", [" ", "\n", "\t", "x", "!", "é", "ab1 ", "'s"])
def test_very_long_runs(unit, library):
    coder = byte_pairs.encoder(RANKS)
    t = unit * (1_000_000 // len(unit))
    ids = coder.encode_text(t)
    assert coder.pairs.decode_bytes(ids) == t.encode()
    assert byte_pairs.stitched(t) == byte_pairs.pattern().findall(t)
    part = t[:50_000]  # as far as the library's pattern goes
    assert coder.encode_text(part) == library.encode_ordinary(part)


@pytest.mark.parametrize(("chunk", "overlap"), [(byte_pairs.CHUNK_CHARS, byte_pairs.OVERLAP_CHARS), (64, 16), (4000, 40)])
def test_documents(odd, library, chunk, overlap):
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    got = byte_pairs.encode_documents(odd, RANKS, keep=True, chunk=chunk, overlap=overlap)
    rows = got.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == " ".join(map(str, ids)) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha(r["ids"].encode()) and bytes(r["decoded"]) == texts[r["doc_id"]].encode()
        assert r["decoded_sha256"] == sha(bytes(r["decoded"]))
    back = {r["doc_id"]: bytes(r["decoded"]) for r in byte_pairs.decode_documents(got, RANKS).collect()}
    assert back == {k: t.encode() for k, t in texts.items()}


def test_long_texts_across_tasks(spark, library):
    texts = ["x" * 300_000, " " * 200_000 + "a", "word 's " * 30_000, "".join(random_texts(1, 60_000, seed=5)), "\n" * 140_000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    got = byte_pairs.encode_documents(docs, RANKS, keep=True).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r["ids"] == " ".join(map(str, library.encode_ordinary(texts[r["doc_id"]])))


def test_empty_table(empty):
    assert byte_pairs.encode_documents(empty, RANKS).collect() == []


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_byte_pairs(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]].encode())
