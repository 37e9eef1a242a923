"""Cross-tokenizer alignment against a plain version over the libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from goldweave.llm import alignment
from goldweave.llm.byte_pairs import byte_characters
from goldweave.llm.queries import op12_alignment

JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """All overlapping pairs of every document by two nested walks, counts in one dictionary."""

    def __init__(self):
        self.a = Tokenizer.from_file(JSON)
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in byte_characters().items()}
        self.bytes_a = {i: bytes(byte_of.get(c, 0) for c in t) for t, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        out = []
        for ids, of in ((ids_a, self.bytes_a.__getitem__), (ids_b, self.bytes_b)):
            at, spans = 0, []
            for i in ids:
                spans.append((i, at, at + len(of(i))))
                at = spans[-1][2]
            if b"".join(map(of, ids)) != (" " + text).encode():
                return [], []
            out.append(spans)
        return out

    def rows(self, texts):
        per, counts = [], Counter()
        for text in texts:
            a, b = self.tokens(text)
            links, j = [], 0
            for x, s, e in a:
                while j < len(b) and b[j][2] <= s:
                    j += 1
                k = j
                while k < len(b) and b[k][1] < e:
                    links.append((x, b[k][0]))
                    k += 1
            counts.update(links)
            cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
            groups, lo = [], 0
            for hi in cuts:
                sides = [",".join(str(i) for i, _, e in t if lo < e <= hi) for t in (a, b)]
                groups.append("|".join(sides))
                lo = hi
            per.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        most = {}
        for (_, y), n in counts.items():
            most[y] = max(most.get(y, 0), n)
        return [
            (n_a, n_b, n_g, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), h)
            for n_a, n_b, n_g, links, h in per
        ]


@pytest.fixture(scope="module")
def plain():
    return Plain()


def values(r):
    return r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]


def check(docs, got, plain):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], v) for r, v in zip(rows, plain.rows([r["text"] for r in rows]), strict=True))
    assert Counter((r["doc_id"], values(r)) for r in got.collect()) == want


@pytest.mark.parametrize("batch_chars", [alignment.BATCH_CHARS, 20_000, 1])
def test_odd_texts(odd, plain, batch_chars):
    check(odd, alignment.align_documents(odd, JSON, MODEL, batch_chars), plain)


def test_random_texts(spark, plain, monkeypatch):
    rng = random.Random(7)
    vocabulary = [t.replace("▁", " ") for t in (plain.b.id_to_piece(i) for i in range(300, 32000, 7))]
    odd = ["a", " ", "  ", "\n", "\n ", " \n", "é", "漢", "😀", "▁", "<s>", "<0x41>", "<|endoftext|>", "'s", "\x00", "\x1c", "\x85 ", "　", "19", "==", "\t"]
    texts = ["".join(rng.choice(rng.choice([odd, vocabulary])) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts += [" ", "  ", " a", "a ", " " * 50, "a" * 40_000, "\n" * 20_000, "x y " * 9000, "= " * 5000 + "="]
    docs = spark.createDataFrame([(i % 1400, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(alignment, "SLICE_BYTES", 3000)
    check(docs, alignment.align_documents(docs, JSON, MODEL, 5000), plain)


def test_segments_are_the_text():
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("ab \n\t\x85　\x1c") for _ in range(rng.randrange(1, 14)))
        parts = list(alignment.segments(t))
        assert "".join(parts) == " " + t and all(p[0] == " " for p in parts)


def test_empty_table(empty):
    assert alignment.align_documents(empty, JSON, MODEL).collect() == []
    assert alignment.pair_table(empty, JSON, MODEL).collect() == []


def test_pairs_of_the_corpus(spark, plain):
    docs = spark.createDataFrame([(1, "the the cat"), (2, "the cat sat"), (3, None)], "doc_id long, text string")
    got = {(r["a"], r["b"]): (r["count"], r["best"]) for r in alignment.pair_table(docs, JSON, MODEL).collect()}
    a, b = plain.tokens("the")
    assert got[a[0][0], b[0][0]] == (3, True)


def test_query_equals_the_plain_version(spark, plain):
    sf = "/root/testdata/sf0.001"
    check(spark.read.parquet(f"{sf}/documents.parquet"), op12_alignment(spark, sf), plain)
