"""PNG files with every row filter, hashes; reply trees and their template."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from goldweave.llm import chat, media


def filtered(pixels, step, kinds):
    """Image data by the definition of each filter."""
    height, width = pixels.shape
    out = bytearray()
    for i in range(height):
        row = pixels[i].astype(int)
        up = pixels[i - 1].astype(int) if i else np.zeros(width, int)
        left, corner = (np.r_[np.zeros(step, int), x[:-step]] for x in (row, up))
        guess = left + up - corner
        a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        base = [np.zeros(width, int), left, up, (left + up) // 2, nearest][kinds[i]]
        out += bytes([kinds[i]]) + ((row - base) % 256).astype(np.uint8).tobytes()
    return bytes(out)


@pytest.mark.parametrize("colour", media.CHANNELS)
def test_every_filter_is_undone(colour):
    rng = np.random.default_rng(colour)
    step = media.CHANNELS[colour]
    pixels = rng.integers(0, 256, (23, 5 * step)).astype(np.uint8)
    data = zlib.compress(filtered(pixels, step, rng.integers(0, 5, 23)))
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", 5, 23, 8, colour, 0, 0, 0)), (b"tEXt", b"x"), (b"IDAT", data[:20]), (b"IDAT", data[20:]), (b"IEND", b"")]
    png = media.SIGNATURE + b"".join(media._chunk(*c) for c in chunks)
    assert (media.read_png(png) == pixels).all()
    broken = bytearray(png)
    broken[70] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(broken))
    with pytest.raises(ValueError):
        media.read_png(png[:-5])


def test_media_of_documents(spark, odd, empty):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    rows = media.image_features(media.store_images(odd)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        raw = texts[r["doc_id"]]
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["error"] is None
    assert len({r["feature"] for r in rows if texts[r["doc_id"]] == b""}) == 1
    assert media.image_features(media.store_images(empty)).count() == 0
    bad = spark.createDataFrame([(1, 2, bytearray(b"no")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r["error"] for r in media.image_features(bad).orderBy("doc_id").collect()] == ["no PNG signature", "no media"]


TEXTS = ["a", "\\<s>", "<|im_end|>\n", "", None, "\\\\n\\", "<<SYS>>[INST] <</s>", "</s>[INST] ok [/INST]", "\\.x", "<<s>>"]


def test_escaping_is_reversible():
    rng = random.Random(0)
    parts = [*chat.CONTROL, "\\", "\n", "<", "|", "n", ".", "[", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


@pytest.mark.parametrize("keep", [1, 3])
def test_branches(spark, keep):
    rng = random.Random(5)
    messages = []
    for conv, n in enumerate((1, 2, 7, 40, 90)):
        for i in range(n):
            parent = None if i == 0 else i - 1 if conv == 4 else rng.randrange(i)
            messages.append((conv, i, parent, rng.choice(["user", "assistant", "x\ny"]), rng.choice(TEXTS), float(rng.randrange(5))))
    df = spark.createDataFrame(messages, "conv_id long, node long, parent long, role string, text string, score double")
    got = {(r["conv_id"], r["rank"]): r for r in chat.format_branches(df, keep).collect()}
    for conv in range(5):
        own = {m[1]: m for m in messages if m[0] == conv}
        paths = []
        for leaf in set(own) - {m[2] for m in own.values()}:
            path, x = [], leaf
            while x is not None:
                path.append(own[x])
                x = own[x][2]
            paths.append((-sum(m[5] for m in path), -len(path), leaf, path[::-1]))
        for rank, (*_, path) in enumerate(sorted(paths)[:keep], 1):
            turns = [(m[3], m[4] or "") for m in path]
            r = got.pop((conv, rank))
            assert chat.parse(r["formatted"]) == turns
            loss = [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]]
            assert loss == [t for role, t in turns if role == "assistant"]
    assert not got


def test_trees_with_faults(spark):
    schema = "conv_id long, node long, parent long, role string, text string, score double"
    cycle = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)], schema)
    with pytest.raises(ValueError):
        chat.format_branches(cycle)
    orphan = spark.createDataFrame([(None, 1, 9, None, None, None)], schema)
    assert chat.format_branches(orphan).first()["formatted"] == chat.render([("", "")])[0]
    assert chat.format_branches(orphan.limit(0)).count() == 0


def test_turns_of_equal_place_follow_each_other(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.format_branches(chat.thread(df)).first()
    assert chat.parse(r["formatted"]) == [("system", ""), ("user", "a"), ("user", "a"), ("user", "b")]


def plain_feature(raw):
    """The hash by its definition: area means of 32 x 32, a cosine transform, the median of its low frequencies; integers all through."""
    height = len(raw) // 64
    rows = [list(raw[64 * i : 64 * i + 64]) for i in range(height)]

    def means(values, side):
        n = len(values)
        cut = [i * n // side for i in range(side)] + [n]
        if n < side:
            return [[v * 256 for v in values[c]] for c in cut[:side]]
        return [[sum(values[k][x] for k in range(a, b)) * 256 // (b - a) for x in range(len(values[0]))] for a, b in zip(cut, cut[1:])]

    small = [list(x) for x in zip(*means([list(x) for x in zip(*means(rows, 32))], 32))]
    wave = [[round(math.cos(math.pi * k * (2 * x + 1) / 64) * 4096) for x in range(32)] for k in range(8)]
    low = [sum(wave[u][y] * wave[v][x] * small[y][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{int(''.join('1' if c > middle else '0' for c in low), 2):016x}"


def test_features_against_a_plain_transform(odd, small):
    for docs in (odd, small.limit(40)):
        texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
        for r in media.image_features(media.store_images(docs)).collect():
            raw = texts[r["doc_id"]]
            assert r["feature"] == plain_feature(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"))
