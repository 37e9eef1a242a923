"""Media columns: lossless PNG images in binary columns and cosine-transform hashes.

``store_images`` writes payloads as 8-bit grey PNG files of 64 pixels a row;
``read_png`` walks the chunks, tests every checksum and undoes the row filters with
numpy; ``image_features`` reads stored images back and hashes their low frequencies.
All arithmetic is on integers, so equal images give equal features everywhere.

Defined results: null text is an empty payload, padded to one row of 64 zero bytes;
bytes that are no valid PNG give null features and the reason in ``error``; repeated
rows give equal values; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from goldweave.llm.ids import as_long, as_text

WIDTH = 64
LEVEL = 3
HASH_SIDE = 32
HASH_LOW = 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel of each colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(pixels: np.ndarray, level: int = LEVEL) -> bytes:
    """A grey 8-bit image; each row takes the filter with the least absolute sum."""
    height, width = pixels.shape
    tried = np.empty((3, height, width), np.uint8)
    tried[0] = pixels
    tried[1] = pixels
    tried[1, :, 1:] -= pixels[:, :-1]
    tried[2] = pixels
    tried[2, 1:] -= pixels[:-1]
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = tried[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Rows with their filter byte to raw rows; ``step`` is the bytes of a pixel."""
    kinds = rows[:, 0]
    out = rows[:, 1:].copy()
    height, width = out.shape
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    sub = np.flatnonzero(kinds == 1)
    if len(sub):
        part = out[sub].reshape(len(sub), width // step, step)
        out[sub] = np.add.accumulate(part, axis=1, dtype=np.uint8).reshape(len(sub), width)
    # Filters 2 to 4 need the row above; a stretch of equal filters is undone together.
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, height], strict=True):
        if kinds[a] == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.add.accumulate(out[a:b], axis=0, dtype=np.uint8)
        elif kinds[a] > 2:
            for i in range(a, b):
                _predict(out, i, step, int(kinds[i]))
    return out


def _predict(out: np.ndarray, i: int, step: int, kind: int) -> None:
    above = out[i - 1].astype(int) if i else np.zeros(out.shape[1], int)
    row = out[i].astype(int)
    for x in range(0, len(row), step):
        px = slice(x, x + step)
        left = row[x - step : x] if x else np.zeros(step, int)
        if kind == 3:
            row[px] = (row[px] + (left + above[px]) // 2) & 255
        else:
            corner = above[x - step : x] if x else np.zeros(step, int)
            guess = left + above[px] - corner
            dl, da, dc = abs(guess - left), abs(guess - above[px]), abs(guess - corner)
            near = np.where((dl <= da) & (dl <= dc), left, np.where(da <= dc, above[px], corner))
            row[px] = (row[px] + near) & 255
    out[i] = row


def read_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit, non-interlaced image as (height, width * channels)."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        content = data[at + 8 : at + 8 + size]
        if len(content) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + content)):
            raise ValueError(f"checksum of chunk {kind!r} fails")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("a required chunk is missing")
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or interlace or colour not in CHANNELS:
        raise ValueError("only 8-bit images without interlacing are read")
    step = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError(f"compressed data: {e}") from e
    if len(raw) != height * (width * step + 1):
        raise ValueError("image data has the wrong size")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width * step + 1), step)


def _cosines() -> np.ndarray:
    k, x = np.arange(HASH_LOW)[:, None], np.arange(HASH_SIDE)[None, :]
    return np.rint(np.cos(np.pi * k * (2 * x + 1) / (2 * HASH_SIDE)) * (1 << 12)).astype(np.int64)


COSINES = _cosines()


def _shrink(values: np.ndarray, side: int) -> np.ndarray:
    """Area means along the first axis, scaled by 256; short axes repeat their entries."""
    n = len(values)
    edge = np.arange(side) * n // side
    if n < side:
        return values[edge] * 256
    size = np.diff(np.r_[edge, n])
    return np.add.reduceat(values, edge, axis=0) * 256 // size[:, None]


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits in hexadecimal: which low-frequency coefficients exceed their median."""
    small = _shrink(_shrink(pixels.astype(np.int64), HASH_SIDE).T, HASH_SIDE).T
    low = (COSINES @ small @ COSINES.T).ravel()
    bits = low > np.sort(low[1:])[31]
    return np.packbits(bits).tobytes().hex()


def payload(text: str | None) -> tuple[int, np.ndarray]:
    raw = (text or "").encode()
    rows = max(1, -(-len(raw) // WIDTH))
    return len(raw), np.frombuffer(raw.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)


def store_images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes as a PNG file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(n, write_png(pixels)) for n, pixels in map(payload, pdf["text"])]
            out = pd.DataFrame(rows, columns=["n_bytes", "media"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return as_long(as_text(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, "doc_id string, n_bytes long, media binary"), "doc_id")


def _features(media: bytes | None) -> tuple:
    blank = (None,) * 6
    if media is None:
        return (*blank, "no media")
    try:
        pixels = read_png(media)
    except ValueError as e:
        return (*blank[:3], len(media), hashlib.sha256(media).hexdigest(), None, str(e))
    raw = pixels.tobytes()
    return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(pixels), None


def image_features(images: DataFrame) -> DataFrame:
    """Digests and hash of stored images, all taken from the bytes read back."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([_features(m) for m in pdf["media"]], columns=names)
            whole = {c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")}
            yield pd.concat([pdf[["doc_id", "n_bytes"]].reset_index(drop=True), out.astype(whole)], axis=1)

    return as_long(as_text(images.select("doc_id", "n_bytes", "media"), "doc_id").mapInPandas(run, schema), "doc_id")
