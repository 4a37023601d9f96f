"""Texts as PNG images in a binary column (operator 5).

The payload (UTF-8 bytes, zeros up to a positive multiple of 64) is a grayscale
image 64 samples wide.  Writing: signature, IHDR, IDAT (zlib) and IEND chunks,
each with its CRC-32.  Reading tests the signature, every checksum and zlib's
own, and undoes the five scan-line filters with numpy.  The feature is a
perceptual hash: the 8 x 8 lowest frequencies of the cosine transform of a
32 x 32 reduction, one bit each for above the median, as hex.

Edge cases: null or empty text is 64 zero bytes; null and repeated doc_ids are
kept row by row; an empty table gives no rows; other columns are ignored; a
damaged image raises ValueError.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .storage import materialize
from .text_batches import slices, texts

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8

_k = np.arange(LOW)[:, None]
COSINES = np.cos(np.pi * _k * (2 * np.arange(SIDE)[None, :] + 1) / (2 * SIDE))


def payload_of(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def apply_filter(samples: np.ndarray, kind: int) -> np.ndarray:
    """Scan-line filter 0 to 4 of PNG, one byte per pixel."""
    left, up = np.zeros_like(samples), np.zeros_like(samples)
    left[:, 1:], up[1:] = samples[:, :-1], samples[:-1]
    if kind < 3:
        return samples - (0, left, up)[kind]
    a, b, c = left.astype(int), up.astype(int), np.zeros(samples.shape, int)
    c[1:, 1:] = samples[:-1, :-1]
    if kind == 3:
        return samples - ((a + b) // 2).astype(np.uint8)
    return samples - _paeth(a, b, c).astype(np.uint8)


def _paeth(a, b, c):
    p = a + b - c
    pa_, pb, pc_ = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc_), a, np.where(pb <= pc_, b, c))


def undo_filters(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    if not kinds.any():
        return lines
    out, up = np.empty_like(lines), np.zeros(lines.shape[1], np.uint8)
    for y, (kind, line) in enumerate(zip(kinds.tolist(), lines, strict=True)):
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line, dtype=np.uint8)
        elif kind == 2:
            out[y] = line + up
        elif kind in (3, 4):
            a = c = 0
            for x in range(lines.shape[1]):
                b = int(up[x])
                a = (int(line[x]) + ((a + b) // 2 if kind == 3 else int(_paeth(a, b, c)))) & 255
                out[y, x], c = a, b
        else:
            raise ValueError(f"PNG: unknown filter {kind}")
        up = out[y]
    return out


def write_png(payload: bytes, width: int = WIDTH, kind: int = 0) -> bytes:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.empty((len(samples), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, apply_filter(samples, kind) if kind else samples
    head = struct.pack(">IIBBBBB", width, len(samples), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grayscale PNG, rows by columns."""
    if data[:8] != SIGNATURE:
        raise ValueError("PNG: wrong signature")
    at, head, body, kind = 8, None, [], b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("PNG: cut short")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + chunk):
            raise ValueError(f"PNG: checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("PNG: only plain 8-bit grayscale is read")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"PNG: {e}") from None
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("PNG: wrong number of samples")
    lines = raw.reshape(head[1], head[0] + 1)
    return undo_filters(lines[:, 0], lines[:, 1:])


def cosine_hash(samples: np.ndarray) -> str:
    height, width = samples.shape
    across = samples.reshape(height, SIDE, width // SIDE).sum(axis=2, dtype=np.int64)
    if height >= SIDE:
        edges = np.arange(SIDE + 1) * height // SIDE
        small = np.add.reduceat(across, edges[:-1], axis=0) / np.diff(edges)[:, None]
    else:
        small = across[np.arange(SIDE) * height // SIDE].astype(float)
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (PNG)."""

    def run(batches):
        for whole in batches:
            for some in slices(whole):
                column = texts(some)
                media = [write_png(payload_of(x.as_buffer().to_pybytes())) for x in column.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pc.binary_length(column).cast(pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """``media`` with the payload read back and its feature."""

    def run(batches):
        for whole in batches:
            for some in slices(whole, "n_bytes", 8 << 20):
                images = [read_png(x.as_buffer().to_pybytes()) for x in some.column("media")]
                new = [pa.array([x.tobytes() for x in images], pa.binary()), pa.array([cosine_hash(x) for x in images], pa.string())]
                yield pa.RecordBatch.from_arrays([*some.columns, *new], ["doc_id", "n_bytes", "media", "payload", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def media_digests(docs: DataFrame) -> DataFrame:
    back = from_media(materialize(to_media(docs), "media"))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
