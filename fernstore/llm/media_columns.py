"""Media columns: documents stored as greyscale PNG images in a binary column, read back and fingerprinted.

Encoding: the UTF-8 bytes (null: none) are padded with zero bytes to a positive multiple of the row width and
become the samples of an 8-bit greyscale image ``width`` pixels wide. Each row takes the cheapest of the
filters None, Sub and Up by the sum of absolute differences; the rows go through zlib into IDAT chunks of at most
``CHUNK`` bytes. A text chunk ``n_bytes`` holds the unpadded length.

Decoding tests the signature, every chunk's CRC-32, the header and the zlib checksum, and undoes the five row
filters with numpy. The feature is a perceptual hash: the image is averaged into 32 x 32 cells (rows or columns
are repeated where there are fewer), a cosine transform is taken and the 8 x 8 lowest frequencies are compared
with their median: 64 bits, as a binary column (``hash``) and as 16 hexadecimal digits (``feature``). It depends on the pixels only.

Edge cases: null and empty texts are one row of zeros; long texts are taller images; equal texts give equal
bytes; broken stored bytes raise ``ValueError``, a null image gives null facts; other columns of the input pass through ``encode_media``
untouched, whatever their names, save that ``media`` is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernstore.llm.shared import table, written
from fernstore.llm.textblocks import blocks

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
CHUNK = 1 << 16
LEVEL = 4


def padded(raw: bytes, width: int = WIDTH) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of ``width``."""
    return raw + bytes(-len(raw) % width if raw else width)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def png_encode(raw: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """The PNG file whose samples are ``raw`` padded to whole rows."""
    pixels = np.frombuffer(padded(raw, width), dtype=np.uint8).reshape(-1, width)
    sub, up = pixels.copy(), pixels.copy()
    sub[:, 1:] -= pixels[:, :-1]
    up[1:] -= pixels[:-1]
    tried = np.stack([pixels, sub, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
    kind = cost.argmin(axis=0)
    rows = np.empty((len(pixels), width + 1), dtype=np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = tried[kind, np.arange(len(pixels))]
    packed = zlib.compress(rows.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(pixels), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(raw)) + body + _chunk(b"IEND", b"")


def _chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("the file ends inside a chunk")
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(body) != n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(png[at + 4 : at + 8 + n])):
            raise ValueError(f"checksum of chunk {kind!r} at byte {at}")
        yield kind, body
        at += 12 + n


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    x, y, z = abs(p - a), abs(p - b), abs(p - c)
    return a if x <= y and x <= z else b if y <= z else c


def unfilter(rows: np.ndarray) -> np.ndarray:
    """The pixels of filtered rows (a byte for the filter, then one byte a pixel).

    Runs of rows with None, Sub or Up are undone together; Average and Paeth depend on each pixel before.
    """
    kind, out = rows[:, 0], rows[:, 1:].copy()
    if kind.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    out[kind == 1] = np.cumsum(out[kind == 1], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(kind == 2, prepend=False, append=False))
    if (kind > 2).any():
        edges = np.zeros(0, dtype=np.int64)
        for y in range(len(out)):
            up = out[y - 1] if y else np.zeros(out.shape[1], dtype=np.uint8)
            if kind[y] == 2:
                out[y] += up
            elif kind[y] > 2:
                left = corner = 0
                for x in range(out.shape[1]):
                    above = int(up[x])
                    guess = (left + above) // 2 if kind[y] == 3 else _paeth(left, above, corner)
                    left, corner = (int(out[y, x]) + guess) & 255, above
                    out[y, x] = left
    for a, b in zip(edges[0::2], edges[1::2], strict=True):
        a = max(a - 1, 0)
        out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
    return out


def png_decode(png: bytes) -> tuple[np.ndarray, int]:
    """The pixels of an 8-bit greyscale PNG file, and the length that its text chunk states."""
    head, data, n_bytes, ended = None, [], None, False
    for kind, body in _chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        ended = kind == b"IEND"
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale image without interlacing")
    flat = zlib.decompress(b"".join(data))
    if len(flat) != head[1] * (head[0] + 1):
        raise ValueError("the image data has another size than the header states")
    pixels = unfilter(np.frombuffer(flat, dtype=np.uint8).reshape(head[1], head[0] + 1))
    return pixels, pixels.size if n_bytes is None else n_bytes


def _dct(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


CELLS, LOW = 32, 8
_BASIS = _dct(CELLS, LOW)


def _cells(a: np.ndarray, n: int) -> np.ndarray:
    """Means of ``n`` nearly equal runs of rows; with fewer rows, rows are repeated."""
    edges = np.arange(n + 1) * len(a) // n
    if len(a) < n:
        return a[np.minimum(edges[:-1], len(a) - 1)]
    return np.add.reduceat(a, edges[:-1], axis=0) / np.diff(edges)[:, None]


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies exceed their median, the constant term first."""
    small = _cells(_cells(pixels.astype(np.float64), CELLS).T, CELLS).T
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode_media(docs: DataFrame, text: str = "text", media: str = "media", width: int = WIDTH, level: int = LEVEL) -> DataFrame:
    """``docs`` with a binary column ``media`` in place of ``text``."""
    kept = [c for c in docs.columns if c not in (text, media)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, 32 << 20):
            for at in range(0, block.num_rows, 512):
                part = block.slice(at, 512)
                png = [png_encode((x.as_buffer().to_pybytes() if x.is_valid else b""), width, level) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(png, pa.binary())], [*part.schema.names[:-1], media])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(media, T.BinaryType())])
    return docs.select(*(docs[c] for c in kept), docs[text]).mapInArrow(run, schema)


FACTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hash binary"


def media_facts(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Per stored image, from its bytes alone: the length, the payload's digests, the file's digest and the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                if not x.is_valid:
                    rows.append((None,) * 8)
                    continue
                png = x.as_buffer().to_pybytes()
                pixels, n = png_decode(png)
                payload = pixels.tobytes()
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), (low := cosine_hash(pixels)).hex(), low))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(8)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, *(f.split()[0] for f in FACTS.split(", "))])

    return stored.select(key, media).mapInArrow(run, f"{key} {stored.schema[key].dataType.simpleString()}, {FACTS}")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as PNG in a table of the shared folder, and what the stored bytes give back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = written(encode_media(docs), "media", compression="none")
    return media_facts(stored).select(F.col("doc_id").cast("long"), *(f.split()[0] for f in FACTS.split(", ")))
