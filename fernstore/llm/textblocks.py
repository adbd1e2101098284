"""Whole-text kernels on Arrow blocks: numpy over the UTF-8 bytes of many documents at once.

A block is a slice of a record batch with at most ``BLOCK_BYTES`` of text (one longer text is a block of its
own), so a worker's memory is bounded by the block or the longest text. Hashes are taken in parts of ``PART`` bytes or
words, so that beside a long text there is little but its words' hashes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 12 << 20
BLOCK_ROWS = 1 << 15
PART = 1 << 18

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
_IN_WORD = np.ones(256, dtype=np.uint8)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = 0


def tidy() -> None:
    """Give freed memory back to the system: workers are reused, and later stages need the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is a glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text and ``BLOCK_ROWS`` rows each, in order; none is empty."""
    for batch in batches:
        tidy()
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(size, base + limit, side="right"))), start + BLOCK_ROWS)
            yield batch.slice(start, stop - start)
            start = stop
        del batch
    tidy()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the offsets of its texts in them; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of one kind, and the number of runs before each text (one more at the end).

    ``kinds``: by byte, its kind; bytes of kind 0 are in no run. No run crosses from one text to the next.
    """
    kind = np.zeros(len(data) + 1, dtype=np.uint8)
    np.take(kinds, data, out=kind[:-1])
    change = np.empty(len(data) + 1, dtype=bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    inside = np.flatnonzero(kind[at])
    starts = at[inside]
    return starts, at[np.minimum(inside + 1, len(at) - 1)], np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of bytes other than ASCII white space."""
    return runs(data, offsets, _IN_WORD)


def pieces(data: np.ndarray, cuts: np.ndarray) -> pa.DictionaryArray:
    """The pieces of ``data`` between successive cuts, dictionary-encoded."""
    buffer = pa.py_buffer(np.ascontiguousarray(data)) if len(data) else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, dtype=np.int64)), buffer]).dictionary_encode()


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and for each word its index among them."""
    if not len(starts):
        return [], np.zeros(0, dtype=np.int64)
    cuts = np.empty(2 * len(starts), dtype=np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    coded = pieces(data, cuts)  # every other piece is white space
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)[0::2].astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, in place on a uint64 array."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C15  # odd, so that powers have inverses modulo 2**64
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(base: int) -> np.ndarray:
    """The powers of a base from 0 to ``PART``."""
    p = np.full(PART + 1, np.uint64(base))
    p[0] = 1
    return np.multiply.accumulate(p)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _long_word(word: np.ndarray) -> int:
    """The sum of byte values times powers over a word of any length."""
    total = 0
    for k in range(0, len(word), PART):
        part = word[k : k + PART]
        total += int((_BYTE[part] * _POWER[: len(part)]).sum()) * pow(_BASE, k, 1 << 64)
    return total % (1 << 64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of byte values times powers: no loop over words."""
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        base = int(starts[a])
        b = int(np.searchsorted(ends, base + PART, side="right"))
        if b <= a:
            out[a] = _long_word(data[base : ends[a]])
            b = a + 1
        else:
            part, begin, end = data[base : ends[b - 1]], starts[a:b] - base, ends[a:b] - base
            sums = np.empty(len(part) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[part] * _POWER[: len(part)], out=sums[1:])
            out[a:b] = (sums[end] - sums[begin]) * _INVERSE[begin]
        a = b
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of each text, and the number of runs before each text.

    ``first`` counts the words before each text. A text with fewer words gives its whole sequence as one run;
    a text without words gives none.
    """
    count = np.diff(first)
    at = np.zeros(len(first), dtype=np.int64)
    np.cumsum(np.where(count >= n, count - n + 1, count > 0), out=at[1:])
    out = np.zeros(at[-1], dtype=np.uint64)
    for a in range(0, len(out), PART):
        b = min(a + PART, len(out))
        t, u = int(np.searchsorted(at, a, side="right")) - 1, int(np.searchsorted(at, b))
        own = np.repeat(np.arange(t, u), np.minimum(at[t + 1 : u + 1], b) - np.maximum(at[t:u], a))
        begin, size = np.arange(a, b) + (first[own] - at[own]), np.minimum(count[own], n)
        part = out[a:b]
        for k in range(n):
            # each place has its own multiplier, and a short text takes part with what it has
            term = hashes[np.minimum(begin + k, len(hashes) - 1)] * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
            if k:
                term[size <= k] = 0
            part = mix(part + term)
        out[a:b] = mix(part + size.astype(np.uint64))
    return out, at


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with the same keys, which follow each other in the batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(k[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of each, one run after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
