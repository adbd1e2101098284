"""Token-ID output: documents encoded with a public tokenizer into ORC files, in ascending order of their ids.

The files have the columns ``doc_id``, ``part`` (number of the file among the files of one table, which ascends
with doc_id), ``at`` (ids of the documents before this one in the same part) and ``ids`` (array of int, which ORC
stores with integer run-length encoding). Row indexes every ``ROW_STRIDE`` rows and Bloom filters on doc_id
let readers skip stripes and row groups; stripes are read in parallel. The place of a document in the whole
sequence is ``at`` plus the ids of all parts before: sums over one row a part.

Encoding works on the distinct pieces of a block of text: a text is cut before each single space that stands
between two visible characters, which no token of a byte-level vocabulary with the usual pattern crosses, and
each distinct piece goes through the tokenizers library once; a worker process keeps
the ids of the first ``MEMO`` pieces it has met.

Edge cases: null and empty texts have the end id only; long texts are encoded whole; documents with equal ids
are ordered by text, null ids come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernstore.llm.shared import shared_path, table, written
from fernstore.llm.textblocks import blocks, pieces, spans, utf8

END_ID = 2
PART_BYTES, MOST_PARTS = 128 << 20, 100_000
ROW_STRIDE = 1000
STRIPE_BYTES = 16 << 20
MEMO = 300_000
GROUP = 128  #: pieces that are encoded as one text


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer of a file, and which of its ids begin with a space."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
    return tokenizer, spaced


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where to cut: at the texts' ends, and before single spaces between visible characters of one or two bytes."""
    here = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 2:
        latin = data == 0xC3  # first byte of two, of letters and two signs
        shown = (data > 0x20) & (data < 0x7F)
        after = shown | latin
        shown[1:] |= latin[:-1]
        here[1 : len(data) - 1] = (data[1:-1] == 0x20) & shown[:-2] & after[2:]
    here[offsets] = True
    return np.flatnonzero(here)


class _Memo:
    """The ids of the first ``MEMO`` pieces that a worker process has met, in one array."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.before = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def add(self, texts: list[bytes], ids: np.ndarray, before: np.ndarray) -> None:
        n = min(len(texts), MEMO - len(self.place))
        if n > 0:
            self.place.update(zip(texts[:n], range(len(self.place), len(self.place) + n), strict=True))
            self.before = np.concatenate([self.before, self.before[-1] + before[1 : n + 1]])
            self.ids = np.concatenate([self.ids, ids[: before[n]]])


@lru_cache(maxsize=2)
def _memo(path: str) -> _Memo:
    return _Memo()


def encode_distinct(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (each given once) in one array, and the number of ids before each text."""
    memo = _memo(path)
    place = np.fromiter((memo.place.get(t, -1) for t in texts), dtype=np.int64, count=len(texts))
    new = np.flatnonzero(place < 0)
    fresh = [texts[i] for i in new.tolist()]
    ids, ends = _encode(fresh, path)
    old = np.flatnonzero(place >= 0)
    sizes = np.empty(len(texts), dtype=np.int64)
    sizes[new], sizes[old] = np.diff(ends), (memo.before[1:] - memo.before[:-1])[place[old]]
    before = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(before[-1], dtype=np.int32)
    out[spans(before[new], sizes[new])] = ids
    out[spans(before[old], sizes[old])] = memo.ids[spans(memo.before[place[old]], sizes[old])]
    memo.add(fresh, ids, ends)
    return out, before


def _encode(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    tokenizer, spaced = _tokenizer(path)
    plain = [i for i, t in enumerate(texts) if t[:1] == b" " and t.count(b" ") == 1 and len(t) > 1 and 0x20 < t[1] != 0x7F and 0x20 < t[-1] < 0x7F]
    sizes = np.zeros(len(texts), dtype=np.int64)
    ids: list[np.ndarray] = []
    order: list[np.ndarray] = []
    joined = [plain[k : k + GROUP] for k in range(0, len(plain), GROUP)]
    done: set[int] = set()
    for k in range(0, len(joined), 64):
        part = joined[k : k + 64]
        for group, e in zip(part, tokenizer.encode_batch_fast([b"".join(texts[i] for i in g).decode() for g in part], add_special_tokens=False), strict=True):
            found = np.array(e.ids, dtype=np.int32)
            begin = np.flatnonzero(spaced[found])
            if len(begin) != len(group) or begin[0]:
                continue  # a piece that doesn't begin with a token of its own: these go one by one
            sizes[group] = np.diff(begin, append=len(found))
            ids.append(found)
            order.append(np.array(group))
            done.update(group)
    rest = [i for i in range(len(texts)) if i not in done]
    for k in range(0, len(rest), 512):
        group = rest[k : k + 512]
        for i, e in zip(group, tokenizer.encode_batch_fast([texts[i].decode() for i in group], add_special_tokens=False), strict=True):
            sizes[i] = len(e.ids)
            ids.append(np.array(e.ids, dtype=np.int32))
        order.append(np.array(group))
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    place = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
    before = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=before[1:])
    out = np.empty(before[-1], dtype=np.int32)
    out[spans(before[place], sizes[place])] = flat
    return out, before


def encode_block(column: pa.Array, path: str, end_id: int | None) -> pa.ListArray:
    """The ids of each text of a column."""
    data, offsets = utf8(column)
    cuts = safe_cuts(data, offsets) if len(data) else np.zeros(1, dtype=np.int64)
    # empty texts share a cut: each text has the pieces between the places of its ends
    first = np.searchsorted(cuts, offsets)
    coded = pieces(data, cuts)
    ids, before = encode_distinct(coded.dictionary.to_pylist(), path)
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = (before[1:] - before[:-1])[at]
    flat = ids[spans(before[at], sizes)]
    total = np.zeros(len(cuts), dtype=np.int64)
    np.cumsum(sizes, out=total[1:])
    bounds = total[first]
    if end_id is not None:
        extra = np.arange(len(bounds))
        out = np.empty(len(flat) + len(column), dtype=np.int32)
        ends = bounds[1:] + extra[:-1]
        keep = np.ones(len(out), dtype=bool)
        keep[ends] = False
        out[ends], out[keep] = end_id, flat
        flat, bounds = out, bounds + extra
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every document to ORC files at ``path``, in ascending order of ``key`` over all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for block in blocks(batches, text, 8 << 20):
            ids = encode_block(block.column(1), tokenizer, end_id)
            ends = ids.offsets.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.full(block.num_rows, part, dtype=np.int32)), pa.array(at + ends[:-1]), ids], [key, "part", "at", "ids"])
            at += int(ends[-1])

    slim = docs.select(key, text)
    # a part for each PART_BYTES of the files that are read, where that is more than the session's usual number
    size = int(slim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = size // PART_BYTES if size < 1 << 55 else 0  # sources of unknown size report the largest number
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_key = F.col(key).asc_nulls_first()
    ranges = slim.repartitionByRange(min(parts, MOST_PARTS), by_key) if parts > usual else slim.repartitionByRange(by_key)
    ordered = ranges.sortWithinPartitions(F.col(key).asc_nulls_first(), text)
    coded = ordered.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, part int, at long, ids array<int>")
    options = {"compression": "zstd", "orc.bloom.filter.columns": key, "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(ROW_STRIDE), "orc.stripe.size": str(STRIPE_BYTES)}
    coded.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, ids: list | DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Documents of token files: key and ids. A list of ids reaches the scan, where statistics, row indexes and Bloom filters
    pass over stripes and row groups; a table of them (column ``key``) is joined."""
    stored = spark.read.orc(path).select(key, "ids")
    if ids is None:
        return stored
    return stored.where(F.col(key).isin(ids)) if isinstance(ids, list) else stored.join(ids.select(key).distinct(), key, "left_semi")


def token_facts(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document of token files: its place in the whole sequence, its number of ids and their CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends = ids.offsets.to_numpy().astype(np.int64)
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends)), pa.array(sums, pa.int64())], [key, "part", "at", "n_tokens", "ids_crc32"])

    stored = spark.read.orc(path)
    kind = stored.schema[key].dataType.simpleString()
    facts = written(stored.select(key, "part", "at", "ids").mapInArrow(run, f"{key} {kind}, part int, at long, n_tokens long, ids_crc32 long"), "token_facts")
    parts = facts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a part: the only sort over all parts
    base = parts.selectExpr("part", "sum(n) over (order by part rows between unbounded preceding and current row) - n as base")
    return facts.join(base, "part").select(key, (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents encoded into ORC files of the shared folder, and what the files give back."""
    import public_tokenizers

    path = shared_path(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return token_facts(spark, path)
