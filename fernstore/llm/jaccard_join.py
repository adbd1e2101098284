"""N-gram Jaccard join: which documents are near copies, by the sets of their five-word shingles.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Two documents link when 100 |A & B| >= 75 |A | B|. The
join runs over all texts in these steps, none of which lets all pairs of a group meet:

1. Shingles are hashed to 64 bits, block by block of text. What is kept of a document is its set's size and a
   128-bit digest of the set; documents with equal digests are one class.
2. Rare shingles first: the shingle hashes, cut to a few more bits than their number needs, travel once to one task per
   range of hashes, packed by chunks of text; the tasks tell the chunks how many shingles of each of their documents
   occur anywhere else. A hash that documents of one chunk share travels once, without its documents, so a passage that
   all documents hold costs one entry per chunk. Rows are made for ranges that a chunk has hashes of, so there
   are never more rows than hashes. A document of which fewer than 75% are met elsewhere can link with nothing
   and drops out. (Cut hashes that collide only keep a document in.)
3. The classes left send each shingle with its number of classes; within a class the rarest come first. Two
   sets that link must share one of their ``n - ceil(0.75 n) + 1`` first shingles (prefix filter), so the
   connected components over these keys contain every link. Common passages are last in this order.
4. Each such component is joined by signature trees (``signature_tree``). A component of more than ``TASK_TOKENS``
   shingles or ``TASK_ROWS`` sets is dealt out to blocks of like size: cells of similar set sizes follow each other, and
   a cell too large for a block is split by hash, so that no sort or running sum over a component is needed. Every
   block is joined in itself and with ``PIVOTS`` members of the component, which connects a group of near copies across its
   blocks at a cost in proportion to it. Then only those outside the component's largest cluster still meet the
   other blocks whose sizes fit, and sets that belong together already aren't compared.
5. Components over the links found give each class, and so each document, its smallest document id.

Chance: two different shingles share a 64-bit hash with probability 2**-64, so among S different shingles about S**2 / 2**65 pairs
do (at 5e9, 30 GB of text: 0.7), and each of these moves one overlap by one; classes of different sets share a
digest with probability N**2 / 2**129 (nil). But for that the result is exact.

Edge cases: null, empty and blank texts have no shingles and link with nothing; fewer than five words are one
shingle; repeated rows and equal ids are documents of their own; a document without id never names a component
unless nothing else is in it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernstore.llm.components import connected_components
from fernstore.llm.shared import forget, table, written
from fernstore.llm.signature_tree import links
from fernstore.llm.textblocks import blocks, groups, mix, shingle_hashes, utf8, word_hashes, words

SHINGLE = 5
PERCENT = 75
BLOCK_BYTES = 1 << 20  # of text or hashes at a time
#: Shingles, and documents but for the last block's, that step 2 packs at a time; numbers of documents have 16 bits.
CHUNK_TOKENS, CHUNK_DOCS, NOBODY = 1 << 20, 1 << 15, 0xFFFF
#: Shingle hashes of one range of step 2.
RANGE_TOKENS = 1 << 20
#: Shingles and sets of one block of a large component in step 4, and the members that all its blocks meet.
TASK_TOKENS, TASK_ROWS, PIVOTS = 1 << 20, 1 << 10, 16
#: Tasks that a step is dealt to at most; beyond that each has several ranges, chunks or blocks, one after another.
MOST_TASKS = 1 << 15
#: Ratio of the set sizes within a cell of step 4.
CELL = 1.1
SALTS = 4
#: Documents whose ids may be sent to every task in step 3; beyond that texts and ids are joined by shuffle.
BROADCAST_DOCS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = utf8(column)
    data = _LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes, at = shingle_hashes(word_hashes(data, starts, ends), first, n)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal for equal sets, else different but for chance."""
    ends = np.cumsum([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x94D049BB133111EB):
        sums = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum(mix(flat * np.uint64(salt) + np.uint64(1)), out=sums[1:])
        each = sums[ends] - sums[np.concatenate([[0], ends[:-1]])] if len(sets) else np.zeros(0, dtype=np.uint64)
        out.append(each.view(np.int64))
    return out[0], out[1]


_FACTS = {
    "part": pa.int32(), "chunk": pa.int64(), "size": pa.int32(), "steps": pa.binary(), "owners": pa.binary(),
    "ids": pa.list_(pa.int64()), "n": pa.list_(pa.int64()), "d1": pa.list_(pa.int64()), "d2": pa.list_(pa.int64()), "met": pa.list_(pa.int64()),
}
_FACTS_DDL = "part int, chunk long, size int, steps binary, owners binary, ids array<long>, n array<long>, d1 array<long>, d2 array<long>, met array<long>"


def _binary(flat: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The parts of an array that begin at the given places, as binary values."""
    offsets = (np.append(begin, len(flat)) * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binary values, and how many each value has."""
    whole = column.cast(pa.large_binary()).combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    at = np.frombuffer(whole.buffers()[1], dtype=np.int64, count=len(whole) + 1, offset=8 * whole.offset)
    data = np.frombuffer(whole.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
    return data.view(kind), np.diff(at) // np.dtype(kind).itemsize


def _facts(**columns: pa.Array) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, t) for c, t in _FACTS.items()], list(_FACTS))


def _chunk_rows(ids: pa.Array, sets: list[np.ndarray], chunk: int, bits: int, low: int) -> Iterator[pa.RecordBatch]:
    """What is known of a chunk's documents, then a row for each range of cut hashes (all but their ``low`` last bits)."""
    d1, d2 = digests(sets)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    cut = np.concatenate(sets) >> np.uint64(64 - bits)
    order = np.argsort(cut)
    cut, owner = cut[order], np.repeat(np.arange(len(sets)), n)[order]
    first = np.flatnonzero(np.diff(cut, prepend=~cut[:1]))
    times = np.diff(first, append=len(cut))
    # what two documents of the chunk share is met by both; others need to know of it, but not whose it is
    met = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(sets))
    numbers = {k: pa.array([x.tolist()], pa.list_(pa.int64())) for k, x in (("n", n), ("d1", d1), ("d2", d2), ("met", met))}
    yield _facts(part=pa.array([-1], pa.int32()), chunk=pa.array([chunk]), ids=pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), **numbers)
    if not len(cut):
        return
    cut, owner = cut[first], np.where(times > 1, NOBODY, owner[first]).astype("<u2")
    part = cut >> np.uint64(low)
    begin = np.flatnonzero(np.diff(part, prepend=~part[:1]))
    steps = np.diff(cut, prepend=cut[:1])
    steps[begin] = cut[begin] & np.uint64((1 << low) - 1)
    steps = steps.astype("<u2" if steps.max() < 1 << 16 else "<u4")
    rows = _facts(
        part=pa.array(part[begin].astype(np.int32)), chunk=pa.array(np.full(len(begin), chunk)), size=pa.array(np.full(len(begin), steps.itemsize, dtype=np.int32)), steps=_binary(steps, begin), owners=_binary(owner, begin)
    )
    for k in range(0, len(begin), 256):
        yield rows.slice(k, 256)


def _met_elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range of cut hashes: for each chunk, which of its documents have hashes that occur elsewhere, and how many."""
    for part in groups(batches, ["part"]):
        size = part.column("size").to_numpy()
        values, owners, rows = [], [], []
        for width in np.unique(size).tolist():
            chosen = part.filter(pa.array(size == width))
            steps, n = _flat(chosen.column("steps"), f"<u{width}")
            total, first = np.cumsum(steps, dtype=np.uint64), np.cumsum(n) - n
            before = np.where(first > 0, total[first - 1], np.uint64(0))
            values.append((total - np.repeat(before, n)).astype(np.uint32))
            owners.append(_flat(chosen.column("owners"), "<u2")[0])
            rows.append(np.repeat(np.flatnonzero(size == width), n))
        value, owner, row = (np.concatenate(x) for x in (values, owners, rows))
        order = np.argsort(value)
        ranked = value[order]
        same = ranked[1:] == ranked[:-1]
        again = np.zeros(len(value), dtype=bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        again &= owner != NOBODY
        which, count = np.unique(row[again] << 16 | owner[again], return_counts=True)
        begin = np.flatnonzero(np.diff(which >> 16, prepend=-1))
        if len(begin):
            chunk = part.column("chunk").to_numpy()[which[begin] >> 16]
            yield pa.RecordBatch.from_arrays([pa.array(chunk), _binary((which & 0xFFFF).astype("<u2"), begin), _binary(count.astype("<u4"), begin)], ["chunk", "owners", "steps"])


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: a row per document with the number of its shingles that occur elsewhere."""
    for part in groups(batches, ["chunk"]):
        known = part.filter(pa.compute.is_valid(part.column("ids")))
        ids, *numbers = (known.column(c).combine_chunks().flatten() for c in ("ids", "n", "d1", "d2", "met"))
        met = numbers.pop().to_numpy()
        told = part.filter(pa.compute.is_null(part.column("ids")))
        if told.num_rows:
            met = met + np.bincount(_flat(told.column("owners"), "<u2")[0], _flat(told.column("steps"), "<u4")[0], len(met)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([ids, *numbers, pa.array(met)], ["doc_id", "n", "d1", "d2", "met"])


def document_facts(docs: DataFrame) -> DataFrame:
    """Steps 1 and 2. Per document (doc_id, text): doc_id, n (set size), d1, d2 (digest), met (shingles met elsewhere)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tokens = max(size // 6, 1)
    part_bits = max(4, int(tokens // RANGE_TOKENS).bit_length())
    bits = int(tokens).bit_length() + 5
    low = bits - part_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        sets: list[np.ndarray] = []
        held = 0
        for block in blocks(batches, "text", BLOCK_BYTES):
            ids.append(block.column(0))
            sets += shingle_sets(block.column(1))
            held += sum(len(s) for s in sets[-block.num_rows :])
            if held >= CHUNK_TOKENS or len(sets) >= CHUNK_DOCS:
                yield from _chunk_rows(pa.concat_arrays(ids), sets, chunk, bits, low)
                ids, sets, held, chunk = [], [], 0, chunk + 1
        if sets:
            yield from _chunk_rows(pa.concat_arrays(ids), sets, chunk, bits, low)

    packed = written(docs.select("doc_id", "text").mapInArrow(run, _FACTS_DDL), "shingles", compression="zstd")
    # about one range or chunk a task, so that no task is handed many of them in one batch
    parts, chunks = min(1 << part_bits, MOST_TASKS), min(max(8, tokens // CHUNK_TOKENS), MOST_TASKS)
    met = packed.where("part >= 0").select("part", "chunk", "size", "steps", "owners").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_met_elsewhere, "chunk long, owners binary, steps binary")
    known = packed.where("part < 0").select("chunk", "owners", "steps", "ids", "n", "d1", "d2", "met")
    rows = known.unionByName(met, allowMissingColumns=True).repartition(chunks, "chunk").sortWithinPartitions("chunk").mapInArrow(_document_rows, "doc_id long, n long, d1 long, d2 long, met long")
    facts = written(rows, "shingle_facts")
    forget(packed)
    return facts


def _least_overlap(n):
    """The overlap that a set of size n needs with any set that it links with."""
    return F.ceil(n * PERCENT / 100)


def _sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class (doc_id, d1, d2, c): c, n and its sorted shingle hashes as bytes, taken from its first document's text."""
    ids = classes.select(F.col("doc_id").alias("_id"))
    if classes.count() <= BROADCAST_DOCS:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            sets = shingle_sets(block.column(0))
            d1, d2 = digests(sets)
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["e1", "e2", "hashes"])

    texts = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = texts.mapInArrow(run, "e1 long, e2 long, hashes binary").dropDuplicates(["e1", "e2"])
    return sets.join(classes, (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2"))).select("c", "n", "hashes")


def _exploded(sets: DataFrame) -> DataFrame:
    """A row (h, c, n) for each shingle of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "hashes", BLOCK_BYTES):
            raw = block.column(2).cast(pa.large_binary())
            flat = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u8") for x in raw])
            n = block.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(block.column(0).to_numpy(), n)), pa.array(np.repeat(n, n))], ["h", "c", "n"])

    return sets.select("c", "n", "hashes").mapInArrow(run, "h long, c long, n long")


def _prefix_keys(sets: DataFrame) -> DataFrame:
    """Step 3: the keys (h, c) of each class that another class has too, among its rarest shingles."""
    rows = _exploded(sets)
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumnRenamed("h", "g")
    rows = rows.join(shared, rows.h == shared.g).select("h", "c", "n", "df")
    by_class = Window.partitionBy("c")
    rows = rows.withColumn("met", F.count(F.lit(1)).over(by_class)).where(F.col("met") >= _least_overlap(F.col("n")))
    place = F.row_number().over(by_class.orderBy("df", "h")) + F.col("n") - F.col("met")  # those met nowhere else come first
    return rows.withColumn("place", place).where(F.col("place") <= F.col("n") - _least_overlap(F.col("n")) + 1).select("h", "c")


def _star(keys: DataFrame) -> DataFrame:
    """Edges from each class to the smallest class with the same key."""
    least = keys.groupBy("h").agg(F.min("c").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("h").alias("g"), "b")
    return keys.join(least, keys.h == least.g).where("c <> b").select(F.col("c").alias("a"), "b").distinct()


def _tree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each task of a component: among all sets of a block, or between the sets of two (``left`` or not)."""
    for part in groups(batches, ["comp", "i", "j"]):
        c = part.column("c").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), dtype="<u8") for x in part.column("hashes").cast(pa.large_binary())]
        if part.column("i")[0].as_py() == part.column("j")[0].as_py():
            found = links(sets, PERCENT, known=part.column("cluster").to_numpy())
        else:
            block = part.column("block").to_numpy()
            left = block == part.column("i")[0].as_py()
            found = links(sets, PERCENT, np.flatnonzero(left), np.flatnonzero(~left), part.column("cluster").to_numpy())
        if found:
            a, b = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(c[a]), pa.array(c[b])], ["a", "b"])


def _joined(tasks: DataFrame, sets: DataFrame, tokens: int) -> DataFrame:
    """The links of all tasks: comp, i, j, block, c, cluster. ``tokens``: of all their members."""
    rows = tasks.join(sets.select("c", "hashes"), "c").select("comp", "i", "j", "block", "c", "cluster", "hashes")
    return written(rows.repartition(min(max(8, tokens // TASK_TOKENS), MOST_TASKS), "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_tree_links, "a long, b long"), "links")


def _dealt(members: DataFrame) -> DataFrame:
    """Members (comp, c, n and more) with the block of their component that they belong to."""
    cell = F.floor(F.log("n") / math.log(CELL)).cast("int")
    members = members.withColumns({"cell": cell, "weight": F.greatest(F.col("n"), F.lit(TASK_TOKENS // TASK_ROWS))})
    # a few hundred cells of a component at most, since they are logarithms of sizes
    before = Window.partitionBy("comp").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = members.groupBy("comp", "cell").agg(F.sum("weight").alias("total")).withColumn("upto", F.coalesce(F.sum("total").over(before), F.lit(0)))
    even = F.pmod(F.xxhash64("c"), F.lit(1 << 20)) / (1 << 20)
    return members.join(cells, ["comp", "cell"]).withColumn("block", F.floor((F.col("upto") + even * F.col("total")) / TASK_TOKENS).cast("int")).drop("cell", "total", "upto")


def _spans(members: DataFrame) -> DataFrame:
    return members.groupBy("comp", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min_by("c", F.xxhash64("c")).alias("c"))


def _first_tasks(members: DataFrame) -> DataFrame:
    """Every block in itself, with the pivots of a component of several blocks."""
    spans = _spans(members)
    large = spans.groupBy("comp").agg(F.max("block").alias("last")).where("last > 0").select("comp")
    by_hash = Window.partitionBy("comp").orderBy(F.xxhash64("c"))
    pivots = spans.join(large, "comp").select("comp", "c", F.row_number().over(by_hash).alias("k")).where(F.col("k") <= PIVOTS).select("comp", "c")
    places = members.select("comp", "block", "c").unionByName(spans.select("comp", "block").join(pivots, "comp")).distinct()
    return places.select("comp", F.col("block").alias("i"), F.col("block").alias("j"), "block", "c", F.col("c").alias("cluster"))


def _later_tasks(members: DataFrame, first: DataFrame) -> DataFrame | None:
    """Members of large components outside their largest cluster, with all blocks whose sizes fit; None if there are none."""
    large = members.groupBy("comp").agg(F.max("block").alias("last")).where("last > 0").select("comp")
    if large.isEmpty():
        return None
    rows = members.join(large, "comp")
    ours = rows.select(F.col("c").alias("k"))
    clusters = connected_components(first.join(ours, first.a == ours.k, "left_semi"))
    rows = rows.join(clusters, rows.c == clusters.node, "left").select("comp", "c", "n", "weight", "block", F.coalesce("root", "c").alias("cluster"))
    weights = rows.groupBy("comp", "cluster").agg(F.sum("weight").alias("weight"))
    main = weights.groupBy("comp").agg(F.max_by("cluster", F.struct("weight", "cluster")).alias("main"))
    rows = written(rows.join(main, "comp"), "clusters")
    outside = rows.where("cluster <> main")
    if outside.isEmpty():
        return None
    # blocks of those outside have negative numbers
    dealt = written(_dealt(outside.drop("block", "weight", "main")).withColumn("block", -1 - F.col("block")).select("comp", "c", "n", "block", "cluster").unionByName(rows.where("cluster = main").select("comp", "c", "n", "block", "cluster")), "blocks")
    spans = _spans(dealt)
    x, y = spans.where("block < 0").alias("x"), spans.alias("y")
    fit = (F.col("x.high") * 100 >= F.col("y.low") * PERCENT) & (F.col("y.high") * 100 >= F.col("x.low") * PERCENT)
    once = (F.col("y.block") >= 0) | (F.col("y.block") <= F.col("x.block"))
    pairs = x.join(y, (F.col("x.comp") == F.col("y.comp")) & once & fit).select("x.comp", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    places = pairs.select("comp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return dealt.join(places, ["comp", "block"]).select("comp", "i", "j", "block", "c", "cluster")


def class_roots(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Steps 3 to 5: node and root of every class that links with another.

    ``classes``: c, n, d1, d2 and doc_id (a document with the class's text) of the classes that may link.
    """
    sets = written(_sets_of(docs, classes), "shingle_sets")
    keys = written(_prefix_keys(sets), "prefix_keys")
    comps = connected_components(_star(keys))
    members = sets.select("c", "n").join(comps, sets.c == comps.node).select("c", "n", F.col("root").alias("comp"))
    members = written(_dealt(members), "candidates")
    for done in (keys, comps):
        forget(done)
    tokens = members.agg(F.sum("n")).first()[0] or 0
    found = _joined(_first_tasks(members), sets, tokens)
    later = _later_tasks(members, found)
    if later is not None:
        found = found.unionByName(_joined(later, sets, 2 * tokens))
    roots = connected_components(found)
    for done in (sets, members, found):
        forget(done)
    return roots


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = document_facts(docs)
    classes = facts.where("n > 0").groupBy("d1", "d2").agg(F.min("n").alias("n"), F.max("met").alias("met"), F.min("doc_id").alias("doc_id"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    open_ = classes.where(F.col("met") >= _least_overlap(F.col("n")))
    roots = class_roots(docs, open_)
    named = classes.join(roots, classes.c == roots.node, "left").select("d1", "d2", "c", "root", "doc_id")
    # the members of a large component find its smallest id under several keys, so that they don't meet in one task
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = named.where("root is not null").withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"])
    named = linked.select("d1", "d2", "component_id").unionByName(named.where("root is null").select("d1", "d2", F.col("doc_id").alias("component_id")))
    named = named.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "component_id")
    out = facts.join(named, (facts.d1 == named.e1) & (facts.d2 == named.e2) & (facts.n > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-copy component of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = """
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
    from documents
), s as (
    select distinct doc_id, array_to_string(w[i : i + 4], ' ') as h
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)
), n as (
    select doc_id, count(*) as n from s group by doc_id
), links as (
    select a.doc_id as a, b.doc_id as b
    from s a join s b on a.h = b.h and a.doc_id <> b.doc_id
    join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
    group by a.doc_id, b.doc_id, x.n, y.n
    having 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach as (
    select doc_id as a, doc_id as b from n
    union
    select r.a, l.b from reach r join links l on r.b = l.a
), least as (
    select a as doc_id, min(b) as component_id from reach group by a
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(l.component_id, d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id left join least l on l.doc_id = d.doc_id
"""
