"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors become whole numbers, floor(64 x). A block of up to ``BLOCK`` vectors is an index. Each dimension has two
posting lists, of impacts that are never negative: the value above the block's least, for positive query components, and the value below its
most, for negative ones. Impacts are rounded up to whole steps, at most ``LEVELS``, of one size for all lists; a segment is the postings of one list
and impact.

Segments are processed by descending impact, those of all lists in turn, in rounds that reach the shares ``ROUNDS`` of all postings. A vector's
accumulator holds what is known of its score: the sum, over the lists of the query, of the query's component times the impact of
the vector's posting, or, while that is still to come, times the next impact to come. So it bounds the score from above, and a round's segments
only ever lower it. Dense vectors stand in every list, so a round's segments are held as a matrix of what they change, and are added
to the accumulators of ``TOGETHER`` queries at once as a product. The k-th best exact score of the leaders bounds what members must reach from below.
A query stops only when that proves that at most a small share of the vectors (``RESCORED``) can be members, or after the last segment; all possible
members are rescored exactly, and the k best, ties to the smaller id, are the block's answer. Answers of all blocks are merged per query, so the
result is exact.

Numbers: sums below 2**50 are exact in floating point. Beyond, bounds get a slack for rounding, and exact scores are computed as
64-bit or, where these could overflow, as unbounded integers.

Scale: queries (a stated set) meet all rows, which is work in proportion to their product whatever the method. A task builds the index of
one block and lets the queries stream past it, so that memory doesn't depend on their number; vectors are sent once per
``QUERY_BLOCK`` queries, and every task returns k rows a query.

Edge cases: vectors that are null, hold a null or a non-finite component, or have no id take no part; vectors of
another length than the query score over the dimensions both have; vectors without components score 0; rows
with equal ids are never each other's candidates, all count as candidates of others, and as queries share one ranking; components and
scores beyond a long are ranked as such but written as the nearest long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernstore.llm.shared import table, written

K = 20
SCALE = 64
EVERY = 20
LEVELS = 120
BLOCK = 1 << 14
QUERY_BLOCK = 1 << 16
TOGETHER = 128
#: Shares of the postings after which a proof is tried, and the share of a block that may be rescored after an early stop.
ROUNDS, RESCORED = (0.3, 0.5, 0.65, 0.8, 0.9, 1), 0.05
LONG = (1 << 63) - 1


class ImpactIndex:
    """Impact-ordered postings of one block. ``vectors``: int64 rows; ``ids``: their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.vectors = ids, vectors
        self.largest = max((abs(int(f(vectors))) for f in (np.min, np.max)), default=0) if vectors.size else 0
        self.numbers = vectors.astype(np.float64)
        self.low, self.high = self.numbers.min(axis=0, initial=np.inf), self.numbers.max(axis=0, initial=-np.inf)
        self.step = max(1.0, float(np.ceil((self.high - self.low).max(initial=0) / levels)))
        # by list (all dimensions upwards, then all downwards) and vector: the impact in steps
        impact = np.ceil(np.concatenate([self.numbers - self.low, self.high - self.numbers], axis=1) / self.step).astype(np.int16).T
        sizes = np.bincount(impact.ravel(), minlength=levels + 1)
        upto = sizes[::-1].cumsum()[::-1]  # postings of this impact or more
        self.next = levels
        #: By round: the impacts from this one on are done after it, the postings done by list, and what it changes.
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []
        before = self.next
        for share in ROUNDS:
            after = max(0, int(np.flatnonzero(upto >= share * upto[0])[-1]) - 1) if share < 1 else 0
            if after < before:
                self.rounds.append(((impact > after).sum(axis=1) if share < 1 else np.full(len(impact), len(ids)), (np.maximum(impact, after) - np.maximum(impact, before)).astype(np.float32)))
                before = after
        self.postings = self.processed = self.queries = self.stopped = 0

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The exact inner products of the query with these vectors; Python's integers where a long could overflow."""
        most = self.largest * max(abs(int(query.min(initial=0))), abs(int(query.max(initial=0)))) * len(query)
        if most < 1 << 53:
            return (self.numbers[rows] @ query.astype(np.float64)).astype(np.int64)
        if most <= LONG:
            return self.vectors[rows] @ query
        return self.vectors[rows].astype(object) @ query.astype(object)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (int64): the ids and scores of its k best vectors but those with its id in ``own``, best first."""
        return [x for a in range(0, len(queries), TOGETHER) for x in self._together(queries[a : a + TOGETHER], own[a : a + TOGETHER], k)]

    def _together(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n = len(self.ids)
        numbers = queries.astype(np.float64)
        weight = np.concatenate([np.maximum(numbers, 0), np.maximum(-numbers, 0)], axis=1)
        base = np.maximum(numbers, 0) @ np.where(np.isfinite(self.low), self.low, 0) - np.maximum(-numbers, 0) @ np.where(np.isfinite(self.high), self.high, 0)
        whole = np.abs(numbers) @ np.maximum(np.abs(self.low), np.abs(self.high)) * 2 + self.step * self.next * weight.sum(axis=1)
        slack = np.where(whole < 1 << 50, 0, whole * (queries.shape[1] + 8) * 2.0**-49)
        known = weight.sum(axis=1) * self.next
        kind = np.float32 if known.max(initial=0) < 1 << 24 else np.float64  # whole numbers, exactly, up to this
        known = np.broadcast_to(known.astype(kind)[:, None], (len(queries), n)).copy()
        best = np.full(len(queries), -np.inf)
        out: list = [None] * len(queries)
        left = np.arange(len(queries))
        done = np.zeros(len(queries), dtype=np.int64)
        for r, (reached, change) in enumerate(self.rounds or [(np.zeros(weight.shape[1], dtype=np.int64), np.zeros((weight.shape[1], n), dtype=np.float32))]):
            known[left] += weight[left].astype(kind) @ change.astype(kind, copy=False)
            done[left] = (weight[left] > 0) @ reached
            last = r >= len(self.rounds) - 1
            for q in left.tolist():
                bound = known[q]
                if n > 4 * k:
                    # the leaders' exact scores raise what members must reach
                    lead = np.argpartition(bound, n - 2 * k)[n - 2 * k :]
                    exact = self.scores(lead[self.ids[lead] != own[q]], queries[q])
                    if len(exact) >= k:
                        best[q] = max(best[q], float(np.sort(exact)[len(exact) - k]))
                possible = np.flatnonzero(bound >= (best[q] - base[q] - 2 * slack[q]) / self.step - (1e-6 if kind is np.float64 else 0.5))
                if last or len(possible) <= max(4 * k, RESCORED * n):
                    self.stopped += not last
                    out[q] = self._rescored(possible[self.ids[possible] != own[q]], queries[q], k)
            left = np.array([q for q in left.tolist() if out[q] is None], dtype=np.int64)
            if not len(left):
                break
        self.queries += len(queries)
        self.postings += n * int((numbers != 0).sum())
        self.processed += int(done.sum())
        return out

    def _rescored(self, possible: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        exact = self.scores(possible, query)
        if len(exact) > k:
            limit = np.sort(exact)[len(exact) - k]
            possible, exact = possible[exact >= limit], exact[exact >= limit]
        ids = self.ids[possible]
        rank = np.lexsort((ids, -exact))[:k] if exact.dtype != object else np.array(sorted(range(len(exact)), key=lambda i: (-exact[i], ids[i]))[:k], dtype=np.int64)
        return ids[rank], exact[rank]


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The rows that take part: vec_id and v, the components as whole numbers."""
    x = F.col(vector)
    # beyond the largest float nothing is finite; NaN is larger than any number
    sound = x.isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(sound).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(part: pa.Table, dims: int) -> np.ndarray:
    """The rows' vectors, padded with zeros, or cut, to ``dims`` components."""
    rows = part.column("v").combine_chunks()
    size = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), max(dims, int(size.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1])[None] < size[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return out[:, :dims]


def _searches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[ImpactIndex, pa.Table]]:
    """For each block, whose vectors come first, its index and its queries, some at a time."""
    held: list[pa.Table] = []
    index, key = None, None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        keys = part.column("block").to_numpy().astype(np.int64) << 32 | part.column("query_block").to_numpy()
        asks = part.column("query").to_numpy().astype(bool)
        edges = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if keys[a] != key:
                held, index, key = [], None, keys[a]
            if not asks[a]:
                held.append(part.slice(a, b - a))
            elif held:
                if index is None:
                    own = pa.concat_tables(held)
                    index = ImpactIndex(own.column("vec_id").to_numpy(), _matrix(own, max(pa.compute.max(pa.compute.list_value_length(own.column("v"))).as_py(), 0)))
                    held = [own.slice(0, 0)]
                yield index, part.slice(a, b - a)


def _meetings(vectors: DataFrame, is_query) -> DataFrame:
    """Every block of vectors followed by its queries, block by block."""
    rows, queries = vectors.count(), vectors.where(is_query).count()
    n_blocks = max(1, -(-rows // BLOCK))
    # blocks of queries beyond those that their number needs only serve to occupy the cluster
    n_query_blocks = max(1, -(-queries // QUERY_BLOCK), min(-(-vectors.sparkSession.sparkContext.defaultParallelism // n_blocks), -(-queries // 64)))
    h = F.xxhash64("vec_id", "v")
    block, query_block = F.pmod(h, F.lit(n_blocks)).cast("int"), F.pmod(h, F.lit(n_query_blocks)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.select(block.alias("block"), each(n_query_blocks).alias("query_block"), F.lit(False).alias("query"), "vec_id", "v")
    asked = vectors.where(is_query).select(each(n_blocks).alias("block"), query_block.alias("query_block"), F.lit(True).alias("query"), "vec_id", "v")
    return held.unionByName(asked).repartition("block", "query_block").sortWithinPartitions("block", "query_block", "query")


def _asked(index: ImpactIndex, queries: pa.Table, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    own = queries.column("vec_id").to_numpy()
    return [(o, *found) for o, found in zip(own.tolist(), index.search(_matrix(queries, index.vectors.shape[1]), own, k), strict=True)]


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """Per query: its k best other rows. ``vectors``: vec_id, v; ``is_query``: a condition on them.

    Returns query_id, rank (from 1), vec_id, score.
    """
    vectors = written(vectors, "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index, queries in _searches(batches):
            for a in range(0, queries.num_rows, 1024):
                found = _asked(index, queries.slice(a, 1024), k)
                ids = np.concatenate([i for _, i, _ in found])
                # as decimals, so that what is beyond a long keeps its rank
                scores = [int(x) for _, _, s in found for x in s]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([o for o, *_ in found], [len(i) for _, i, _ in found]).astype(np.int64)), pa.array(ids), pa.array(scores, pa.decimal128(38, 0))], ["query_id", "vec_id", "score"])

    met = _meetings(vectors, is_query).mapInArrow(run, "query_id long, vec_id long, score decimal(38,0)")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    score = F.greatest(F.lit(-LONG - 1).cast("decimal(38,0)"), F.least(F.lit(LONG).cast("decimal(38,0)"), F.col("score"))).cast("long")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def search_work(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """What a search costs: queries (per block), those stopped early, their postings, and those processed."""
    names = ["queries", "stopped", "postings", "processed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, ImpactIndex] = {}
        for index, queries in _searches(batches):
            seen[id(index)] = index
            _asked(index, queries, k)
        yield pa.RecordBatch.from_arrays([pa.array([sum(getattr(i, n) for i in seen.values())], pa.int64()) for n in names], names)

    work = _meetings(vectors, is_query).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return work.agg(*(F.sum(n).alias(n) for n in names))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every twentieth row of the embeddings, by whole-number inner product."""
    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)


SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id,
           coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::bigint as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""
