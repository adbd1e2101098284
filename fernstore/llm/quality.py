"""Quality by importance resampling: which documents a target corpus would have given rather than the raw one.

Tokens are runs of letters and digits and runs of other visible characters, as written; their unigrams and
bigrams are hashed to ``BUCKETS`` buckets; bigrams that end in a word which is one of the two tokens before share one. Two generative models are smoothed bucket frequencies: the target's over
labelled documents of quality 1, the raw one's over all documents. A document's log-weight is the sum over its
n-grams of log target - log raw, and its mean weight the same over their number. Sampling without replacement by weight is a Gumbel top-k:
each document's key is the log-weight of ``LENGTH`` n-grams of its mean weight plus Gumbel noise drawn by hash from the seed and its id, and
the k largest keys are taken. A key of the plain sum would take short junk before long documents that are a little below the target.

``k`` is a parameter. Its default (``sample_size``) is the expected size of the sample that takes each document with probability
1 - exp(-weight / s), which is what Gumbel top-k does at the size it gives. The scale s lies, by logarithm, a share of ``TOWARDS_GOOD`` of the
way from that at which the labelled junk has a chance of ``JUNK_TAKEN`` on average to that at which labelled good documents would miss ``GOOD_MISSED``. So neither the corpus's
size nor a text's length decides how much is taken, and no document is taken or left for its weight alone.

Bound: the target's counts come from at most ``TARGET_DOCS`` labelled documents, the first by the hash of their ids. The
raw counts, the weights and k cover all documents. Bucket counts have a fixed size; the k-th largest key is
found by histograms that narrow down on it, never by a global sort.

Edge cases: null, blank and empty texts have weight 0 (log 1) and take part; equal keys at the border are all
taken; rows with equal ids share their noise; without target documents all weights are 0 and all rows are kept; an empty table gives an
empty result; the columns log_weight, mean_weight and key are replaced, others kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernstore.llm.shared import forget, table, written
from fernstore.llm.textblocks import blocks, mix, runs, utf8, word_hashes

BUCKETS = 1 << 14
TARGET_DOCS = 20_000
TEMPERATURE = 1.0
#: N-grams that a document counts as in its key, however long it is.
LENGTH = 64
#: Average chances of labelled junk to be taken, and of labelled good documents to be left.
JUNK_TAKEN, GOOD_MISSED, TOWARDS_GOOD = 0.02, 0.01, 0.1
#: Pseudo-counts of the target's model per n-gram of the target, spread like the raw model: they keep a small target
#: from rejecting what it merely hasn't shown.
SMOOTHING = 1.0
#: Where no junk is labelled: the mean weight with a chance of 63%, as a share of the least weight that an n-gram can have.
UNLABELLED_BORDER = 0.15
SEED = 23

_KINDS = np.full(256, 2, dtype=np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def ngram_buckets(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all unigrams, those of the bigrams that end at each token (-1 at a text's start), and the tokens before each text."""
    data, offsets = utf8(column)
    starts, ends, first = runs(data, offsets, _KINDS)
    words = word_hashes(data, starts, ends)
    one = (words % np.uint64(buckets)).astype(np.int64)
    two = np.full(len(words), -1, dtype=np.int64)
    if len(words) > 1:
        two[1:] = (mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) % np.uint64(buckets)).astype(np.int64)
        # words (not marks) that repeat one of the two tokens before share a bucket
        again = np.zeros(len(words), dtype=bool)
        again[1:] = words[1:] == words[:-1]
        again[2:] |= words[2:] == words[:-2]
        two[again & (_KINDS[data[starts]] == 1)] = 0
        two[first[:-1][first[:-1] < len(words)]] = -1
    return one, two, first


def _summed(pdf):
    """One row per kind with the sums of all arrays."""
    import pandas as pd

    total = np.sum([np.frombuffer(b, dtype="<i8") for b in pdf["counts"]], axis=0)
    return pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "part": [pdf["part"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})


def bucket_counts(docs: DataFrame, text: str = "text", target: str | None = None, buckets: int = BUCKETS) -> dict[int, np.ndarray]:
    """Counts by bucket over all rows (kind 0), and over those whose column ``target`` is true (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), dtype=np.int64)
        for block in blocks(batches, text, 1 << 20):
            one, two, first = ngram_buckets(block.column(0), buckets)
            chosen = np.repeat(pa.compute.fill_null(block.column(1), False).to_numpy(zero_copy_only=False), np.diff(first))
            for kind, keep in ((0, slice(None)), (1, chosen)):
                total[kind] += np.bincount(one[keep], minlength=buckets) + np.bincount(two[keep][two[keep] >= 0], minlength=buckets)
        # a row for each kind and sixteenth, so that sums are spread
        rows = [(kind, part, piece.astype("<i8").tobytes()) for kind in (0, 1) for part, piece in enumerate(np.split(total[kind], 16))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["kind", "part", "counts"])

    flag = F.col(target) if target else F.lit(False)
    rows = docs.select(F.col(text).alias(text), flag.alias("_target")).mapInArrow(run, "kind int, part int, counts binary")
    summed = rows.groupBy("kind", "part").applyInPandas(_summed, rows.schema).collect()  # 2 x BUCKETS numbers
    out = {0: np.zeros(buckets, dtype=np.int64), 1: np.zeros(buckets, dtype=np.int64)}
    for r in summed:
        out[r.kind][r.part * buckets // 16 : (r.part + 1) * buckets // 16] = np.frombuffer(r.counts, dtype="<i8")
    return out


def log_ratios(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TARGET_DOCS) -> np.ndarray:
    """Per bucket: log of its frequency in the target over that in all ``docs``."""
    good = labels.where(F.col(key).isNotNull() & (F.col("quality") == 1)).select(F.col(key).alias("_id")).distinct()
    good = good.orderBy(F.xxhash64("_id"), "_id").limit(limit).withColumn("_good", F.lit(True))  # at most ``limit`` rows
    counts = bucket_counts(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(good), F.col("_key") == F.col("_id"), "left"), "_text", "_good")
    if not counts[1].any():
        return np.zeros(BUCKETS)
    raw = (counts[0] + 1) / (counts[0] + 1).sum()
    pseudo = SMOOTHING * counts[1].sum()
    target = (counts[1] + pseudo * raw) / (counts[1].sum() + pseudo)
    return np.log(target) - np.log(raw)


def with_keys(docs: DataFrame, ratios: np.ndarray, key: str = "doc_id", text: str = "text", temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """``docs`` with log_weight, mean_weight and the Gumbel key."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    kept = [c for c in docs.columns if c not in ("log_weight", "mean_weight", "key")]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for block in blocks(batches, text, 1 << 20):
            one, two, first = ngram_buckets(block.column(at), len(ratio))
            each = ratio[one]
            each[two >= 0] += ratio[two[two >= 0]]
            total = np.concatenate([[0.0], np.cumsum(each)])
            # rounded, so that equal texts weigh the same wherever they stand in a block
            weight = np.round(np.diff(total[first]), 6)
            mean = np.round(weight / np.maximum(2 * np.diff(first) - 1, 1), 9)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(weight), pa.array(mean)], [*kept, "log_weight", "mean_weight"])

    weights = [T.StructField(c, T.DoubleType()) for c in ("log_weight", "mean_weight")]
    scored = docs.select(*(docs[c] for c in kept)).mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *weights]))
    # 52 bits of a hash, never 0 or 1
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    return scored.withColumn("key", LENGTH * F.col("mean_weight") / temperature - F.log(-F.log(uniform)))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value: -inf if there are no more than k. Counts in ``bins`` bins narrow down on it."""
    total, low, high = values.agg(F.count(column), F.min(column), F.max(column)).first()
    if k <= 0:
        return math.inf
    if total <= k:
        return -math.inf
    while low < high:
        width = (high - low) / bins
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        rows = values.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r.low):
            if k <= r.n:
                break
            k -= r.n
        if (r.low, r.high) == (low, high):
            # as narrow as numbers get: the values themselves
            last = values.where(F.col(column).between(low, high)).groupBy(column).count().orderBy(F.desc(column)).limit(bins).collect()
            for value, n in last:
                if k <= n:
                    return value
                k -= n
        low, high = r.low, r.high
    return low


def _taken(weights: np.ndarray, border: float, temperature: float) -> np.ndarray:
    """The chance of documents of these mean weights where the scale is the weight of mean weight ``border``."""
    return -np.expm1(-np.exp(np.clip(LENGTH * (weights - border) / temperature, -700, 50)))


def _border(good: tuple[np.ndarray, np.ndarray], junk: tuple[np.ndarray, np.ndarray], temperature: float) -> float:
    """The mean weight of the scale, from those of labelled documents: mean weights and how often there are."""

    def least(values: np.ndarray, times: np.ndarray, share: float) -> float:
        low, high = -10.0, 30.0
        while high - low > 1e-6:
            middle = (low + high) / 2
            low, high = (middle, high) if np.average(_taken(values, middle, temperature), weights=times) > share else (low, middle)
        return high

    if not len(good[0]):
        return -math.inf
    floor = UNLABELLED_BORDER * math.log(SMOOTHING / (1 + SMOOTHING))
    low, high = least(*junk, JUNK_TAKEN) if len(junk[0]) else floor, min(least(*good, 1 - GOOD_MISSED), 0.0)
    return min(low + TOWARDS_GOOD * (high - low), high)


def sample_size(weights: DataFrame, labels: DataFrame, key: str = "doc_id", temperature: float = TEMPERATURE) -> int:
    """How many documents to sample from ``weights`` (_id and mean_weight of all documents)."""
    marked = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_label")).agg(F.max("quality").alias("_quality"))
    # weights to three places: a few thousand rows, since logarithms of ratios of counts are small numbers
    seen = weights.join(marked, F.col("_id") == F.col("_label")).groupBy("_quality", F.round("mean_weight", 3).alias("w")).count().collect()
    of = lambda q: tuple(np.array([x[i] for x in seen if x[0] == q], dtype=np.float64) for i in (1, 2))
    border = _border(of(1), of(0), temperature)
    if border == -math.inf:
        return weights.count()
    chance = -F.expm1(-F.exp(F.least(LENGTH * (F.col("mean_weight") - border) / temperature, F.lit(50.0))))
    return round(weights.agg(F.sum(chance)).first()[0] or 0)


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, key: str = "doc_id", text: str = "text", temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """``docs`` with log_weight, mean_weight, key, and kept: whether the document is among the k sampled."""
    keyed = with_keys(docs, log_ratios(docs, labels, key, text), key, text, temperature, seed)
    slim = written(keyed.select(F.col(key).alias("_id"), "mean_weight", "key"), "quality_keys")
    border = kth_largest(slim, "key", sample_size(slim, labels, key, temperature) if k is None else k)
    forget(slim)
    return keyed.withColumn("kept", F.col("key") >= border)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of every document, its key, and whether the resampling keeps it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampled(docs, table(spark, sf_dir, "labels")).select(F.col("doc_id").cast("long"), "log_weight", F.col("key").alias("gumbel_key"), "kept")
