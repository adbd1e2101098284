"""Toxicity by class-conditional Kneser-Ney word models.

Words are runs of letters (bytes of ASCII letters and beyond), lower-cased in ASCII and Latin-1. Each class has an
interpolated model of two orders, both with Kneser-Ney counts: a pair of words counts the different words it has followed, a
word the different words it has followed, so that passages and phrases which are merely repeated count once.
Absolute discounts leave mass to the next order, all of it where something was seen once; below both orders, the classes share
one distribution of such counts over all training texts, so that a rare expression which one class has never
shown costs it a bounded amount. Near copies of earlier training texts give no counts. A document's features compare the length-normalised log-likelihoods:

* the mean over all words of log P(word | toxic) - log P(word | ordinary);
* the largest mean over windows of ``WINDOW`` words, and the mean of the ``TOP`` largest single differences, since an
  insult is a few words of a long text; both by the lower order, which a rare history can't mislead;
* the logarithm of the number of words.

A logistic regression, fitted on labelled texts that gave no counts, turns them into a score between 0 and 1.

Bound: the models are fitted in one task on at most ``TRAIN_DOCS`` labelled documents per class, the first by the hash of
their ids (of rows that share an id the least text); three of four give counts, one fits the regression. Labels are used for nothing else, and
lang, source and doc_id never. Scoring covers every whole text.

Edge cases: null and empty texts, and texts without letters, have difference 0 in all features and get the regression's score for
that; label rows with null labels or ids, or without a document, are passed over; without training rows of both classes every
score is 0; repeated rows are scored alike; an empty table gives an empty result; the columns score and predicted
are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernstore.llm.shared import table
from fernstore.llm.textblocks import blocks, mix, runs, utf8, word_hashes

TRAIN_DOCS = 2500
WINDOW, TOP = 5, 3
DISCOUNTS = (1.0, 1.5, 1.8)  # of counts of 1, 2, and 3 or more
SHARED_CUT = 3  #: of a word's shared count, which is there for rare words
COPIED = 0.5  #: share of three-word runs met in earlier training texts from which a text counts as a copy
UNKNOWN = 1e-7  # of the shared distribution, for each word never seen

_LETTERS = np.zeros(256, dtype=np.uint8)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def letter_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words before each text."""
    data, offsets = utf8(column)
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:  # capital letters of Latin-1, but the multiplication sign
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        lower[second] += 32
    starts, ends, first = runs(lower, offsets, _LETTERS)
    return word_hashes(lower, starts, ends), first


def _histories(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word the word before it (0 at a text's start), and the hash of both."""
    before = np.zeros_like(words)
    before[1:] = words[:-1]
    before[first[:-1][first[:-1] < len(words)]] = 0
    return before, mix(before * np.uint64(0x9E3779B97F4A7C15) + words)


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _discount(n: np.ndarray) -> np.ndarray:
    return np.array(DISCOUNTS)[np.minimum(n, 3) - 1]


class _Table:
    """Values by 64-bit key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values.astype(np.float32)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), default, dtype=np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.float32(default))


class KneserNey:
    """One class's bigram model over a shared unigram distribution."""

    def __init__(self, words: np.ndarray, before: np.ndarray, pairs: np.ndarray, triples: np.ndarray, shared: _Table):
        """The arrays hold the words of all training texts of the class, with their histories."""
        different = np.unique(triples, return_index=True)[1]
        words, before, pairs = words[different], before[different], pairs[different]
        key, at, n = np.unique(pairs, return_index=True, return_counts=True)
        history, word = before[at], words[at]
        # lower order: in how many different bigrams a word comes second
        kinds, times = _counts(word)
        total = max(len(key), 1)
        cut = _discount(times)
        self.lower_rest = cut.sum() / total
        self.lower = _Table(kinds, (times - cut) / total + self.lower_rest * shared.get(kinds, UNKNOWN))
        cut = _discount(n)
        seen = n > cut
        context, place = np.unique(history, return_inverse=True)
        sum_ = np.bincount(place, n)
        self.rest = _Table(context, np.bincount(place, cut) / sum_)
        self.pairs = _Table(key[seen], (n[seen] - cut[seen]) / sum_[place[seen]])
        self.shared = shared

    def log_p(self, words: np.ndarray, before: np.ndarray, pairs: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of the words after their histories, and without them."""
        lower = self.lower.get(words, -1.0)
        lower = np.where(lower < 0, np.float32(self.lower_rest) * shared, lower)
        return np.log(self.pairs.get(pairs, 0.0) + self.rest.get(before, 1.0) * lower), np.log(lower)


class ToxicityModel:
    """Both classes' models and the regression over their comparison."""

    def __init__(self, toxic: KneserNey, ordinary: KneserNey, shared: _Table):
        self.toxic, self.ordinary, self.shared = toxic, ordinary, shared
        self.weights = np.array([0.0, 1.0, 0.0, 0.0, 0.0])
        self.centre, self.scale = np.zeros(4), np.ones(4)

    def features(self, column: pa.Array) -> np.ndarray:
        words, first = letter_words(column)
        before, pairs = _histories(words, first)
        n = np.diff(first)
        out = np.zeros((len(n), 4))
        if not len(words):
            return out
        shared = self.shared.get(words, UNKNOWN)
        toxic, ordinary = (m.log_p(words, before, pairs, shared) for m in (self.toxic, self.ordinary))
        some = np.flatnonzero(n)
        out[some, 0] = np.add.reduceat((toxic[0] - ordinary[0]).astype(np.float64), first[some]) / n[some]
        gain = (toxic[1] - ordinary[1]).astype(np.float64)
        # windows end at each word and stay within the text
        total = np.concatenate([[0], np.cumsum(gain)])
        end = np.arange(1, len(gain) + 1)
        begin = np.maximum(end - WINDOW, np.repeat(first[:-1], n))
        out[some, 1] = np.maximum.reduceat((total[end] - total[begin]) / np.maximum(end - begin, WINDOW), first[some])
        order = np.lexsort((-gain, np.repeat(np.arange(len(n)), n)))
        best = np.concatenate([[0], np.cumsum(gain[order])])
        out[some, 2] = (best[np.minimum(first[some] + TOP, first[some + 1])] - best[first[some]]) / TOP
        out[:, 3] = np.log1p(n)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge."""
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = np.column_stack([np.ones(len(x)), (x - self.centre) / self.scale])
        w, ridge = np.zeros(a.shape[1]), np.diag([1e-6, *[1e-1] * (a.shape[1] - 1)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, column: pa.Array) -> np.ndarray:
        x = (self.features(column) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _originals(triples: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which texts are no near copies of earlier ones: copies would make chance words look like a class's own."""
    seen: set[int] = set()
    out = np.ones(len(first) - 1, dtype=bool)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        own = set(triples[a:b].tolist())
        out[i] = not own or len(own & seen) < COPIED * len(own)
        seen |= own
    return out


def fit(texts: pa.Array, toxic: np.ndarray, fold: np.ndarray, weight: np.ndarray) -> ToxicityModel | None:
    """The model of labelled texts; fold 0 fits the regression, the others give counts. None if a class is missing.

    ``weight``: how many documents of its class each text stands for.
    """
    words, first = letter_words(texts)
    before, pairs = _histories(words, first)
    triples = np.zeros_like(pairs)
    triples[1:] = pairs[:-1]
    triples[first[:-1][first[:-1] < len(words)]] = 0
    triples = mix(triples * np.uint64(0x9E3779B97F4A7C15) + words)
    kept = _originals(triples, first)
    owner = np.repeat(np.arange(len(toxic)), np.diff(first))
    counted = (fold[owner] != 0) & kept[owner]
    if not (counted & toxic[owner]).any() or not (counted & ~toxic[owner]).any():
        return None
    at = np.unique(pairs[counted], return_index=True)[1]
    kinds, times = _counts(words[counted][at])
    times = np.minimum(times, SHARED_CUT)
    shared = _Table(kinds, times / times.sum() * (1 - 1e-3) + UNKNOWN)
    models = [KneserNey(words[m], before[m], pairs[m], triples[m], shared) for m in (counted & toxic[owner], counted & ~toxic[owner])]
    model = ToxicityModel(*models, shared)
    held = np.flatnonzero((fold == 0) & kept)
    if len(set(toxic[held].tolist())) == 2:
        model.calibrate(model.features(texts.take(pa.array(held))), toxic[held].astype(np.float64), weight[held] / weight[held].mean())
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TRAIN_DOCS) -> ToxicityModel | None:
    """The model of the labelled documents whose crc32(key) mod 5 is not 0, ``limit`` of each class at most."""
    import pickle

    usable = labels.where(F.col(key).isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col(key).cast("string")) % 5 != 0))
    usable = usable.groupBy(F.col(key).alias("_id")).agg(F.max("toxic").alias("_toxic")).withColumn("_h", F.xxhash64("_id"))
    there = {r._toxic: r.n for r in usable.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    stands_for = [max(1.0, there.get(c, 0) / limit) for c in (0, 1)]
    # at most 2 x limit rows
    chosen = usable.where("_toxic = 1").orderBy("_h").limit(limit).unionByName(usable.where("_toxic = 0").orderBy("_h").limit(limit))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_key") == F.col("_id"))
    # one text per id, so that the bound holds however often an id is repeated
    rows = rows.groupBy("_h", "_toxic").agg(F.min("_text").alias("_text")).repartition(1).sortWithinPartitions("_h", "_toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            part = pa.Table.from_batches(held)
            texts = pa.concat_arrays([c.cast(pa.large_string()) for c in part.column("_text").chunks])
            fold = part.column("_h").to_numpy().view(np.uint64) % np.uint64(4)
            toxic = part.column("_toxic").to_numpy() == 1
            made = fit(texts, toxic, fold, np.where(toxic, stands_for[1], stands_for[0]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["model"])

    found = rows.mapInArrow(run, "model binary").collect()  # one row: a few MB, bounded by the limit
    return pickle.loads(found[0].model) if found else None


def with_toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, 1 << 20):
            score = np.zeros(block.num_rows) if shared.value is None else shared.value.score(block.column(at))
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    return docs.select(*(docs[c] for c in kept)).mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select(F.col("doc_id").cast("long"), held.alias("held_out"), "score", "predicted")
