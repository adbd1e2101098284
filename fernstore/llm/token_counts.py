"""Token counts by byte-pair merging over a heap and a linked list; no ids are built.

The symbols of a word are a doubly linked list. A heap holds the adjacent pairs that the vocabulary can merge, by
rank and then by place; the lowest is popped, stale entries are passed over, the pair becomes one symbol and its
new neighbours go on the heap. A word's count is its initial symbols minus its merges; a text's count is the sum
over its words. Words are counted once per block of text, and the pieces they consist of are kept in a
bounded memo of the worker process.

The rules of the tokenizer file (normaliser, splitting pattern, special strings) are read from the file:
``WordCounter`` handles byte-level BPE files whose words never cross white space.

Edge cases: null and empty texts have no tokens; special strings inside texts count as one token each, as the
library takes them by default; whole texts are counted, however long; repeated rows give repeated rows; an empty
table gives an empty result; other columns are ignored by the query and kept by the operator.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernstore.llm.shared import table
from fernstore.llm.textblocks import blocks, distinct_words, utf8, words

LIMIT = 2048
MEMO = 400_000


def count_after_merges(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """The number of symbols that remain of a word. ``merges``: by pair, its rank and the merged symbol."""
    n = count = len(symbols)
    heap = []
    for i in range(n - 1):
        if found := merges.get((symbols[i], symbols[i + 1])):
            heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    if not heap:
        return count
    heapq.heapify(heap)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while heap:
        _, i, left, right, merged = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = merged, -1
        k = after[i] = after[j]
        count -= 1
        if k < n:
            before[k] = i
            if found := merges.get((merged, symbols[k])):
                heapq.heappush(heap, (found[0], i, merged, symbols[k], found[1]))
        if (h := before[i]) >= 0 and (found := merges.get((symbols[h], merged))):
            heapq.heappush(heap, (found[0], h, symbols[h], merged, found[1]))
    return count


class WordCounter:
    """Counts the tokens of single words by the rules of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = rules["model"]
        vocabulary = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.vocabulary = vocabulary
        special = [t["content"] for t in rules["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_start = {s[:2].encode() for s in special}
        self.memo: dict[str, int] = {}
        self.simple = re.compile("[a-z]+")

    def piece(self, text: str) -> int:
        """The count of a piece in the byte alphabet of the vocabulary."""
        n = self.memo.get(text)
        if n is None:
            symbols = [self.vocabulary[c] for c in text[:-1]] + [self.vocabulary[text[-1] + self.suffix]]
            n = count_after_merges(symbols, self.merges)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[text] = n
        return n

    def plain(self, text: str) -> int:
        """The count of a text without special strings: normalised and split as the file says."""
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return sum(self.piece(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text) if p)

    def word(self, raw: bytes) -> int:
        text = raw.decode()
        # lower-case letters, perhaps with one mark after them: two pieces that need no rules
        if self.simple.fullmatch(text):
            return self.piece(text)
        if len(text) > 1 and text[-1] in ".,!" and self.simple.fullmatch(low := text[:-1].lower()) and text.isascii():
            return self.piece(low) + self.piece(text[-1])
        if self.special is None or not any(s in raw for s in self.special_start):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


@lru_cache(maxsize=2)
def _counter(path: str) -> WordCounter:
    return WordCounter(path)


def count_block(column: pa.Array, path: str) -> np.ndarray:
    """The number of tokens of each text of a column."""
    data, offsets = utf8(column)
    starts, ends, first = words(data, offsets)
    found, at = distinct_words(data, starts, ends)
    counter = _counter(path)
    each = np.fromiter(map(counter.word, found), dtype=np.int64, count=len(found))
    total = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(each[at], out=total[1:])
    return np.diff(total[first])


def with_token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit, which replace columns of the same names."""
    new = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in docs.columns if c not in new]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            n = count_block(block.column(at), tokenizer)
            size = np.diff(utf8(block.column(at))[1])
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(size), pa.array(n), pa.array(n > limit)], [*kept, *new])

    return docs.select(*(docs[c] for c in kept)).mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, k) for c, k in zip(new, (T.LongType(), T.LongType(), T.BooleanType()), strict=True))]))


def op6_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The tokens of every document by the 49k word vocabulary, without special tokens added."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = with_token_counts(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return counted.select(F.col("doc_id").cast("long"), "n_bytes", "n_tokens", "over_limit")
