"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Encoding follows the rules of a byte-pair SentencePiece model file with identity normalisation: a space goes before
the text, spaces are part of the pieces they begin, characters that the model lacks become byte pieces. A word,
spaces and what follows up to the next space, is merged by an agenda: of all candidates, adjacent pairs whose
concatenation is a piece, the one with the best piece is popped, leftmost first, and its neighbours make new
candidates. A popped candidate is skipped for good when the hash of the seed, the document's id, the word's place in it, the word and the candidate's
three borders falls below the dropout; this keyed hash needs no random state, so reruns agree. So every occurrence of a
word has skips of its own. With dropout 0 the pieces are the library's own.

Work is shared between the occurrences in a block of text that skip the same candidates: a word's agenda runs once without skips, which is
the segmentation of all occurrences that skip none of the merges it made; those that skip the same one of these first share the agenda without
it, and so on. An occurrence that shares with no other, or after ``LEVELS`` skips, has an agenda of its own. The agendas of all words of like length
run side by side: their symbols are rows of a matrix, linked lists are two more, and every round pops one candidate per row. Words of more
than ``LONG`` characters use a heap.

Decoding concatenates the pieces' bytes, spaces for their marks, and drops the first space. A text that holds
the mark U+2581 itself is safe too: it is written as bytes, where the library would turn it into a space.

Edge cases: null and empty texts have no pieces and decode to an empty text; long texts are encoded whole; rows
with equal ids and texts are segmented alike, a null id counts as 0; unknown ids and control pieces decode to nothing;
an empty table gives an empty result; columns ``ids`` and ``n_tokens`` of the input are replaced, others kept.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernstore.llm.shared import table
from fernstore.llm.textblocks import blocks, mix, pieces, spans, utf8, word_hashes

DROPOUT = 0.1
SEED = 11
LEVELS = 6
LONG = 256
NONE = np.int32(1 << 30)  # no candidate
MARK = "▁"

_STEPS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _limit(dropout: float) -> np.uint64:
    return np.uint64(min(int(dropout * 2.0**53), 2**53) << 11 if dropout < 1 else 2**64 - 1)


class PieceModel:
    """The pieces of a model file, and which pairs of them merge into which."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.best_first = np.argsort(np.argsort([-model.get_score(i) for i in range(n)], kind="stable")).astype(np.int32)
        self.by_rank = np.argsort(self.best_first).astype(np.int32)
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.char_id[ord(" ")], self.char_id[ord(MARK)] = self.char_id[ord(MARK)], -1
        found = {normal[p[:k]] << 20 | normal[p[k:]]: int(self.best_first[i]) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal}
        self.pairs = np.array(sorted(found), dtype=np.int64)
        self.ranks = np.array([found[k] for k in self.pairs.tolist()], dtype=np.int32)
        self.found = found
        raw = [p.replace(MARK, " ").encode() if p in normal else b"" for p in names]
        for b, i in enumerate(self.byte_id.tolist()):
            raw[i] = bytes([b])
        self.size = np.array([len(r) for r in raw], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that a and b merge into, or NONE."""
        key = a.astype(np.int64) << 20 | b
        key[(a < 0) | (b < 0)] = -1
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of id sequences that end at ``ends`` (0 first), without the space before each, and their ends."""
        known = (ids >= 0) & (ids < len(self.size))
        ids = np.where(known, ids, 0)
        sizes = np.where(known, self.size[ids], 0)
        data = self.raw[spans(self.at[ids], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])[ends]
        first = total[:-1][np.diff(total) > 0]
        first = first[data[first] == 0x20]
        return np.delete(data, first), total - np.searchsorted(first, total)


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def agenda(model: PieceModel, chars: np.ndarray, key: int, dropout: float) -> list[int]:
    """The pieces of one word by a heap and a linked list; -1 stands for a character that the model lacks."""
    ids = model.char_id[chars].tolist()
    n, limit = len(ids), int(_limit(dropout))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if i >= 0 and j < n and ids[i] >= 0 and ids[j] >= 0:
            r = model.found.get(ids[i] << 20 | ids[j])
            if r is not None:
                heapq.heappush(heap, (r, i, j, after[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        r, i, j, k = heapq.heappop(heap)
        if ids[i] == -2 or ids[j] == -2 or after[i] != j or after[j] != k:
            continue
        if dropout:
            h = (key + sum(x * int(s) for x, s in zip((i, j, k), _STEPS, strict=True))) % (1 << 64)
            if int(mix(np.array([h], dtype=np.uint64))[0]) < limit:
                continue
        ids[i], ids[j], after[i] = int(model.by_rank[r]), -2, k
        if k < n:
            before[k] = i
            push(i)
        if before[i] >= 0:
            push(before[i])
    return [x for x in ids if x != -2]


def _side_by_side(model: PieceModel, chars: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None, dropout: float, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The agendas of many words: a matrix of ids (-2 where a symbol was merged away or there is none), which of its cells are in words, and the rows and candidates of all merges.

    With ``keys`` the hash skips candidates; else each row's ``skips`` are skipped.
    """
    n, width = chars.shape
    column = np.arange(width + 1)
    inside = column[None, :width] < lengths[:, None]
    ids = np.where(inside, model.char_id[chars], -2)
    after = np.minimum(np.tile(column + 1, (n, 1)), width).astype(np.int16)
    before = np.tile(column - 1, (n, 1)).astype(np.int16)
    limit = _limit(dropout)
    lasts = lengths.astype(np.int64)

    def candidates(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The ranks of the pairs at i and j; NONE beyond the word and where they are skipped."""
        beyond = (j >= lasts[rows]) | (i < 0)
        j2 = np.where(beyond, 0, j)
        i2 = np.where(beyond, 0, i)
        out = model.rank(ids[rows, i2], ids[rows, j2])
        out[beyond] = NONE
        if keys is not None or skips.shape[1]:
            some = np.flatnonzero(out != NONE)
            k = np.minimum(after[rows[some], j[some]], lasts[rows[some]])
            found = _packed(i[some], j[some], k)
            out[some[mix(keys[rows[some]] + _hashed(found)) < limit if keys is not None else (skips[rows[some]] == found[:, None]).any(axis=1)]] = NONE
        return out

    ranks = np.full((n, width), NONE, dtype=np.int32)
    rows, i = np.nonzero(inside[:, 1:])
    if len(rows):
        ranks[rows, i] = candidates(rows, i, i + 1)
    active = np.arange(n)
    merged: list[tuple[np.ndarray, np.ndarray]] = [(active[:0], active[:0])]
    while len(active):
        own = ranks[active]
        i = own.argmin(axis=1)
        best = own[np.arange(len(active)), i]
        going = best != NONE
        active, i, best = active[going], i[going], best[going]
        if not len(active):
            break
        j = after[active, i].astype(np.int64)
        k = after[active, j].astype(np.int64)
        if keys is None:
            merged.append((active, _packed(i, j, np.minimum(k, lasts[active]))))
        ids[active, i], ids[active, j] = model.by_rank[best], -2
        after[active, i] = k
        before[active, k] = i
        ranks[active, j] = NONE
        ranks[active, i] = candidates(active, i, k)
        h = before[active, i].astype(np.int64)
        has = np.flatnonzero(h >= 0)
        ranks[active[has], h[has]] = candidates(active[has], h[has], i[has])
    return ids, inside, *(np.concatenate(c) for c in zip(*merged, strict=True))


def _packed(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A candidate's three borders in one number; words of the matrices have at most ``LONG`` characters."""
    return i.astype(np.int64) << 40 | j.astype(np.int64) << 20 | k


def _hashed(candidates: np.ndarray) -> np.ndarray:
    """What candidates add to the key."""
    part = np.int64((1 << 20) - 1)
    return (candidates >> 40).astype(np.uint64) * _STEPS[0] + (candidates >> 20 & part).astype(np.uint64) * _STEPS[1] + (candidates & part).astype(np.uint64) * _STEPS[2]


def _agendas(model: PieceModel, chars: np.ndarray, begins: np.ndarray, lengths: np.ndarray, which: np.ndarray, keys: np.ndarray | None, dropout: float, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An agenda for each of the words ``which``: all ids, the number of ids before each, all merged candidates in order, and their number before each.

    Merges are told only without ``keys``, and of words of at most ``LONG`` characters.
    """
    size = lengths[which]
    sizes, counts = np.zeros(len(which), dtype=np.int64), np.zeros(len(which), dtype=np.int64)
    parts: list[np.ndarray] = []
    traces: list[np.ndarray] = []
    order: list[np.ndarray] = []

    def put(rows: np.ndarray, ids: np.ndarray, at: np.ndarray, owner: np.ndarray) -> None:
        """Ids of ``rows`` in order; at: the characters they begin with; owner: which of the rows they are of."""
        lacking = np.flatnonzero(ids == -1)
        if len(lacking):
            raw = [chr(chars[a]).encode("utf-8") for a in at[lacking]]
            times = np.ones(len(ids), dtype=np.int64)
            times[lacking] = [len(r) for r in raw]
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[ids == -1] = model.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        sizes[rows] = np.bincount(owner, minlength=len(rows))
        parts.append(ids)
        order.append(rows)

    width = 4
    done = 0
    while done < min(LONG, int(size.max(initial=0))):
        chosen = np.flatnonzero((size > done) & (size <= width))
        step = max(1, (1 << 19) // width)
        for k in range(0, len(chosen), step):
            rows = chosen[k : k + step]
            at = np.minimum(begins[which[rows]][:, None] + np.arange(width), max(len(chars) - 1, 0))
            ids, inside, owner, merged = _side_by_side(model, chars[at], size[rows], None if keys is None else keys[rows], dropout, skips[rows])
            kept = inside & (ids != -2)
            put(rows, ids[kept], at[kept], np.broadcast_to(np.arange(len(rows))[:, None], ids.shape)[kept])
            counts[rows] = np.bincount(owner, minlength=len(rows))
            traces.append(merged[np.argsort(owner, kind="stable")])
        done, width = width, width + 4 if width < 24 else min(2 * width, LONG)
    for r in np.flatnonzero(size > LONG).tolist():
        w = which[r]
        own = chars[begins[w] : begins[w] + lengths[w]]
        ids = np.array(agenda(model, own, 0, 0.0) if keys is None else agenda(model, own, int(keys[r]), dropout), dtype=np.int32)
        # characters that the model lacks stay single, so they can be told from the rest in order
        lacking = np.flatnonzero(model.char_id[own] == -1) + begins[w]
        at = np.zeros(len(ids), dtype=np.int64)
        at[ids == -1] = lacking
        put(np.array([r]), ids, at, np.zeros(len(ids), dtype=np.int64))
    found = []
    rows = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
    for n, lists, kind in ((sizes, parts, np.int32), (counts, traces, np.int64)):
        before = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(before[-1], dtype=kind)
        if lists:
            out[spans(before[rows], n[rows])] = np.concatenate(lists)
        found += [out, before]
    return tuple(found)


def _first_skipped(keys: np.ndarray, own: np.ndarray, start: np.ndarray, merged: np.ndarray, before: np.ndarray, limit: np.uint64) -> np.ndarray:
    """For each key, which merge of its agenda ``own`` from number ``start`` on is the first that the hash skips; -1 for none."""
    hashed = _hashed(merged)
    out = np.full(len(keys), -1, dtype=np.int64)
    for c in range(0, len(keys), 1 << 18):
        o = own[c : c + (1 << 18)]
        n = before[o + 1] - before[o] - start[o]
        owner = np.repeat(np.arange(len(o)), n)
        hit = np.flatnonzero(mix(keys[c + owner] + hashed[spans(before[o] + start[o], n)]) < limit)
        by = owner[hit]
        first = np.flatnonzero(np.diff(by, prepend=-1))
        out[c + by[first]] = hit[first] - (np.cumsum(n) - n)[by[first]] + start[o[by[first]]]
    return out


def segmentations(model: PieceModel, words: list[bytes], at: np.ndarray, draws: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all occurrences ``at`` of words in one array, the number of ids before each, and each one's number without dropout. ``draws``: what sets an occurrence's skips."""
    text = b"".join(words).decode()
    chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = heads[np.cumsum([len(w) for w in words], dtype=np.int64)] if words else np.zeros(0, dtype=np.int64)
    begins = np.concatenate([[0], ends[:-1]]) if words else ends
    lengths = ends - begins
    which, skips = np.arange(len(words)), np.zeros((len(words), 0), dtype=np.int64)
    ids, before, merged, merges = _agendas(model, chars, begins, lengths, which, None, 0.0, skips)
    plain = np.diff(before)[at]
    node, total = at, len(words)
    parts, sizes = [ids], [np.diff(before)]
    if dropout and len(at):
        # the word takes part in the key by a sum over its characters
        place = np.arange(len(chars), dtype=np.uint64) - np.repeat(begins, lengths).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(chars.astype(np.uint64) * _STEPS[0] + place * _STEPS[1]))])
        keys = mix((sums[ends] - sums[begins])[at] + (draws.astype(np.uint64) + np.uint64(1)) * _STEPS[2] + mix(np.full(1, seed, dtype=np.uint64)))
        node = at.copy()
        alone = [np.flatnonzero(lengths[at] > LONG)]
        left = np.flatnonzero(lengths[at] <= LONG)
        own, start = at[left], np.zeros(len(words), dtype=np.int64)
        for level in range(LEVELS + 1):
            first = _first_skipped(keys[left], own, start, merged, merges, _limit(dropout))
            left, own, first = left[first >= 0], own[first >= 0], first[first >= 0]
            if level == LEVELS or not len(left):
                alone.append(left)
                break
            kinds, kind, count = np.unique(own * (LONG + 1) + first, return_inverse=True, return_counts=True)
            shared = count > 1
            alone.append(left[~shared[kind]])
            left, own = left[shared[kind]], (np.cumsum(shared) - 1)[kind[shared[kind]]]
            parents, start = kinds[shared] // (LONG + 1), kinds[shared] % (LONG + 1)
            which, skips = which[parents], np.column_stack([skips[parents], merged[merges[parents] + start]])
            ids, before, merged, merges = _agendas(model, chars, begins, lengths, which, None, 0.0, skips)
            node[left] = total + own
            total += len(which)
            parts.append(ids)
            sizes.append(np.diff(before))
        rest = np.concatenate(alone)
        ids, before, *_ = _agendas(model, chars, begins, lengths, at[rest], keys[rest], dropout, np.zeros((len(rest), 0), dtype=np.int64))
        node[rest] = total + np.arange(len(rest))
        parts.append(ids)
        sizes.append(np.diff(before))
    ids, size = np.concatenate(parts), np.concatenate(sizes)
    return ids[spans((np.cumsum(size) - size)[node], size[node])], np.concatenate([[0], np.cumsum(size[node])]), plain


def segment(model: PieceModel, words: list[bytes], draws: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in one array, and the number of ids before each."""
    return segmentations(model, words, np.arange(len(words)), draws, dropout, seed)[:2]


def encode_block(keys: np.ndarray, column: pa.Array, path: str, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all texts of a column in one array, the ends of the texts in it (0 first), and their numbers of ids without dropout. ``keys``: documents' ids."""
    model = _model(path)
    data, offsets = utf8(column)
    some = np.flatnonzero(np.diff(offsets))
    shift = np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
    data, offsets = np.insert(data, offsets[:-1][some], 0x20), offsets + shift  # the space before each text
    space = data == 0x20
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    cut[offsets] = True
    cuts = np.flatnonzero(cut) if len(data) else np.zeros(1, dtype=np.int64)
    first = np.searchsorted(cuts, offsets)
    coded = pieces(data, cuts)
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    owner = np.repeat(keys.astype(np.uint64), np.diff(first))
    place = np.arange(len(at), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    draws = mix(owner * _STEPS[1] + place * _STEPS[0] + np.uint64(seed))
    ids, before, plain = segmentations(model, words, at, draws, dropout, seed)
    return ids, before[first], np.diff(np.concatenate([[0], np.cumsum(plain)])[first])


def _keys(column: pa.Array) -> np.ndarray:
    """Numbers of documents: whole numbers as they are, other ids by a hash of their text, null as 0."""
    if not pa.types.is_integer(column.type):
        data, offsets = utf8(column.cast(pa.string()))
        some = np.flatnonzero(np.diff(offsets))
        out = np.zeros(len(column), dtype=np.uint64)
        out[some] = word_hashes(data, offsets[:-1][some], offsets[1:][some])
        return out.view(np.int64)
    return pa.compute.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def encode_pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``docs`` with the columns ids (array of int) and n_tokens."""
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    at, key_at = kept.index(text), kept.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, 8 << 20):
            ids, ends, _ = encode_block(_keys(block.column(key_at)), block.column(at), model, dropout, seed)
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*block.columns, made, pa.array(np.diff(ends))], [*kept, "ids", "n_tokens"])

    return docs.select(*(docs[c] for c in kept)).mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]))


def decode_pieces(coded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``coded`` with the texts of its ``ids`` in the column ``text``; null ids give a null text."""
    kept = [c for c in coded.columns if c != text]
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            flat = pa.compute.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
            data, ends = _model(model).decode(flat, ends)
            raw = data.tobytes()
            made = [raw[a:b].decode("utf-8", "replace") if column[i].is_valid else None for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*kept, text])

    return coded.select(*(coded[c] for c in kept)).mapInArrow(run, T.StructType([*(coded.schema[c] for c in kept), T.StructField(text, T.StringType())]))


def _same_texts(model: PieceModel, ids: np.ndarray, ends: np.ndarray, column: pa.Array) -> np.ndarray:
    """Which texts of a column their ids decode to."""
    data, offsets = utf8(column)
    back, at = model.decode(ids, ends)
    same = np.diff(at) == np.diff(offsets)
    if same.all():
        same[np.searchsorted(offsets, np.flatnonzero(data != back), side="right") - 1] = False
        return same
    raw, other = data.tobytes(), back.tobytes()
    return np.array([raw[a:b] == other[c:d] for a, b, c, d in zip(offsets[:-1], offsets[1:], at[:-1], at[1:], strict=True)])


def coded_and_checked(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Per document: key, ids, n_tokens, and lossless (whether the ids decode to the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, 2 << 20):
            ids, ends, _ = encode_block(_keys(block.column(0)), block.column(1), model, dropout, seed)
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([block.column(0), made, pa.array(np.diff(ends)), pa.array(_same_texts(_model(model), ids, ends, block.column(1)))], [key, "ids", "n_tokens", "lossless"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>, n_tokens long, lossless boolean")


_FACTS = "n_tokens long, n_plain long, ids_crc32 long, lossless boolean"


def piece_facts(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Per document: its number of pieces with dropout and without, the CRC-32 of the ids, and whether they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 8 << 20):
            keys = _keys(block.column(0))
            ids, ends, plain = encode_block(keys, block.column(1), model, dropout, seed)
            same = _same_texts(_model(model), ids, ends, block.column(1))
            view = memoryview(ids.astype("<u4")).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(ends)), pa.array(plain), pa.array(sums, pa.int64()), pa.array(same)], ["doc_id", *(f.split()[0] for f in _FACTS.split(", "))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {_FACTS}")


def op10_piece_coding(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Every document encoded with merge-dropout and decoded again."""
    import public_tokenizers

    return piece_facts(table(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"))
