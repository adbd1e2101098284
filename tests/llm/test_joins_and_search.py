import random
import re

import numpy as np
import pytest
from llm import corpus
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernstore.llm import components, jaccard_join, signature_tree, topk_search


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    """(doc_id, n_shingles, component_id) of every row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((k, len(sets[i]), min(ids) if ids else None))
    return out


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def family(rng, size, n, words=40):
    """Texts that drift away from a common origin."""
    base = [f"v{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(size)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_components_against_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, t) for i, t, *_ in corpus.rows()]
    for f in range(12):
        rows += [(100 + 40 * f + i, t) for i, t in enumerate(family(rng, 4, 12, rng.choice([6, 20, 60, 200])))]
    rows += [(2000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([2, 5, 9, 15, 60])))) for i in range(60)]
    rows += [(3000 + i, rows[60][1]) for i in range(30)]
    monkeypatch.setattr(jaccard_join, "TASK_TOKENS", 400)  # components of many blocks
    sf = corpus.saved(spark, corpus.clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), tmp_path)
    got = [tuple(r) for r in jaccard_join.op9_jaccard_join(spark, sf).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_components_with_a_hot_passage_and_many_chunks(spark, tmp_path, monkeypatch):
    """A passage in every document, a large group of near copies that chain, blocks of few rows, chunks of few shingles."""
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, f"{passage} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(rng.choice([3, 30])))}") for i in range(80)]
    base = [f"b{i}" for i in range(60)]
    for i in range(150):
        if i % 3 == 0:
            base[rng.randrange(60)] = f"n{i}"  # the group drifts, so that its ends have little in common
        rows.append((200 + i, " ".join(base)))
    rows += [(400 + i, " ".join(base[:50]) + f" tail{i}") for i in range(40)]
    for name, value in (("TASK_TOKENS", 1000), ("TASK_ROWS", 20), ("PIVOTS", 2), ("CHUNK_TOKENS", 500), ("RANGE_TOKENS", 64)):
        monkeypatch.setattr(jaccard_join, name, value)
    sf = corpus.saved(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(6), tmp_path)
    got = [tuple(r) for r in jaccard_join.op9_jaccard_join(spark, sf).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_shingles_of_a_very_long_text_take_little_memory():
    """40 MB in one text: the tables of powers stay small, and the hashes are those of the text in pieces."""
    import tracemalloc

    import pyarrow as pa

    from fernstore.llm import textblocks

    unit = "".join(f"word{i} " for i in range(200_000))
    text = unit * (40_000_000 // len(unit)) + "x" * 1_000_000
    column = pa.array([text, "a b c d e f"], pa.large_string())
    tracemalloc.start()
    sets = jaccard_join.shingle_sets(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 * len(text) and len(textblocks._POWER) == textblocks.PART + 1
    assert len(sets[1]) == 2
    once = jaccard_join.shingle_sets(pa.array([unit * 2 + "x" * 1_000_000], pa.large_string()))[0]
    assert (once == sets[0]).all()


def test_components_of_an_empty_table(spark, tmp_path):
    assert jaccard_join.op9_jaccard_join(spark, corpus.saved(spark, corpus.docs(spark, True), tmp_path)).count() == 0


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60) if i % 20] + [(100, x) for x in range(101, 140)] + [(5, 5), (None, 3), (200, 199), (199, 200)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 + 20 * ((i - 1) // 20) for i in range(1, 61)} | {x: 100 for x in range(100, 140)} | {199: 199, 200: 199}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_signature_tree_connects_what_links_connect(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(40):
        base = rng.integers(1, 2**63, rng.integers(1, 120), dtype=np.uint64)
        sets += [np.unique(np.where(rng.random(len(base)) < 0.1, rng.integers(1, 2**63, len(base), dtype=np.uint64), base)) for _ in range(rng.integers(1, 8))]
    sets.append(np.zeros(0, dtype=np.uint64))

    def groups(pairs):
        forest = signature_tree.Forest(len(sets))
        for a, b in pairs:
            forest.join(a, b)
        return [forest.find(i) for i in range(len(sets))]

    real = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    found = signature_tree.links(sets)
    assert set(map(frozenset, found)) <= set(map(frozenset, real)) and groups(found) == groups(real)
    some = np.array([i for i, s in enumerate(sets) if len(s)])
    left, right = some[::2], some[1::2]
    across = [(i, j) for i, j in real if (i in left) != (j in left)]
    assert groups(signature_tree.links(sets, 75, left, right)) == groups(across)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute_top(rows, k=20):
    v = {}
    for i, x, _ in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            v[i] = [int(np.floor(64 * float(np.float32(c)))) for c in x]
    out = []
    for q in (i for i in v if i % 20 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(v[q], v[i], strict=False)), i) for i in v if i != q))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_top_k_against_brute_force(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 8))
    rows = [(i, (centre[i % 4] + rng.normal(size=8)).astype(np.float32).tolist(), i) for i in range(700)]
    rows += [(1000 + i, rows[20][1], 0) for i in range(60)]  # equal vectors: ties
    rows += [(2000, None, 0), (2020, [0.0] * 8, 0), (2040, [None] * 8, 0), (2060, [float("nan")] * 8, 0), (2080, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (2100, [], 0), (2120, [1.0, 2.0], 0)]
    for block, queries in ((1 << 15, 1 << 11), (100, 7)):
        monkeypatch.setattr(topk_search, "BLOCK", block)
        monkeypatch.setattr(topk_search, "QUERY_BLOCK", queries)
        got = sorted(tuple(r) for r in topk_search.op3_topk_search(spark, corpus.saved(spark, spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit(1)), tmp_path, "embeddings")).collect())
        assert got == brute_top(rows)
    assert topk_search.op3_topk_search(spark, corpus.saved(spark, spark.createDataFrame([], VECTORS), tmp_path, "embeddings")).count() == 0


def brute_rows(v, q, own, k):
    scores = sorted((-sum(int(a) * int(b) for a, b in zip(x, q, strict=True)), i) for i, x in enumerate(v) if i != own)
    return [i for _, i in scores[:k]], [-s for s, _ in scores[:k]]


@pytest.mark.parametrize("scale", [1, 3, 1e5, 2e6, 1e8, 4e17])
def test_index_is_exact_at_every_scale(scale):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1, 16)) * scale * 20
    spread = rng.normal(size=(600, 16)) * (scale * 20 if scale < 1e5 else 3)  # near ties at the larger scales
    v = np.clip(np.floor(np.where(np.arange(600)[:, None] % 2, base, 0) + spread), -(2.0**62), 2.0**62).astype(np.int64)
    v[1::2] += rng.integers(-2, 3, (300, 16))
    index = topk_search.ImpactIndex(np.arange(600), v)
    for q in (0, 1, 2, 3, 501):
        ((ids, scores),) = index.search(v[q : q + 1], np.array([q]), 10)
        want = brute_rows(v, v[q], q, 10)
        assert (ids.tolist(), [int(x) for x in scores]) == want


def test_index_stops_early_only_on_proof():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 100
    v = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 5).astype(np.int64)
    index = topk_search.ImpactIndex(np.arange(4000), v)
    for q, (ids, scores) in enumerate(index.search(v[:60], np.arange(60), 10)):
        s = v @ v[q]
        s[q] = s.min() - 1
        order = np.lexsort((np.arange(4000), -s))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == s[order].tolist()
    assert index.queries == 60 and index.stopped > 20 and index.processed < 0.9 * index.postings
    # queries without components, and vectors that no dimension tells apart
    assert topk_search.ImpactIndex(np.arange(5), np.zeros((5, 0), dtype=np.int64)).search(np.zeros((1, 0), dtype=np.int64), np.array([2]), 3)[0][0].tolist() == [0, 1, 3]
    assert topk_search.ImpactIndex(np.arange(5), np.ones((5, 2), dtype=np.int64)).search(np.zeros((1, 2), dtype=np.int64), np.array([0]), 3)[0][1].tolist() == [0, 0, 0]


def test_repeated_ids_share_one_ranking(spark):
    v = [(0, [3, 1]), (0, [-1, 4]), (1, [2, 2]), (2, [5, 0]), (2, [5, 0]), (3, [1 << 40, 1 << 40]), (20, [1 << 60, 1 << 60])]
    df = spark.createDataFrame(v, "vec_id long, v array<long>")
    got = [tuple(r) for r in topk_search.top_k(df, F.col("vec_id") == 0, 4).orderBy("rank").collect()]
    pairs = sorted((-(a * x + b * y), i) for q, (a, b) in v if q == 0 for i, (x, y) in v if i != 0)[:4]
    assert got == [(0, r, i, -s) for r, (s, i) in enumerate(pairs, 1)]
    beyond = topk_search.top_k(df, F.col("vec_id") == 20, 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in beyond] == [(3, topk_search.LONG), (2, 5 << 60), (2, 5 << 60)]
    work = topk_search.search_work(df, F.col("vec_id") == 0, 4).first()
    assert work.queries == 2 and work.processed <= work.postings == 2 * 7 * 2
