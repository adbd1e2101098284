import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from llm import corpus
from pyspark.sql import functions as F

import corpus_pipeline
from fernstore.llm import chat_format, jaccard_join, mixing, piece_coding, quality, toxicity

SF = "/root/testdata/sf0.01"


# --- toxicity


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = sum(r.predicted and r.toxic for r in held)
    assert right / sum(r.toxic for r in held) > 0.85 and right / sum(r.predicted for r in held) > 0.9


def test_toxicity_of_odd_rows(spark, tmp_path):
    docs = corpus.docs(spark)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(None, None, None), (99, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    corpus.saved(spark, corpus.clashing(docs), tmp_path)
    rows = toxicity.op4_toxicity(spark, corpus.saved(spark, labels, tmp_path, "labels")).collect()
    assert len(rows) == len(corpus.rows()) and all(0 <= r.score <= 1 for r in rows)
    for empty in (labels.limit(0), labels.where("toxic = 0")):
        rows = toxicity.op4_toxicity(spark, corpus.saved(spark, empty, tmp_path, "labels")).collect()
        assert len(rows) == len(corpus.rows()) and all(r.score == 0 for r in rows)
    corpus.saved(spark, corpus.docs(spark, True), tmp_path)
    assert toxicity.op4_toxicity(spark, corpus.saved(spark, labels, tmp_path, "labels")).count() == 0


def test_kneser_ney_sums_to_one():
    texts = pa.array(["a b c a b d", "a b a c", "d a b c c"], pa.large_string())
    words, first = toxicity.letter_words(texts)
    before, pairs = toxicity._histories(words, first)
    kinds = np.unique(words)
    shared = toxicity._Table(kinds, np.full(len(kinds), 1 / len(kinds)))
    model = toxicity.KneserNey(words, before, pairs, np.arange(len(words), dtype=np.uint64), shared)
    for h in [0, *kinds.tolist()]:
        history = np.full(len(kinds), h, dtype=np.uint64)
        both = toxicity.mix(history * np.uint64(0x9E3779B97F4A7C15) + kinds)
        full, lower = model.log_p(kinds, history, both, shared.get(kinds, 0))
        assert np.exp(full).sum() == pytest.approx(1, abs=1e-5) and np.exp(lower).sum() == pytest.approx(1, abs=1e-5)


def test_models_against_a_recount(spark):
    """Both classes' probabilities from plain dictionaries of words, and a repeated id that trains once."""
    from collections import Counter, defaultdict

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.join(labels.select("doc_id", "toxic"), "doc_id").where("toxic is not null and text is not null").orderBy("doc_id").collect()}
    chosen = [r for r in rows.values() if r.toxic][:25] + [r for r in rows.values() if not r.toxic][:25]
    column = pa.array([r.text for r in chosen], pa.large_string())
    words, first = toxicity.letter_words(column)
    flags = np.array([r.toxic == 1 for r in chosen])
    model = toxicity.fit(column, flags, np.ones(len(chosen), dtype=np.int64), np.ones(len(chosen)))
    texts = [words[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    grams = [[((t[i - 2] if i > 1 else None, t[i - 1] if i else 0), w, i > 0) for i, w in enumerate(t)] for t in texts]
    seen, kept = set(), []
    for g in grams:
        own = {(h, w) for h, w, _ in g}
        kept.append(not own or len(own & seen) < toxicity.COPIED * len(own))
        seen |= own
    cut = lambda n: toxicity.DISCOUNTS[min(n, 3) - 1]
    every = {(h[1], w) for g, k in zip(grams, kept, strict=True) if k for h, w, _ in g}
    times = {w: min(n, toxicity.SHARED_CUT) for w, n in Counter(w for _, w in every).items()}
    shared = {w: n / sum(times.values()) * (1 - 1e-3) + toxicity.UNKNOWN for w, n in times.items()}
    for toxic, fitted in ((True, model.toxic), (False, model.ordinary)):
        triples = {(h, w) for g, k, f in zip(grams, kept, flags, strict=True) if k and f == toxic for h, w, _ in g}
        pairs = Counter((h[1], w) for h, w in triples)
        second = Counter(w for _, w in pairs)
        of = defaultdict(list)
        for (h, _), n in pairs.items():
            of[h].append(n)
        rest0 = sum(cut(n) for n in second.values()) / len(pairs)

        def lower(w, second=second, rest0=rest0, total=len(pairs)):
            own = (second[w] - cut(second[w])) / total if w in second else 0.0
            return own + rest0 * shared.get(w, toxicity.UNKNOWN)

        probe = [(h[1], w) for g in grams[:10] for h, w, _ in g] + [(1, 2), (grams[0][0][1], 5)]
        before, word = (np.array(x, dtype=np.uint64) for x in zip(*probe, strict=True))
        both = toxicity.mix(before * np.uint64(0x9E3779B97F4A7C15) + word)
        full, low = fitted.log_p(word, before, both, model.shared.get(word, toxicity.UNKNOWN))
        for (h, w), p, q in zip(probe, full, low, strict=True):
            assert math.exp(q) == pytest.approx(lower(w), rel=1e-3)
            total = sum(of[h]) if h in of else 0
            n = pairs.get((h, w), 0)
            own = max(n - cut(n), 0) / total if n else 0.0
            rest = sum(cut(x) for x in of[h]) / total if total else 1.0
            assert math.exp(p) == pytest.approx(own + rest * lower(w), rel=1e-3)
    many = docs.unionByName(docs.where("doc_id % 2 = 0")).unionByName(docs.where("doc_id % 2 = 0"))
    score = lambda d: {r.doc_id: r.score for r in toxicity.with_toxicity(docs, toxicity.train(d, labels)).select("doc_id", "score").collect()}
    assert score(many) == score(docs)


# --- quality


def test_quality_keeps_good_and_rejects_junk(spark):
    rows = quality.op5_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.99 and sum(r.kept for r in bad) / len(bad) < 0.1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_quality_rejects_junk_at_every_size(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet") for name in ("documents", "labels"))
    out = quality.resampled(docs, labels).select("doc_id", "kept").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in out if r.quality == 1], [r.kept for r in out if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.05
    # good documents that the target hasn't seen
    seen = labels.where("quality = 0 or doc_id % 2 = 0")
    held = [r.kept for r in quality.resampled(docs, seen).select("doc_id", "kept").join(labels.where("quality = 1 and doc_id % 2 = 1"), "doc_id").collect()]
    assert sum(held) / len(held) > 0.95


def test_quality_weighs_long_and_short_junk_alike(spark):
    docs = [(i, f"good words of a target {i}") for i in range(200)] + [(1000 + n, "bad junk " * n) for n in range(2, 100)]
    labels = [(i, 1) for i in range(0, 200, 2)] + [(1000 + n, 0) for n in range(2, 100, 3)]
    out = quality.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in out)
    few = quality.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), k=150).where("doc_id >= 1000 and kept").count()
    assert few == 0


def test_quality_of_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(9, 1, 0), (10, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    corpus.saved(spark, corpus.clashing(corpus.docs(spark)), tmp_path)
    rows = quality.op5_quality(spark, corpus.saved(spark, labels, tmp_path, "labels")).collect()
    assert len(rows) == len(corpus.rows()) and all(r.log_weight is not None for r in rows)
    corpus.saved(spark, corpus.docs(spark, True), tmp_path)
    assert quality.op5_quality(spark, str(tmp_path)).count() == 0


def test_gumbel_top_k_takes_k_by_weight(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.resampled(docs, labels, k=300).select("doc_id", "log_weight", "key", "kept").collect()
    assert sum(r.kept for r in out) == 300
    assert min(r.key for r in out if r.kept) >= max(r.key for r in out if not r.kept)
    again = quality.resampled(docs.repartition(7), labels, k=300).where("kept").select("doc_id").collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in out if r.kept}


def test_quality_against_a_recount(spark):
    """Weights and keys from plain dictionaries of tokens, and a sample that is no threshold on the weight."""
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = {r.doc_id: r for r in quality.resampled(docs, labels).drop("text").collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    buckets = {}

    def ngrams(text):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", (text or "").encode())
        found = [(t,) for t in tokens]
        for i in range(1, len(tokens)):
            again = tokens[i] in tokens[max(0, i - 2) : i] and re.match(rb"[0-9A-Za-z\x80-\xff]", tokens[i])
            found.append("again" if again else (tokens[i - 1], tokens[i]))
        return found

    def bucket(gram):
        if gram not in buckets:
            if gram == "again":
                buckets[gram] = 0
            else:
                hashes = [quality.word_hashes(np.frombuffer(t, dtype=np.uint8), np.array([0]), np.array([len(t)])) for t in gram]
                both = hashes[0] if len(gram) == 1 else quality.mix(hashes[0] * np.uint64(0x9E3779B97F4A7C15) + hashes[1])
                buckets[gram] = int(both[0] % np.uint64(quality.BUCKETS))
        return buckets[gram]

    rows = docs.collect()
    grams = {r.doc_id: Counter(map(bucket, ngrams(r.text))) for r in rows}
    raw, target = Counter(), Counter()
    for i, c in grams.items():
        raw.update(c)
        if i in good:
            target.update(c)
    total, seen = sum(raw.values()) + quality.BUCKETS, sum(target.values())
    for i, c in grams.items():
        weight = sum(n * math.log((target[b] + seen * (raw[b] + 1) / total) / (2 * seen) * total / (raw[b] + 1)) for b, n in c.items())
        assert out[i].log_weight == pytest.approx(weight, abs=1e-4)
        mean = weight / max(sum(c.values()), 1)
        assert out[i].mean_weight == pytest.approx(mean, abs=1e-6)
    noise = [r.key - quality.LENGTH * r.mean_weight for r in out.values()]
    assert abs(np.mean(noise) - 0.5772) < 0.15 and abs(np.std(noise) - math.pi / math.sqrt(6)) < 0.15
    kept = sorted((r.mean_weight, r.kept) for r in out.values())
    assert sum(k for _, k in kept) < len(kept) and [k for _, k in kept] != sorted(k for _, k in kept)  # noise has decided some
    chance = quality._taken(np.array([0.0, 0.1, -0.1]), 0.0, 1.0)
    assert chance == pytest.approx([1 - math.exp(-1), 1 - math.exp(-math.exp(6.4)), 1 - math.exp(-math.exp(-6.4))])


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), 1e9 * rng.random(), 5.0, -3.0]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 77, 250, 499):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "x", 500) == -math.inf and quality.kth_largest(df, "x", 0) == math.inf
    assert quality.kth_largest(df.where("x = 5"), "x", 3) == 5.0


# --- chat


def test_chat_facts(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "</s>[INST] [[INST]] \\ <s>"), (1, 2, "assistant", "a\\</s>"), (1, 3, "assistant", None), (2, None, None, "x"), (2, 1, "[INST]x", ""), (None, 0, "assistant", "né🙂"), (3, 0, "user", "u")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"t{i} <") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: r for r in chat_format.op8_chat_format(spark, corpus.saved(spark, corpus.clashing(df), tmp_path, "conversations")).collect()}
    rows += chat_format.FORGED
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t for *_, role, t in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for *_, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat_format.escaped(a)) + len(chat_format.escaped(b)) + 20 for *_, a, b in turns)
    assert chat_format.conversation_facts(chat_format.formatted(df.limit(0))).count() == 0


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    text, found = chat_format.spans(turns)
    assert [text[a:b] for *_, a, b in found] == ["a", "b", "c"] and found[0][0] == 0 and found[-1][1] == len(text)
    counted = lambda ts: f"{len(ts)} turns: " + "".join(t for _, t in ts)
    last_only = lambda ts: "".join(f"<{r}>{t}" if i == len(ts) - 1 else f"<{r}>" for i, (r, t) in enumerate(ts))
    for bad in (counted, last_only):
        with pytest.raises(chat_format.RewritesHistory):
            chat_format.spans(turns, bad)
    with pytest.raises(chat_format.RewritesHistory):
        chat_format.spans(turns, lambda ts: "".join(r for r, _ in ts))


def test_long_conversations_are_rendered_as_the_template_does(spark):
    size = chat_format.SEGMENT
    turns = {1: size, 2: size + 1, 3: 3 * size + 5, 4: 1}
    said = {c: [("assistant" if i % 3 else "user", f"{c}.{i}") for i in range(n)] for c, n in turns.items()}
    rows = [(c, i, role, text) for c in said for i, (role, text) in enumerate(said[c])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    headed = lambda ts: "<bos>" + "".join(f"<{r}>{t}" for r, t in ts)
    numbered = lambda ts: "".join(f"{i}{r}:{t};" for i, (r, t) in enumerate(ts))
    changes = lambda ts: "".join(("|" if i and ts[i - 1][0] != r else "") + f"({t})" for i, (r, t) in enumerate(ts))
    for template in (headed, numbered, changes, chat_format.TEMPLATE):
        got = chat_format.formatted(df, template).orderBy("conv_id", "segment").collect()
        for c in said:
            own = [r for r in got if r.conv_id == c]
            assert [r.segment for r in own] == list(range(-(-turns[c] // size)))
            assert "".join(r.formatted for r in own) == template(said[c])
            assert [r.formatted[a:b] for r in own for a, b in zip(r["mask"][0::2], r["mask"][1::2], strict=True)] == [t for r, t in said[c] if r == "assistant"]
    late = lambda ts: "".join(f"<{r}>{t}" for r, t in ts[-size - 3 :])  # noqa: E731  forgets the oldest turns
    across = lambda ts: "".join(("+" if i == size - 1 and len(ts) > size else "") + f"{r}:{t}" for i, (r, t) in enumerate(ts))
    for bad in (late, across):
        with pytest.raises(Exception, match="RewritesHistory"):
            chat_format.formatted(df, bad).collect()
    for context in (headed, numbered, across):
        with pytest.raises(Exception, match="RewritesHistory"):
            chat_format.formatted(df, context, by_turn=True).collect()


def test_escapes_are_reversible():
    rng = random.Random(6)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/", "s>", "[", "INST]", "x", "\n", "<<SYS>>", "<</SYS>>"]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        e = chat_format.escaped(t)
        assert chat_format.unescaped(e) == t and not any(c in e for c in chat_format.CONTROL)
        assert chat_format.parsed(chat_format.TEMPLATE([(t, t), ("r", t)])) == [(t, t), ("r", t)]


# --- pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_without_dropout_are_the_library_s(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = piece_coding.encode_pieces(corpus.clashing(corpus.docs(spark)), MODEL, dropout=0.0).collect()
    assert all(list(r.ids) == library.encode(r.text or "") and r.n_tokens == len(r.ids) for r in out)


def test_dropout_varies_and_decodes(spark, tmp_path):
    docs = corpus.docs(spark).unionByName(spark.createDataFrame([(77, "the mark ▁ itself ▁▁", None, None, 0)], corpus.SCHEMA))
    out = piece_coding.encode_pieces(docs, MODEL, dropout=0.3)
    back = piece_coding.decode_pieces(out.withColumnRenamed("text", "was"), MODEL).collect()
    assert all(r.text == (r.was or "") for r in back)
    assert len({tuple(r.ids) for r in out.where("doc_id in (9, 10)").collect()}) == 2  # equal texts, other ids
    rows = piece_coding.op10_piece_coding(spark, corpus.saved(spark, corpus.clashing(docs), tmp_path)).collect()
    assert all(r.lossless for r in rows) and len(rows) == docs.count() and sum(r.n_tokens for r in rows) > sum(r.n_plain for r in rows)
    assert piece_coding.encode_pieces(docs.limit(0), MODEL).count() == 0


def test_agendas_side_by_side_equal_the_heap(monkeypatch):
    model = piece_coding._model(MODEL)
    rng = random.Random(3)
    words = sorted({(" " * rng.randrange(3) + "".join(rng.choice("abcdeéßñ你 ".strip()) for _ in range(rng.randrange(1, 30)))).encode() for _ in range(300)})
    for dropout in (0.0, 0.2, 1.0):
        monkeypatch.setattr(piece_coding, "LONG", 256)
        a = piece_coding.segment(model, words, np.arange(len(words)) % 4, dropout, 5)
        monkeypatch.setattr(piece_coding, "LONG", 0)
        b = piece_coding.segment(model, words, np.arange(len(words)) % 4, dropout, 5)
        assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_every_occurrence_of_a_word_draws_its_own_skips():
    model = piece_coding._model(MODEL)
    n = 4000
    of = piece_coding.segment(model, [b" of"], np.zeros(1), 0.0, 5)[0].tolist()
    ids, ends, plain = piece_coding.encode_block(np.arange(4), pa.array([" ".join(["of"] * n), *[" ".join(["understanding"] * n)] * 3]), MODEL, 0.1, 5)
    assert len(of) == 1 and plain[0] == n
    raw = ids.tolist()
    texts = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    # " of" comes whole from two merges (0.9 * 0.9) or, where the first is skipped, from two others (0.1 * 0.9 * 0.9)
    assert texts[0].count(of[0]) / n == pytest.approx(0.891, abs=0.02)
    seen = set()
    for t in texts[1:]:
        joined = [model.raw[model.at[i] : model.at[i] + model.size[i]].tobytes() for i in t]
        word: list[bytes] = []
        for x in joined:
            if x.startswith(b" ") and word:
                seen.add(tuple(word))
                word = []
            word.append(x)
    assert len(seen) > 12


def test_shared_agendas_equal_agendas_of_each_occurrence(monkeypatch):
    model = piece_coding._model(MODEL)
    rng = np.random.default_rng(4)
    words = [" of", " understanding", " 你é", "x" * 40, " the", " a", " " * 9, " counter-revolutionaries"]
    at = rng.integers(0, len(words), 3000)
    draws = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    for dropout in (0.1, 0.5, 1.0):
        ids, before, _ = piece_coding.segmentations(model, [w.encode() for w in words], at, draws, dropout, 7)
        want, ends = piece_coding.segment(model, [words[i].encode() for i in at], draws, dropout, 7)
        assert (ids == want).all() and (before == ends).all()
        monkeypatch.setattr(piece_coding, "LONG", 0)
        want, ends = piece_coding.segment(model, [words[i].encode() for i in at], draws, dropout, 7)
        monkeypatch.setattr(piece_coding, "LONG", 256)
        assert (ids == want).all() and (before == ends).all()


# --- pipeline


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality classifier", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    (_, tox), (_, good), (_, near), (_, mix), (_, pieces) = corpus_pipeline.STAGES
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    a = tox(spark, docs, SF).cache()
    want = ids(toxicity.op4_toxicity(spark, SF).where("predicted = 0"))
    assert ids(a) == want and a.columns == docs.columns
    b = good(spark, a, SF).cache()
    assert b.columns == docs.columns and ids(b) <= want
    clean = [k for k, r in labels.items() if r.quality == 1 and k in want]
    assert len(set(clean) & ids(b)) > 0.98 * len(clean)
    c = near(spark, b, SF).cache()
    found = jaccard_join.jaccard_components(b).collect()
    assert ids(c) == {r.component_id for r in found} and c.count() == len(ids(c)) and c.columns == docs.columns
    # the same by comparing all pairs of word sets: one of each group, and those without words
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))) else set() for r in b.collect()}
    holders, up = {}, {k: k for k in sets}
    for k, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(k)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, own in sets.items():
        for o in {o for s in own for o in holders[s] if o < k}:
            both = len(own & sets[o])
            if 100 * both >= 75 * (len(own) + len(sets[o]) - both):
                x, y = sorted((top(k), top(o)))
                up[y] = x
    assert ids(c) == {k for k, own in sets.items() if not own or top(k) == k}
    d = mix(spark, c, SF).cache()
    counts = {r.doc_id: r.copies for r in mixing.mix_counts(c).collect()}
    got = {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in counts.items() if n} and d.columns == docs.columns
    e = pieces(spark, d, SF)
    assert e.count() == d.count() and e.where("not lossless").count() == 0
    # the library decodes the pieces to the documents
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in e.collect():
        if "\u2581" not in (texts[r.doc_id] or ""):
            assert library.decode(r.ids) == (texts[r.doc_id] or "")


def test_pieces_of_documents_with_text_ids(spark):
    df = spark.createDataFrame([("a", "some words here"), ("b", "some words here"), (None, None)], "doc_id string, text string")
    out = piece_coding.coded_and_checked(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert all(r.lossless for r in out) and [r.n_tokens > 0 for r in out] == [True, True, False]


def test_copies_are_removed_by_row(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(3, a), (5, a + " more"), (5, b), (5, c), (5, c), (7, b), (None, c), (None, "only once here"), (None, "only once here"), (8, ""), (8, ""), (None, None), (None, None), (9, "only\nonce here")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], corpus.SCHEMA).repartition(5)
    got = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()))
    assert got == sorted([(3, a), (5, b), (5, c), (9, "only\nonce here"), (8, ""), (8, ""), (0, ""), (0, "")])
    lone = spark.createDataFrame([(None, t, "en", "s", 0) for t in (a, a, b)], corpus.SCHEMA)
    assert sorted(r.text for r in corpus_pipeline.one_of_each_group(spark, lone, SF).collect()) == [a, b]


def test_pipeline_stages_take_odd_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    sf = corpus.saved(spark, labels, tmp_path, "labels")
    odd = spark.createDataFrame(corpus.rows(), corpus.SCHEMA).withColumn("_id", F.lit(1)).withColumn("key", F.lit(2))
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            out.collect()
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == docs.columns
