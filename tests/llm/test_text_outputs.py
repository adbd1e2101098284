import hashlib
import json
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm import corpus
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fernstore.llm import media_columns, mixing, textblocks, token_counts, token_files

SF = "/root/testdata/sf0.001"


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))


@pytest.mark.parametrize("path", [None, SF])
def test_token_files_against_the_library(spark, tmp_path, path):
    sf = path or corpus.saved(spark, corpus.clashing(corpus.docs(spark)), tmp_path)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for k, t in pairs(spark.read.parquet(f"{sf}/documents.parquet")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_files.op2_token_files(spark, sf).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == want


def scanned(df):
    """The rows that the scan of an executed query gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if "Adaptive" in plan.getClass().getName() else plan).collectLeaves()
    return int(leaves.apply(0).metrics().apply("numOutputRows").value())


def test_token_files_are_read_by_stripe_and_pruned_by_id(spark, tmp_path, monkeypatch):
    import glob

    from pyarrow import orc

    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(int(2 * i), " ".join(map(str, rng.integers(0, 10**6, 30)))) for i in range(20000)], "doc_id long, text string")
    monkeypatch.setattr(token_files, "STRIPE_BYTES", 1 << 17)
    path = f"{tmp_path}/tokens"
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(docs.coalesce(1).sortWithinPartitions("doc_id"), path, tokenizer)
    files = sorted(glob.glob(f"{path}/*.orc"))
    stripes = 0
    library = Tokenizer.from_file(tokenizer)
    for f in files:
        one = orc.ORCFile(f)
        assert one.row_index_stride == token_files.ROW_STRIDE and one.compression == "ZSTD"
        stripes += one.nstripes
        # any stripe can be read alone
        last = one.read_stripe(one.nstripes - 1, ["doc_id", "ids"])
        key, ids = last.column("doc_id")[0].as_py(), last.column("ids")[0].as_py()
        text = docs.where(F.col("doc_id") == key).first().text
        assert ids == [*library.encode(text, add_special_tokens=False).ids, 2]
    assert stripes > len(files)
    found = token_files.read_tokens(spark, path, [4000, 30000])
    assert sorted(r.doc_id for r in found.collect()) == [4000, 30000] and scanned(found) <= 2 * token_files.ROW_STRIDE
    # an id between others' lies within the statistics; only the Bloom filter can tell that it isn't there
    assert scanned(token_files.read_tokens(spark, path, [4001])) == 0
    assert token_files.read_tokens(spark, path, spark.createDataFrame([(2,), (2,), (7,)], "doc_id long")).count() == 1


def test_token_files_empty(spark, tmp_path):
    assert token_files.op2_token_files(spark, corpus.saved(spark, corpus.docs(spark, True), tmp_path)).count() == 0


@pytest.mark.parametrize("path", [None, SF])
def test_token_counts_against_the_library(spark, tmp_path, path):
    sf = path or corpus.saved(spark, corpus.clashing(corpus.docs(spark)), tmp_path)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((k is None, k or 0, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for k, t in pairs(spark.read.parquet(f"{sf}/documents.parquet")))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op6_token_counts(spark, sf).collect())
    assert got == want


def test_token_counts_keep_columns_and_take_empty_tables(spark):
    out = token_counts.with_token_counts(corpus.clashing(corpus.docs(spark, True)), public_tokenizers.path("word_bpe_49k.json"))
    assert out.count() == 0 and {"lang", "n_tokens", "start"} <= set(out.columns)


def test_merging_takes_the_lowest_rank_first():
    merges = {(0, 1): (1, 3), (1, 2): (0, 4), (3, 2): (2, 5)}
    assert token_counts.count_after_merges([0, 1, 2], merges) == 2  # a bc
    assert token_counts.count_after_merges([0, 1, 0, 1, 2], merges) == 3  # ab a bc


def brute_hash(payload):
    rows = [list(payload[i : i + 64]) for i in range(0, len(payload), 64)]

    def cell(values, i):
        a, b = i * len(values) // 32, (i + 1) * len(values) // 32
        return values[min(a, len(values) - 1) : max(b, a + 1)] if len(values) >= 32 else [values[min(a, len(values) - 1)]]

    small = []
    for i in range(32):
        band = cell(rows, i)
        line = [sum(r[x] for r in band) / len(band) for x in range(64)]
        small.append([sum(cell(line, j)) / len(cell(line, j)) for j in range(32)])
    cos = [[np.cos(np.pi * u * (2 * x + 1) / 64) for x in range(32)] for u in range(8)]
    low = [round(sum(cos[u][i] * cos[v][j] * small[i][j] for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = float(np.median(low[1:]))
    return bytes(sum((low[8 * i + j] > middle) << (7 - j) for j in range(8)) for i in range(8))


@pytest.mark.parametrize("path", [None, SF])
def test_media_facts(spark, tmp_path, path):
    sf = path or corpus.saved(spark, corpus.clashing(corpus.docs(spark)), tmp_path)
    want = []
    for k, t in pairs(spark.read.parquet(f"{sf}/documents.parquet")):
        raw = (t or "").encode()
        full = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        want.append((k is None, k or 0, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    rows = media_columns.op7_media_columns(spark, sf).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:5]) for r in rows) == sorted(want)
    assert all(len(r.feature) == 16 and bytes(r.hash).hex() == r.feature for r in rows)
    by = {}
    for r in rows:
        assert by.setdefault(r.payload_sha256, r[5:8]) == r[5:8]
    # the feature by sums over cells and cosines, one at a time
    texts = {hashlib.sha256(media_columns.padded((t or "").encode())).hexdigest(): media_columns.padded((t or "").encode()) for _, t in pairs(spark.read.parquet(f"{sf}/documents.parquet"))}
    for digest in sorted(texts)[:12]:
        assert by[digest][2] == brute_hash(texts[digest]).hex()


def test_png_round_trip_with_every_filter():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (40, 64), dtype=np.uint8)
    assert (media_columns.png_decode(media_columns.png_encode(pixels.tobytes()))[0] == pixels).all()
    assert media_columns.png_decode(media_columns.png_encode(b""))[0].shape == (1, 64)
    for kinds in ([0, 1, 2, 3, 4] * 8, [2] * 40, [1] * 40, [4] * 40, [3, 2] * 20):
        rows = np.zeros((40, 65), dtype=np.uint8)
        rows[:, 0] = kinds
        p = pixels.astype(int)
        for y in range(40):
            for x in range(64):
                a = p[y, x - 1] if x else 0
                b = p[y - 1, x] if y else 0
                c = p[y - 1, x - 1] if x and y else 0
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                rows[y, x + 1] = (p[y, x] - [0, a, b, (a + b) // 2, near][kinds[y]]) % 256
        assert (media_columns.unfilter(rows) == pixels).all()


def test_png_refuses_broken_bytes():
    png = bytearray(media_columns.png_encode(b"hello" * 50))
    png[60] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media_columns.png_decode(bytes(png))
    with pytest.raises(ValueError):
        media_columns.png_decode(b"GIF89a" + bytes(png[6:]))
    with pytest.raises(ValueError, match="inside"):
        media_columns.png_decode(bytes(media_columns.png_encode(b"x"))[:-5])


def test_targets_reach_the_total_and_stop_at_three_times(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 500, "d": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    left, target, open_ = sum(sizes.values()), {}, set(sizes)
    while True:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / w > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * left / w for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    assert got == pytest.approx(target) and sum(got.values()) == pytest.approx(1515)


def test_mix_of_odd_rows(spark, tmp_path):
    rows = mixing.mix_counts(corpus.clashing(corpus.docs(spark))).collect()
    assert len(rows) == len(corpus.rows())
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in rows)
    assert all(r.copies == 0 for r in rows if r["size"] == 0)
    assert mixing.mix_counts(corpus.docs(spark, True)).count() == 0


def test_mix_comes_near_its_targets_and_repeats_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = mixing.mix_counts(docs).cache()
    by = counts.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.want) <= 2 * r.m for r in by)
    assert mixing.mixed(docs).count() == counts.agg(F.sum("copies")).first()[0]
    assert mixing.mixed(docs).columns == docs.columns


def test_mix_takes_rows_that_share_an_id_each_by_itself(spark):
    rows = [(k, " ".join(["w"] * (5 + k % 7)) + f" {k}", f"src{k % 3}", k) for k in range(300)]
    # one id in several sources and texts, rows without an id, rows equal in id, source and text
    rows += [(7, f"other text {k} of this id", f"src{k % 3}", k) for k in range(60)] + [(None, f"no id {k}", "src1", k) for k in range(60)] + [(9, "copies of a row", "src0", k) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    one = docs.coalesce(1)
    row = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "source", "text")
    want = {r.row: r.n for r in mixing.mix_counts(one, row=row).groupBy("row").agg(F.sum("copies").alias("n")).collect() if r.n}
    got = mixing.mixed(one).groupBy(row.alias("row")).count().collect()
    assert {r.row: r["count"] for r in got} == want
    # none of the rows that are equal in id, source and text gets more than one copy more than another
    each = {r.n: r["count"] for r in mixing.mixed(one).where("doc_id = 9 and text = 'copies of a row'").groupBy("n").count().collect()}
    times = [each.get(k, 0) for k in range(200)]
    assert max(times) - min(times) <= 1
    # over several partitions their copies may differ by one for each
    spread = mixing.mixed(docs.repartition(4)).where("text = 'copies of a row'").count()
    assert abs(spread - sum(times)) <= 4
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mix_sends_each_text_once(spark, monkeypatch):
    rows = [(k, f"text {k} of some words", f"src{k % 3}", k) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(3)
    for k, times in enumerate((2, 2, 3, 30)):
        rows += [(1000 + k, f"equal rows {k}", "src0", 1000 * k + i) for i in range(times)]
    repeats = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(3, "n")

    def sent(df):
        # rows of texts that pass an exchange, without broadcasts
        plan, n = df._jdf.queryExecution().executedPlan(), 0
        df._jdf.queryExecution().toRdd().count()
        nodes = [plan]
        while nodes:
            node = nodes.pop()
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
            if node.nodeName() == "Exchange" and "text#" in node.output().toString() and "_mix_key" in node.toString().split("\n")[0]:
                n += node.metrics().apply("shuffleRecordsWritten").value()
        return n

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sent(mixing.mixed(docs)) == 300
        assert sent(mixing.mixed(repeats)) <= len(rows)
        want = sorted(mixing.mixed(repeats).collect())
        counts = mixing.mix_counts(repeats)
        assert abs(len(want) - counts.agg(F.sum("copies")).first()[0]) <= 3 * 4
        # more rows that have equals than are broadcast: those with most of them stand apart, the others don't
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
        few = mixing.mixed(repeats)
        assert sent(few) <= len(rows) and sorted(few.collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_words_and_shingles_against_brute_force():
    texts = [t or "" for t in corpus.TEXTS]
    import pyarrow as pa

    data, offsets = textblocks.utf8(pa.array(corpus.TEXTS))
    starts, ends, first = textblocks.words(data, offsets)
    import re

    want = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    raw = data.tobytes()
    got = [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == want
    hashes = textblocks.word_hashes(data, starts, ends)
    flat = [w for ws in want for w in ws]
    assert len(set(hashes.tolist())) == len(set(flat)) == len({(h, w) for h, w in zip(hashes.tolist(), flat, strict=True)})
    shingles, at = textblocks.shingle_hashes(hashes, first)
    sets = [{tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set() for ws in want]
    assert [len(set(shingles[a:b].tolist())) for a, b in zip(at[:-1], at[1:], strict=True)] == [len(s) for s in sets]


def test_png_is_readable_by_its_own_rules():
    png = media_columns.png_encode(b"abc")
    assert png[12:16] == b"IHDR" and struct.unpack(">II", png[16:24]) == (64, 1)
    assert json.dumps(media_columns.png_decode(png)[1]) == "3"
