"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (null last) take the weights 5, 2, 1 in turn and share all words in
proportion. A target never exceeds ``MAX_REPEAT`` times its source's words; the excess is shared again by weight
among the rest. That is the level L at which the sum of min(3 x size, L x weight) reaches the total, found from
running sums over the sources in order of size / weight, in whole numbers.

Sampling: each document of a source expects target / size copies, held in units of 2**-24. Within a source the
documents stand in order of size, then of the first 32 bits of the MD5 of their id (of the text, where there is none, so that such rows stand apart); their expected copies are summed up
along that order from a random offset that depends on the seed and the source, and a document is taken once for
every whole number its interval crosses. Copies are thus the expectation rounded up or down, never above
``MAX_REPEAT``, and the words taken differ from the target by about the longest document at most.

Scale: the text is read once, to count words. The order within a source is built from counts per (source, size,
cell), where a cell holds about ``CELL_ROWS`` rows of one source and size, so that neither a hot source nor a
common size meets in one task. Reruns agree.

Edge cases: null or empty texts have size 0 and are never taken; a source without words has target 0; rows with
equal ids are ordered by size, rows that are equal in both are interchangeable; an empty table gives an empty
result; other columns are ignored by ``mix_counts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernstore.llm.shared import table, written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
UNIT = 1 << 24  #: shifted out again below
CELL_ROWS = 100_000
SEED = 17
#: Sources whose statistics are sent to every task; beyond that they are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Hashes of rows that have equals which the mix sends to every task.
BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source: source_size, n (documents) and target. ``sizes`` has source and size."""
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    # in order of size / weight, the sources before this one are full when this one's share is found
    order = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    by = by.select(
        "*",
        (F.sum("source_size").over(everything) - max_repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(rest).alias("weights_left"),
        F.row_number().over(order).alias("turn"),
    )
    open_ = max_repeat * F.col("source_size") * F.col("weights_left") >= F.col("left") * F.col("weight")
    by = by.withColumn("level_turn", F.min(F.when(open_, F.col("turn"))).over(everything))
    # the first source that isn't full fixes the level for itself and all after it
    at = F.struct("left", "weights_left")
    by = by.withColumn("level", F.min(F.when(F.col("turn") == F.col("level_turn"), at)).over(everything))
    share = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.weights_left").cast("double")
    full = (max_repeat * F.col("source_size")).cast("double")
    return by.select("source", "source_size", "n", F.when(F.col("turn") < F.col("level_turn"), full).otherwise(F.coalesce(share, F.lit(0.0))).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix_counts(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED, row: Column | None = None) -> DataFrame:
    """Per document: key, size, source_size, target, copies (how often the mix takes it) and taken (words), and ``row`` of it if given."""
    spark = docs.sparkSession
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.col(text), F.lit(""))), 1, 8), 16, 10).cast("long")
    slim = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), h.alias("h"), *([] if row is None else [row.alias("row")]))
    slim = written(slim, "mix_sizes")
    targets = written(source_targets(slim, weights, max_repeat), "mix_targets")
    small = targets.count() <= BROADCAST_SOURCES

    def stats(df: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        names = [c for c in right.columns if c not in on]
        right = right.select(*(F.col(c).alias(f"_{c}") for c in on), *names)
        how = F.broadcast(right) if small and on == ["source"] else right
        cond = [_same(c, f"_{c}") for c in on]
        return df.join(how, cond, "left").drop(*(f"_{c}" for c in on))

    slim = stats(slim, targets, ["source"]).withColumn("cell", F.shiftright(F.col("h") * (F.floor(F.col("n") / CELL_ROWS) + 1), 32))
    cells = slim.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("rows"))
    # two levels: sizes within a source, cells within a size
    sizes = cells.groupBy("source", "size").agg(F.sum("rows").alias("size_rows"))
    up_to = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.select("source", "size", (F.sum("size_rows").over(up_to) - F.col("size_rows")).alias("size_base"))
    up_to = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("cell_base", F.sum("rows").over(up_to) - F.col("rows"))
    cells = stats(cells, sizes, ["source", "size"]).select("source", "size", "cell", (F.col("size_base") + F.col("cell_base")).alias("base"))
    ranked = slim.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("h", "key")).cast("long"))
    ranked = stats(ranked, cells, ["source", "size", "cell"])
    each = F.least(F.lit(max_repeat * UNIT).cast("long"), F.floor(F.col("target") / F.col("source_size") * UNIT))
    each = F.when(F.col("size") > 0, F.coalesce(each, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))), 1, 6), 16, 10).cast("long")
    at = (F.col("base") + F.col("rank")) * F.col("each") + offset
    out = ranked.withColumn("each", each).withColumn("copies", F.shiftright(at, 24) - F.shiftright(at - F.col("each"), 24))
    return out.select(F.col("key").alias(key), "size", "source_size", F.col("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"), *([] if row is None else ["row"]))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its document is taken, with the columns of ``docs``.

    Rows find their copies by a hash of key, source and text, so that rows with equal keys or without one are documents of
    their own. Rows equal in all three share their copies out among them: systematically again, within each partition
    of ``docs`` from an offset of its own, so that many of them don't meet in one task.

    No row's text is sent twice: rows that have equals are picked out by a broadcast of their hashes before the others are
    joined, and those with most of them if there are more than ``BROADCAST_ROWS`` such hashes.
    """
    row = F.xxhash64(F.col(key).isNull(), F.col(key), F.col(source).isNull(), F.col(source).cast("string"), F.col(text))
    counts = mix_counts(docs, key, source, text, row=row, **options).groupBy(F.col("row").alias("_mix_row"))
    counts = written(counts.agg(F.sum("copies").alias("_mix_copies"), F.count(F.lit(1)).alias("_mix_times")).where("_mix_copies > 0"), "mix_copies")
    times = F.col("_mix_times")
    repeated, total = counts.where(times > 1).agg(F.count(F.lit(1)), F.sum(times)).first()
    # at most BROADCAST_ROWS hashes have so many rows each
    many = 2 if repeated <= BROADCAST_ROWS else total // BROADCAST_ROWS + 1
    named = docs.withColumns({"_mix_key": row, "_mix_part": F.spark_partition_id()})
    same = F.col("_mix_key") == F.col("_mix_row")
    others = [F.col(f.name) for f in docs.schema if f.name not in (key, source, text) and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]

    def shared_out(rows: DataFrame) -> DataFrame:
        part = Window.partitionBy("_mix_key", "_mix_part").orderBy(F.xxhash64(*others) if others else F.lit(0))
        rows = rows.withColumns({"_mix_at": F.row_number().over(part).cast("decimal(19,0)"), "_mix_offset": F.expr("pmod(xxhash64(_mix_key, _mix_part), _mix_times)")})
        upto = "(({} * _mix_copies + _mix_offset) div _mix_times)"
        return rows.select(*docs.columns, F.expr(f"{upto.format('_mix_at')} - {upto.format('(_mix_at - 1)')}").alias("_mix_n"))

    if not repeated:
        rows = named.join(counts, same).select(*docs.columns, F.col("_mix_copies").alias("_mix_n"))
    else:
        apart = counts.where(times >= many)
        rest = named.join(F.broadcast(apart.select("_mix_row")), same, "left_anti").join(counts.where(times < many), same)
        rest = rest.select(*docs.columns, F.col("_mix_copies").alias("_mix_n")) if many == 2 else shared_out(rest)
        rows = rest.unionByName(shared_out(named.join(F.broadcast(apart), same)))
    rows = rows.where("_mix_n > 0").withColumn("_mix_n", F.explode(F.sequence(F.lit(1), F.col("_mix_n").cast("int"))))
    return rows.select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_counts(docs).select(F.col("doc_id").cast("long"), "size", "source_size", "target", "taken", "copies")


SQL = f"""
with d as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
           ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
    from documents
), s as (
    select source, sum(size)::bigint as source_size,
           case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
    from d group by source
), o as (
    select *, row_number() over w as turn,
           (sum(source_size) over () - 3 * coalesce(sum(source_size) over (w rows between unbounded preceding and 1 preceding), 0))::bigint as rest,
           (sum(weight) over (w rows between current row and unbounded following))::bigint as weights
    from s window w as (order by source_size::double / weight, source nulls last)
), l as (
    select turn as level_turn, rest, weights from o where 3 * source_size * weights >= rest * weight order by turn limit 1
), t as (
    select o.source, o.source_size,
           case when o.turn < l.level_turn then (3 * o.source_size)::double
                else (o.weight * l.rest)::double / l.weights::double end as target
    from o, l
), r as (
    select d.doc_id, d.size, t.source_size, t.target,
           row_number() over (partition by d.source order by d.size, d.h, d.doc_id) as rank,
           case when d.size > 0 then least({MAX_REPEAT * UNIT}, floor(t.target / t.source_size * {UNIT})::bigint) else 0 end as each,
           ('0x' || substr(md5('{SEED}:' || coalesce(d.source, '')), 1, 6))::bigint as start
    from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       (((rank * each + start) >> 24) - (((rank - 1) * each + start) >> 24)) * size as taken,
       ((rank * each + start) >> 24) - (((rank - 1) * each + start) >> 24) as copies
from r
"""
