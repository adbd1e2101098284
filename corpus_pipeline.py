"""A corpus pipeline of five stages over ``documents``, each a training-data operator applied to all that the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared
folder and reads it back as the next stage's docs. All but the last return the columns of documents. Rows that the
filtering stages keep are unchanged, in no particular order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernstore.llm import jaccard_join, mixing, piece_coding, quality, toxicity
from fernstore.llm.shared import forget, shared_path, table, temporary, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict toxic."""
    scored = toxicity.with_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 0").select(*docs.columns)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards labelled good ones keeps."""
    return quality.resampled(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-copy component, that with the smallest id (none is the largest), and every row without words.

    Rows are told apart by a hash of id and text, so rows with equal ids or without one are documents of their own;
    rows equal in both are copies, of which one stays.
    """
    row = F.xxhash64("doc_id", "text")
    found = jaccard_join.jaccard_components(docs.select(row.alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("_row"))
    found = written(found.agg(F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("times"), F.min("component_id").alias("component")), "row_components")
    ids = docs.select(row.alias("_key"), "doc_id").groupBy("_key").agg(F.min("doc_id").alias("_id"))
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"))).getField("_row")
    stay = found.join(ids, found["_row"] == F.col("_key")).groupBy("component").agg(first.alias("_stay")).select("_stay")
    copies = found.join(stay, found["_row"] == F.col("_stay"), "left_anti").select(F.col("_row").alias("_copy"))
    left = docs.withColumn("_row", row).join(copies, F.col("_row") == F.col("_copy"), "left_anti")
    repeated = found.where("times > 1 and n > 0").select(F.col("_row").alias("_twice"))
    rows = left.join(repeated, F.col("_row") == F.col("_twice"), "left")
    again = rows.where("_twice is not null").select(*docs.columns, F.row_number().over(Window.partitionBy("_twice").orderBy("text")).alias("_n")).where("_n = 1").select(*docs.columns)
    return rows.where("_twice is null").select(*docs.columns).unionByName(again)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix to the weights 5, 2, 1 takes them."""
    return mixing.mixed(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, its piece ids under merge-dropout, their number, and whether they decode to the text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_coding.coded_and_checked(docs, model)


STAGES = [
    ("toxicity", without_toxic),
    ("quality classifier", of_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mixed_sources),
    ("SentencePiece encoding and decoding", as_pieces),
]

#: The first stages' models can't be expressed in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. What a stage wrote for itself, and its input, is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, path = docs, shared_path(spark, f"pipeline_{k}")
        with temporary(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
