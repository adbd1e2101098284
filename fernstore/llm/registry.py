"""The queries of this package by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernstore.llm import chat_format, jaccard_join, media_columns, mixing, piece_coding, quality, token_counts, token_files, topk_search, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_token_files": token_files.op2_token_files,
    "op3_topk_search": topk_search.op3_topk_search,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality": quality.op5_quality,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_media_columns": media_columns.op7_media_columns,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_piece_coding": piece_coding.op10_piece_coding,
}

SQL: dict[str, str] = {"op1_mixing": mixing.SQL, "op3_topk_search": topk_search.SQL, "op9_jaccard_join": jaccard_join.SQL}
