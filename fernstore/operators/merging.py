"""Keyed writes over typed tables: creation, merge, upsert, increment, uniqueness, set operations of index keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def existing(staged: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Staged rows whose keys exist already."""
    return staged.join(current.select(key), key, "left_semi")


def creatable(staged: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Staged rows whose keys are new."""
    return staged.join(current.select(key), key, "left_anti")


def modified(current: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Current rows with the patch's columns where the patch has the key; its nulls are stored. Keys must be unique in the patch."""
    own = [c for c in patch.columns if c != key]
    marked = patch.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in own))
    joined = current.join(marked, current[key] == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    return joined.select(*(F.when(hit, F.col(f"_new_{c}")).otherwise(current[c]).alias(c) if c in own else current[c] for c in current.columns))


def upserted(current: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """``modified``, and rows of the patch with new keys; columns that these lack are null."""
    new = creatable(patch, current, key)
    return modified(current, patch, key).unionByName(new, allowMissingColumns=True).select(*current.columns)


def incremented(current: DataFrame, field: str, by: int | float, where: Column) -> DataFrame:
    """``field + by`` in the chosen rows; whole numbers stay whole. Null fields stay null."""
    return current.withColumn(field, F.when(where, F.col(field) + F.lit(by)).otherwise(F.col(field)))


def repeated(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Values that more than one row has, with their number: what a unique index forbids. Nulls don't clash."""
    some = df
    for f in fields:
        some = some.where(F.col(f).isNotNull())
    return some.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def index_changes(before: Column, after: Column) -> tuple[Column, Column]:
    """Index keys that an update of an array field removes and adds."""
    return F.array_except(before, after), F.array_except(after, before)
