"""Sorting and limits. Ties are in key order; a sort with a limit plans as a top-k, never as a full sort."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nulls_last(field: str, direction: str = "asc") -> Column:
    """``sortBy``: rows without the field come last in either direction."""
    c = F.col(f"`{field}`")
    return c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last()


def nulls_least(field: str, direction: str = "asc") -> Column:
    """``orderBy``: null is smaller than any value."""
    c = F.col(f"`{field}`")
    return c.asc_nulls_first() if direction == "asc" else c.desc_nulls_last()


def is_mixed(df: DataFrame, field: str) -> bool:
    return isinstance(df.schema[field].dataType, T.VariantType)


def mixed_key(c: Column) -> Column:
    """What values of mixed types compare by: numbers, then texts, then booleans, then the rest as JSON; nothing is least."""
    kind = F.schema_of_variant(c)
    number = F.when(F.rlike(kind, F.lit(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")), F.try_variant_get(c, "$", "double"))
    text = F.when(kind == "STRING", F.try_variant_get(c, "$", "string"))
    rest = F.when(c.isNotNull() & (kind != "VOID") & number.isNull() & text.isNull() & (kind != "BOOLEAN"), F.to_json(c))
    rank = F.when(number.isNotNull(), 1).when(text.isNotNull(), 2).when(kind == "BOOLEAN", 3).when(rest.isNotNull(), 4).otherwise(0)
    flag = F.when(kind == "BOOLEAN", F.try_variant_get(c, "$", "boolean"))
    return F.struct(rank.alias("rank"), F.coalesce(number, F.lit(0.0)).alias("number"), F.coalesce(text, rest, F.lit("")).alias("text"), F.coalesce(flag, F.lit(False)).alias("flag"))


def mixed_literal(value: object) -> Column:
    """The same for a plain value."""
    rank = 0 if value is None else 3 if isinstance(value, bool) else 1 if isinstance(value, (int, float)) else 2 if isinstance(value, str) else 4
    text = value if rank == 2 else json.dumps(value, separators=(",", ":")) if rank == 4 else ""
    return F.struct(F.lit(rank).alias("rank"), F.lit(float(value) if rank == 1 else 0.0).alias("number"), F.lit(text).alias("text"), F.lit(value if rank == 3 else False).alias("flag"))


def sort_columns(df: DataFrame, field: str, direction: str = "asc", nulls_are_last: bool = True) -> list[Column]:
    """What to sort by for a field. Mixed types order as numbers, then texts, then booleans, and by value within each."""
    place = nulls_last if nulls_are_last else nulls_least
    if not is_mixed(df, field):
        return [place(field, direction)]
    c, down = mixed_key(F.col(f"`{field}`")), direction == "desc"
    nothing = (c["rank"] == 0).asc() if nulls_are_last else (c["rank"] == 0).asc() if down else (c["rank"] == 0).desc()
    return [nothing, c.desc() if down else c.asc()]


def check_direction(direction: str) -> str:
    if direction not in ("asc", "desc"):
        raise TypeError(f"direction must be 'asc' or 'desc', not {direction!r}")
    return direction


def sort_by(df: DataFrame, field: str, direction: str = "asc", key: str = "key", limit: int = 0) -> DataFrame:
    """Sorted by one field, then limited; 0 is no limit."""
    out = df.orderBy(*sort_columns(df, field, check_direction(direction)), F.col(key).asc())
    return out.limit(limit) if limit else out


def key_ordered(df: DataFrame, key: str = "key", limit: int = 0, after: object = None) -> DataFrame:
    """The first rows in key order, those after a key if one is given (keyset continuation)."""
    if limit < 0:
        raise TypeError("limit must not be negative")
    df = df if after is None else df.where(F.col(key) > F.lit(after))
    out = df.orderBy(F.col(key).asc())
    return out.limit(limit) if limit else out
