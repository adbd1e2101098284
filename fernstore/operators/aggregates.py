"""Aggregation: sum, count, avg, min and max over groups or over all rows.

Sums are doubles and 0.0 where nothing is to be added; counts are of non-null values; averages skip nulls; minima
and maxima keep their type. Null keys form a group. Without keys there is one row if any row came in, else none.

In a field of mixed types (a variant) numbers add and whatever else isn't null counts as 0; minima and maxima follow the order of
sorts; values that are equal in it form a group, and the group's key is one of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernstore.operators.ordering import is_mixed, mixed_key
from fernstore.operators.predicates import variant_as


@dataclass(frozen=True)
class Aggregate:
    op: str
    field: str

    def __post_init__(self):
        if self.op not in ("sum", "count", "avg", "min", "max"):
            raise TypeError(f"unknown aggregation {self.op!r}")

    def column(self, df: DataFrame) -> Column:
        c = F.col(f"`{self.field}`")
        mixed = is_mixed(df, self.field)
        there = c.isNotNull() & ~F.is_variant_null(c) if mixed else c.isNotNull()
        if self.op == "count":
            return F.count(F.when(there, 1)) if mixed else F.count(c)
        if self.op in ("min", "max"):
            if mixed:
                return (F.min_by if self.op == "min" else F.max_by)(c, F.when(there, mixed_key(c)))
            return F.min(c) if self.op == "min" else F.max(c)
        numeric = isinstance(df.schema[self.field].dataType, T.NumericType)
        # cells that aren't numbers count as 0 in sums, null stays null
        number = F.when(there, F.coalesce(variant_as(c, 0.0), F.lit(0.0))) if mixed else c.cast("double") if numeric else F.when(there, F.lit(0.0))
        return F.coalesce(F.sum(number), F.lit(0.0)) if self.op == "sum" else F.avg(number)


def sum_(field: str) -> Aggregate:
    return Aggregate("sum", field)


def count(field: str) -> Aggregate:
    return Aggregate("count", field)


def avg(field: str) -> Aggregate:
    return Aggregate("avg", field)


def min_(field: str) -> Aggregate:
    return Aggregate("min", field)


def max_(field: str) -> Aggregate:
    return Aggregate("max", field)


def aggregate(df: DataFrame, keys: tuple[str, ...], named: dict[str, Aggregate]) -> DataFrame:
    """Group fields and named aggregates; partial sums are formed before the shuffle."""
    columns = [a.column(df).alias(name) for name, a in named.items()]
    if keys:
        mixed = [k for k in keys if is_mixed(df, k)]
        if not mixed:
            return df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(*columns)
        by = [mixed_key(F.col(f"`{k}`")).alias(f"_key_{k}") if k in mixed else F.col(f"`{k}`") for k in keys]
        shown = [F.min_by(F.col(f"`{k}`"), F.schema_of_variant(F.col(f"`{k}`"))).alias(f"_shown_{k}") for k in mixed]
        out = df.groupBy(*by).agg(*shown, *columns)
        return out.select(*(F.col(f"`_shown_{k}`").alias(k) if k in mixed else F.col(f"`{k}`") for k in keys), *(F.col(f"`{n}`") for n in named))
    rows = "_rows" if "_rows" not in named else "__rows"
    return df.agg(*columns, F.count(F.lit(1)).alias(rows)).where(F.col(rows) > 0).drop(rows)
