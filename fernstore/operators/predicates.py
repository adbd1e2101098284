"""Filters: conjunctions of (field, operator, value).

Null and missing fields never match (but for ``is_null``); numbers compare by value whatever their types; text
compares bytewise. Comparisons with literals and prefixes reach the Parquet scan as pushed filters. A field of mixed
types, a variant, is compared where it has the type of the value.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARE = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise TypeError(f"unknown operator {self.op!r}")
        if self.op == "array-contains" and isinstance(self.value, (list, tuple, set)):
            raise TypeError("array_contains looks for one element; array_contains_any takes several")
        if self.op == "array-contains-any" and (not isinstance(self.value, (list, tuple)) or not self.value):
            raise TypeError("array_contains_any needs a list with at least one element")

    def column(self, fields: dict[str, Column] | None = None) -> Column:
        """The condition over a column of its field's name, or over ``fields[name]``."""
        c = (fields or {}).get(self.field)
        return OPERATORS[self.op](F.col(f"`{self.field}`") if c is None else c, self.value)


def _contains(c: Column, value: Any) -> Column:
    return F.coalesce(F.array_contains(c, value), F.lit(False))


def _contains_any(c: Column, values: Iterable[Any]) -> Column:
    return F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, values))), F.lit(False))


OPERATORS = {
    **{op: (lambda c, v, f=f: f(c, F.lit(v))) for op, f in COMPARE.items()},
    "array-contains": _contains,
    "array-contains-any": _contains_any,
    "in": lambda c, v: c.isin(*v),
    "not-in": lambda c, v: ~c.isin(*v),
    "like": lambda c, v: c.like(v),
    "starts-with": lambda c, v: F.startswith(c, F.lit(v)),
    "ends-with": lambda c, v: F.endswith(c, F.lit(v)),
    "is-null": lambda c, _: c.isNull(),
    "search": lambda c, v: F.contains(F.lower(c), F.lit(v.lower())),
}

#: The operators that an index on the field can serve.
INDEXABLE = frozenset({"==", "array-contains", "array-contains-any", ">", ">=", "<", "<="})


def all_of(conditions: Iterable[Condition], fields: dict[str, Column] | None = None) -> Column | None:
    columns = [c.column(fields) for c in conditions]
    return reduce(and_, columns) if columns else None


#: Kinds of variants by the Python type of a value: a pattern of their names, and what they are read as.
_NUMBER = (r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "double")
_KIND_OF = {bool: ("^BOOLEAN$", "boolean"), int: _NUMBER, float: _NUMBER, str: ("^STRING$", "string")}


def variant_as(c: Column, value: Any) -> Column:
    """A variant as the type of ``value``; null where it has another."""
    pattern, kind = _KIND_OF.get(type(value), ("^$", "string"))
    return F.when(F.rlike(F.schema_of_variant(c), F.lit(pattern)), F.try_variant_get(c, "$", kind))


def _is_any(c: Column, values: Iterable[Any]) -> Column:
    return reduce(or_, (F.coalesce(variant_as(c, v) == F.lit(v), F.lit(False)) for v in values))


def _variant_condition(c: Column, condition: Condition) -> Column:
    v = condition.value
    if condition.op.startswith("array"):
        items = F.when(F.startswith(F.schema_of_variant(c), F.lit("ARRAY")), F.try_variant_get(c, "$", "array<variant>"))
        wanted = v if condition.op == "array-contains-any" else [v]
        return F.coalesce(F.exists(items, lambda x: _is_any(x, wanted)), F.lit(False))
    if condition.op in ("in", "not-in"):
        found = _is_any(c, v)
        return found if condition.op == "in" else ~found & c.isNotNull()
    if condition.op == "is-null":
        return c.isNull() | F.is_variant_null(c)
    return OPERATORS[condition.op](variant_as(c, v), v)


def where_all(df: DataFrame, conditions: Iterable[Condition]) -> DataFrame:
    """The rows that meet all conditions, in whatever order they are given. An unknown field is an analysis error."""
    mixed = {f.name for f in df.schema if isinstance(f.dataType, T.VariantType)}
    found = [_variant_condition(F.col(f"`{c.field}`"), c) if c.field in mixed else c.column() for c in conditions]
    return df.where(reduce(and_, found)) if found else df
