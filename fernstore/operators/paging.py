"""Keyset pagination: cursors are values of the ordering fields, compared lexicographically under the directions.

Null is smaller than any value. A page reads limit + 1 rows as a top-k over the rows beyond the cursor; only a
page is ever collected. Rows that equal a cursor in all ordering fields count as being at it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantVal

from fernstore.operators.ordering import is_mixed, mixed_key, mixed_literal, sort_columns


@dataclass(frozen=True)
class Order:
    field: str
    direction: str = "asc"


@dataclass(frozen=True)
class Page:
    docs: list[dict[str, Any]]
    has_next_page: bool
    has_prev_page: bool
    start_cursor: list[Any] | None
    end_cursor: list[Any] | None


def _beyond(order: Order, value: Any, mixed: frozenset[str]) -> Column:
    """Rows that come strictly after ``value`` in one field."""
    c = F.col(f"`{order.field}`")
    if order.field in mixed:
        return mixed_key(c) > mixed_literal(value) if order.direction == "asc" else mixed_key(c) < mixed_literal(value)
    if order.direction == "asc":
        return c.isNotNull() if value is None else c > F.lit(value)
    return F.lit(False) if value is None else (c < F.lit(value)) | c.isNull()


def _before(order: Order, value: Any, mixed: frozenset[str]) -> Column:
    """Rows that come strictly before ``value`` in one field."""
    return _beyond(Order(order.field, "desc" if order.direction == "asc" else "asc"), value, mixed)


def _same(order: Order, value: Any, mixed: frozenset[str]) -> Column:
    c = F.col(f"`{order.field}`")
    return mixed_key(c) == mixed_literal(value) if order.field in mixed else c.eqNullSafe(F.lit(value))


def bound(orders: tuple[Order, ...], cursor: tuple[Any, ...], after: bool, inclusive: bool, mixed: frozenset[str] = frozenset()) -> Column:
    """Rows on one side of a cursor: for some prefix of the fields equal to it, the next field is beyond it.

    A cursor may be shorter than the ordering; then its fields alone count. ``mixed`` fields hold values of several types.
    """
    side = _beyond if after else _before
    orders = orders[: len(cursor)]
    same = [_same(o, v, mixed) for o, v in zip(orders, cursor, strict=True)]
    parts = [reduce(and_, [*same[:k], side(o, cursor[k], mixed)]) for k, o in enumerate(orders)]
    if inclusive:
        parts.append(reduce(and_, same))
    found = reduce(or_, parts)
    if cursor[0] is not None and orders[0].field not in mixed:
        # implied by the whole, and simple enough to reach the scan
        first = F.col(f"`{orders[0].field}`")
        up = (orders[0].direction == "asc") == after
        if up:
            found = (first >= F.lit(cursor[0])) & found
        elif orders[0].direction == "desc":
            found = ((first <= F.lit(cursor[0])) | first.isNull()) & found
    return found


def page_rows(df: DataFrame, orders: tuple[Order, ...], limit: int, start: tuple[tuple[Any, ...], bool] | None = None, end: tuple[tuple[Any, ...], bool] | None = None, key: str = "key") -> DataFrame:
    """The first ``limit`` rows between two cursors, each (values, inclusive)."""
    mixed = frozenset(o.field for o in orders if is_mixed(df, o.field))
    if start:
        df = df.where(bound(orders, start[0], True, start[1], mixed))
    if end:
        df = df.where(bound(orders, end[0], False, end[1], mixed))
    by = [c for o in orders for c in sort_columns(df, o.field, o.direction, False)]
    return df.orderBy(*by, F.col(key).asc()).limit(limit)


def page(df: DataFrame, orders: tuple[Order, ...], limit: int, start=None, end=None, key: str = "key") -> Page:
    """One page with its envelope; collects limit + 1 rows."""
    rows = [{k: v.toPython() if isinstance(v, VariantVal) else v for k, v in r.asDict().items()} for r in page_rows(df, orders, limit + 1, start, end, key).collect()]
    docs = rows[:limit]
    cursor = lambda d: [d[o.field] for o in orders]
    return Page(docs, len(rows) > limit, start is not None, cursor(docs[0]) if docs else None, cursor(docs[-1]) if docs else None)
