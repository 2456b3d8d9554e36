"""Ordered listings page by page: a page is asked for by the key that it comes after, so no listing is sorted as a whole."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (column, whether it runs downwards); nulls count as less than anything. The last columns must tell rows apart.
Order = list[tuple[str, bool]]

# The orders of the listings; names in any case are compared by a column that the caller adds.
BY_NAME: Order = [("filename", False), ("id", False)]
BY_SYSTEM_TITLE: Order = [("system_id", False), ("title", False), ("id", False)]
BY_SYSTEM_NAME: Order = [("system_id", False), ("filename", False), ("id", False)]
LARGEST_FIRST: Order = [("size_bytes", True), ("id", False)]
COLLECTIONS: Order = [("is_system", True), ("name", False), ("id", False)]


def _beyond(column: str, value: Any, down: bool) -> Column:
    c = F.col(column)
    if value is None:  # the least there is
        return F.lit(False) if down else c.isNotNull()
    return (c < F.lit(value)) | c.isNull() if down else c > F.lit(value)


def after(order: Order, key: list) -> Column:
    """Rows that come after a key (a value for each column of the order). The first column's own bound is stated apart, for the scan."""
    out, equal = F.lit(False), F.lit(True)
    for (column, down), value in zip(order, key, strict=True):
        out |= equal & _beyond(column, value, down)
        equal &= F.col(column).eqNullSafe(F.lit(value))
    (column, down), value = order[0], key[0]
    return out & (_beyond(column, value, down) | F.col(column).eqNullSafe(F.lit(value)))


def sort_columns(order: Order) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]


def page(rows: DataFrame, order: Order, n: int, key: list | None = None) -> DataFrame:
    """The first n rows, or the n after a key, in order: a top-k of each partition and of these, never a sort of all rows."""
    return (rows if key is None else rows.where(after(order, key))).orderBy(*sort_columns(order)).limit(n)


def last_key(rows: DataFrame, order: Order) -> list | None:
    """The key of the last row of a page, null for an empty one; the next page comes after it."""
    back = [F.asc_nulls_first(c) if down else F.desc_nulls_last(c) for c, down in order]
    last = rows.orderBy(*back).select(*(c for c, _ in order)).first()
    return list(last) if last else None
