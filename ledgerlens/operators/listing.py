"""Filtered listings: optional predicates, one order, one page, and the total."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.documents import field


def all_of(predicates: Sequence[Column | None]) -> Column:
    """Conjunction of the predicates that are given; None entries are left out, not evaluated as null."""
    given = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def equal_or_in(column: str, value: Any) -> Column | None:
    """Equality for one value, membership for a list, nothing for None or an empty list."""
    if value is None or (isinstance(value, (list, tuple, set)) and not value):
        return None
    if isinstance(value, (list, tuple, set)):
        return F.col(column).isin(*value)
    return F.col(column) == F.lit(value)


def same_or_both_null(column: str, value: Any) -> Column:
    return F.col(column).eqNullSafe(F.lit(value))


def page(
    df: DataFrame,
    predicates: Sequence[Column | None],
    order: Sequence[Column],
    limit: int | None = None,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Rows of one page in order, and a one-row table with the total."""
    matching = df.filter(all_of(predicates))
    rows = matching.orderBy(*order)
    if offset:
        rows = rows.offset(offset)
    if limit is not None:
        rows = rows.limit(limit)
    return rows, matching.agg(F.count(F.lit(1)).alias("total"))


def listing(
    df: DataFrame,
    equals: Mapping[str, Any],
    order: Sequence[Column],
    extra: Sequence[Column | None] = (),
    limit: int | None = None,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """:func:`page` with equality or membership predicates given as a mapping."""
    return page(df, [*[equal_or_in(c, v) for c, v in equals.items()], *extra], order, limit, offset)


def between(column: str, start: Any = None, end: Any = None) -> Column | None:
    """Closed range; either end may be open."""
    parts = [
        F.col(column) >= F.lit(start) if start is not None else None,
        F.col(column) <= F.lit(end) if end is not None else None,
    ]
    return all_of(parts) if any(p is not None for p in parts) else None


def json_field_in(column: str, path: Sequence[str], values: Sequence[str]) -> Column:
    """Nested JSON text field equal to one of the values."""
    return field(F.col(column), *path).isin(*values)


def sorted_nulls_last(df: DataFrame, column: str, descending: bool, ties: Sequence[str]) -> DataFrame:
    """Sort by any column with missing values last in both directions."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(key, *ties)


# Which transfers belong to which category; fixed values.
RAMP_TYPES = ["onramp", "offramp"]


def in_category(category: str) -> Column:
    """'wallet' or 'ramp' transfers by type."""
    ramp = F.col("type").isin(*RAMP_TYPES)
    return ramp if category == "ramp" else ~ramp


def list_transfers(
    transfers: DataFrame,
    equals: Mapping[str, Any],
    created_from: Any = None,
    created_to: Any = None,
    limit: int | None = None,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Transfers, newest first."""
    return listing(
        transfers,
        equals,
        [F.col("created_at").desc(), F.col("id").desc()],
        [between("created_at", created_from, created_to)],
        limit,
        offset,
    )


def transfers_by_status(
    transfers: DataFrame,
    statuses: Sequence[str],
    types: Sequence[str] | None = None,
    has_signature: bool | None = None,
    created_before: Any = None,
    updated_before: Any = None,
) -> DataFrame:
    """Transfers waiting for an update, oldest first; no status gives no rows."""
    signature = F.col("signature")
    predicates = [
        F.col("status").isin(*statuses) if statuses else F.lit(False),
        equal_or_in("type", types),
        None if has_signature is None else signature.isNotNull() if has_signature else signature.isNull(),
        None if created_before is None else F.col("created_at") < F.lit(created_before),
        None if updated_before is None else F.col("updated_at") < F.lit(updated_before),
    ]
    return page(transfers, predicates, [F.col("updated_at"), F.col("id")])[0]


def waiting_since(
    df: DataFrame, statuses: Sequence[str], cutoff: Any, limit: int | None = None
) -> DataFrame:
    """Rows in one of the statuses not updated after the cutoff, oldest first."""
    predicates = [F.col("status").isin(*statuses), F.col("updated_at") <= F.lit(cutoff)]
    return page(df, predicates, [F.col("updated_at"), F.col("id")], limit)[0]
