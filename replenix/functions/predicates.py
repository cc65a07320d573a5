"""Filter predicates (the C-series) as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .scalar import _c, is_empty, is_json


# C1
def in_dates(date, lo: str, hi: str | None = None) -> Column:
    d = _c(date)
    return d.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")) if hi else d >= F.lit(lo).cast("date")


# A null name is dropped too (NOT IN on null is unknown)
def not_excluded(name, names: Iterable[str] = K.EXCLUDED_WAREHOUSES) -> Column:
    return ~F.trim(_c(name)).isin(*names)


# C3
def arrived(col="ActualArrivingDate") -> Column:
    return _c(col).isNotNull()


# C4
def transfer_route(source_name, target_name, status, src: str = K.TRANSFER_SOURCE,
                   dst: str = K.TRANSFER_TARGET, done: str = K.TRANSFER_DONE) -> Column:
    return (_c(target_name) == dst) & (_c(source_name) == src) & (_c(status) == done)


# C5
def not_order_type(col, keep_null: bool, excluded: str = K.TRANSFER_TYPE_EXCLUDED) -> Column:
    """keep_null=True: ``CASE WHEN t='Order' THEN 0 ELSE 1 END = 1`` (null kept);
    keep_null=False: ``t <> 'Order'`` (null dropped)."""
    c = _c(col)
    return ~c.eqNullSafe(F.lit(excluded)) if keep_null else (c != F.lit(excluded))


# C7
def for_sku(df: DataFrame, sku: str | None = None, col: str = "sku") -> DataFrame:
    return df if sku is None else df.filter(F.col(col) == sku)


# C8 helpers
def not_checked_in(checkin="checkin_date") -> Column:
    return is_empty(checkin)


def has_container(container="container_number") -> Column:
    return ~is_empty(container)


# 1 is dropped; 0, 2 and missing (filled 0) are kept
def not_discontinued(flag="is_discontinued") -> Column:
    return _c(flag) != 1


# C12
def is_active(decision="decision") -> Column:
    return _c(decision).isin(K.ORDER, K.EXPEDITE)


# C14
def valid_snapshot(col="stock_snapshot_json") -> Column:
    return is_json(col)
