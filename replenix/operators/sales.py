"""Sales layer: order lines joined to products and warehouses (D1, D2), then
daily quantity per date, SKU and region (E1)."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import predicates as P
from ..functions import scalar as S
from ..sources.erp import Erp
from .util import BROADCAST_LIMIT_BYTES, broadcast_if_small, deal, plan_size_bytes


#: copies of the warehouse relation where it is too large, or of unknown size, to broadcast
WAREHOUSE_SPREAD = 32


def located_lines(erp: Erp, known_only: bool = True, excluded: Sequence[str] = K.EXCLUDED_WAREHOUSES) -> DataFrame:
    """Order lines with the name of the warehouse in their stock snapshot.

    The id is taken from the JSON at the scan, so no later shuffle carries the text.
    ``known_only`` keeps lines of a valid snapshot (C14) and a known warehouse that is
    not excluded (C2); otherwise every line stays.  A few dozen warehouses share all
    lines: where they are not broadcast, each is dealt over WAREHOUSE_SPREAD parts."""
    w = erp.warehouses.select(S.try_guid("Id").alias("_wid"), F.col("Name").alias("warehouse_name"))
    # the generator keeps the filters on the id from being pushed below it, where each
    # would parse the text again
    lines = erp.order_lines.select("OrderId", "ProductId", "Quantity", F.explode(F.array(S.json_first_warehouse("StockSnapshotJson"))).alias("_raw"))
    lines = lines.select("OrderId", "ProductId", "Quantity", S.try_guid("_raw").alias("_wid"))
    if known_only:  # an id is found in valid JSON arrays only
        w = w.filter(P.not_excluded("warehouse_name", excluded))
        lines = lines.filter(F.col("_wid").isNotNull())
    on, how = ["_wid"], "inner" if known_only else "left"
    size = plan_size_bytes(w)
    if size is not None and size <= BROADCAST_LIMIT_BYTES:
        w = F.broadcast(w)
    else:
        on = ["_wid", "_part"]
        lines = lines.withColumn("_part", F.pmod(F.xxhash64("OrderId", "ProductId"), F.lit(WAREHOUSE_SPREAD)))
        w = w.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(WAREHOUSE_SPREAD - 1).cast("bigint"))))
    return lines.join(w, on, how).drop(*on)


def order_lines(erp: Erp, lines: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """Lines ⋈ Products ⋈ Orders (inner, equi).

    Lines meet the (small, size-checked broadcast) products first, so a channel
    restriction (A8: ``LEFT(sku, 3) IN (...)``) shrinks them before the large
    lines ⋈ orders join."""
    orders = erp.orders.withColumnRenamed("Id", "OrderId")
    products = erp.products.withColumnRenamed("Id", "ProductId")
    if channels is not None:
        products = products.filter(S.channel_of("Sku").isin(*channels))
    return lines.join(broadcast_if_small(products), "ProductId").join(orders, "OrderId")


def sold_between(policy: str, date_from: str, date_to: str | None) -> Column:
    """C1 on the stored columns, without ``coalesce``: a test that a scan can take."""
    created = P.in_dates(F.to_date("DateCreatedUtc"), date_from, date_to)
    if policy == "created":
        return created
    return P.in_dates(F.to_date("PaidDateUtc"), date_from, date_to) | (F.col("PaidDateUtc").isNull() & created)


def sales_lines(erp: Erp, policies: Sequence[str] = ("paid",), date_from: str = K.SALES_FROM,
                date_to: str | None = K.SALES_TO, channels: Sequence[str] | None = None,
                excluded: Sequence[str] = K.EXCLUDED_WAREHOUSES, by_key: bool = False) -> DataFrame:
    """Sale lines with one row per requested date policy (B3) and the policy's
    own date filter (C1): ``paid`` uses ``between(date_from, date_to)`` on
    coalesce(paid, created); ``created`` uses ``created >= date_from``.  ``by_key`` deals
    each line once, by its key, before it becomes a row per policy."""
    conds = [sold_between(p, date_from, date_to if p == "paid" else None) for p in policies]
    # the union of the date filters goes to the Orders scan before joining
    erp_f = Erp(**{**erp.__dict__, "orders": erp.orders.filter(reduce(operator.or_, conds))})
    located = located_lines(erp, excluded=excluded)
    lines = located.select("OrderId", "ProductId", "Quantity", S.region_of_warehouse("warehouse_name").alias("region"))
    df = order_lines(erp_f, lines, channels)
    dated = F.array(*[
        F.struct(F.lit(p).alias("policy"), S.sale_date("PaidDateUtc", "DateCreatedUtc", p).alias("order_date"),
                 c.alias("_keep"))
        for p, c in zip(policies, conds)])
    df = df.select(S.channel_of("Sku").alias("channel"), F.col("Sku").alias("sku"), "region",
                   F.col("Quantity").alias("qty"), "PaidDateUtc", "DateCreatedUtc")
    df = deal(df) if by_key else df
    out = (df.select("channel", "sku", "region", "qty", F.explode(dated).alias("_d"))
           .filter(F.col("_d._keep"))
           .select("_d.policy", "channel", "sku", "region", "_d.order_date", "qty"))
    return out


def daily_sales(erp: Erp, policies: Sequence[str] = ("paid",), date_from: str = K.SALES_FROM,
                date_to: str | None = K.SALES_TO, channels: Sequence[str] | None = None, by_key: bool = False) -> DataFrame:
    """``SUM(Quantity)`` per (policy, channel, sku, region, order_date).

    Partial aggregation runs before the shuffle, so a hot SKU is reduced to at
    most one row per day and task before it moves.  With ``by_key`` the lines move
    once, by key, and are summed there: a hash aggregate of at most one row a day,
    which leaves the rows dealt as the windows over the key need them."""
    lines = sales_lines(erp, policies, date_from, date_to, channels, by_key=by_key)
    return (lines.groupBy("policy", "channel", "sku", "region", "order_date")
            .agg(F.sum("qty").alias("daily_qty")))


def reconcile_sales(erp: Erp, date_lo: str, date_hi: str, sku: str | None = None) -> DataFrame:
    """Total quantity and distinct order days between two dates per SKU
    and region, ignoring restocks (created date; unknown warehouse = north)."""
    d = F.to_date("DateCreatedUtc")
    orders = erp.orders.filter(d.between(F.lit(date_lo).cast("date"), F.lit(date_hi).cast("date")))
    df = order_lines(Erp(**{**erp.__dict__, "orders": orders}), located_lines(erp, known_only=False))
    df = P.for_sku(df, sku, "Sku")  # C7
    region = F.when(F.trim("warehouse_name").isin(*K.SOUTH_WAREHOUSES), F.lit(K.SOUTH)).otherwise(F.lit(K.NORTH))
    return (df.groupBy(S.channel_of("Sku").alias("channel"), F.col("Sku").alias("sku"), region.alias("region"))
            .agg(F.sum("Quantity").alias("total_qty"),
                 F.count_distinct(F.to_date("DateCreatedUtc")).alias("order_days")))
