"""Restock events: container arrivals of purchase orders (D3) and completed
inter-island transfers (D4), unioned (H1), merged per day (E2) and ranked
newest first (F1)."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import predicates as P
from ..functions import scalar as S
from ..session import cut_lineage
from ..sources.erp import Erp
from .util import broadcast_if_small, deal


def _any_prefix(channels: Sequence[str]):
    """A8 for restocks: ``Sku LIKE 'prefix%'`` for any of the channels."""
    return reduce(operator.or_, [F.col("Sku").startswith(c) for c in channels])


EVENT_COLUMNS = ("channel", "sku", "region", "checkin_date", "origin", "container_number", "po_code",
                 "transfer_id", "transfer_type")


def po_arrivals(erp: Erp, channels: Sequence[str] | None = None) -> DataFrame:
    """D3: PurchaseOrders ⋈ Lines ⋈ Products ⟕ Containers, made inner by C3.

    A container carries no line id, so every line of a PO is credited with
    every arrived container of that PO (as the source system does).  The lines of a PO
    with very many are dealt over parts that each have the PO's containers
    (``deal_hot_orders``), so no task lists a large PO's events alone."""
    products = broadcast_if_small(erp.products.withColumnRenamed("Id", "ProductId"))
    lines = erp.purchase_order_lines.join(products, "ProductId")
    if channels is not None:
        lines = lines.filter(_any_prefix(channels))  # LIKE 'prefix%'
    po = erp.purchase_orders.withColumnRenamed("Id", "PurchaseOrderId")
    cont = erp.containers.filter(P.arrived("ActualArrivingDate"))  # C3: the left join becomes inner
    lines, cont = deal_hot_orders(lines, cont)
    df = po.join(lines, "PurchaseOrderId").join(cont, ["PurchaseOrderId", "_part"])
    return df.select(
        S.channel_of("Sku").alias("channel"), F.col("Sku").alias("sku"),
        S.region_of_port("ShippedtoportId").alias("region"),
        F.to_date("ActualArrivingDate").alias("checkin_date"),
        F.lit("PO").alias("origin"),
        F.col("ContainerNumber").cast("string").alias("container_number"),
        F.col("PurchaseOrderCode").cast("string").alias("po_code"),
        F.lit(None).cast("string").alias("transfer_id"),
        F.lit(None).cast("string").alias("transfer_type"))


#: lines of a PO in one part, and hot POs that are broadcast at most (16 bytes each)
LINES_IN_PART, MOST_HOT = 2_000, 500_000


def deal_hot_orders(lines: DataFrame, containers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_part``: a PO of more than LINES_IN_PART lines has its lines dealt
    over as many parts as that takes, and its containers repeated in each; others have
    part 0.  The hot POs are found by a count that is combined before its shuffle; there
    is at most one for LINES_IN_PART lines, and they are broadcast if there are at most MOST_HOT."""
    hot = lines.groupBy("PurchaseOrderId").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LINES_IN_PART)
    hot = cut_lineage(hot.select("PurchaseOrderId", F.ceil(F.col("_n") / LINES_IN_PART).cast("int").alias("_parts")))
    n = hot.count()
    if not n:
        return lines.withColumn("_part", F.lit(0)), containers.withColumn("_part", F.lit(0))
    hot = F.broadcast(hot) if n <= MOST_HOT else hot
    parts = F.coalesce("_parts", F.lit(1))
    dealt = lines.withColumn("_line", F.monotonically_increasing_id()).join(hot, "PurchaseOrderId", "left") \
        .withColumn("_part", F.pmod(F.xxhash64("_line"), parts).cast("int")).drop("_line", "_parts")
    repeated = containers.join(hot, "PurchaseOrderId", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt, repeated


def transfers_in(erp: Erp, channels: Sequence[str] | None = None) -> DataFrame:
    """Transfers ⋈ Products ⟕ Warehouses (source) ⟕ Warehouses (target),
    made inner by the route filter C4.  The transfer-type filter (C5) differs
    between windows, so the type is kept as a column here."""
    products = broadcast_if_small(erp.products.withColumnRenamed("Id", "ProductId"))
    w = erp.warehouses.select(S.try_guid("Id").alias("wid"), "Name")
    # the route filter (C4) turns both left joins into inner joins, so the two
    # warehouse roles are reduced to the route's warehouses before joining
    src = broadcast_if_small(w.filter(F.col("Name") == K.TRANSFER_SOURCE)
                             .select(F.col("wid").alias("_src"), F.col("Name").alias("source_name")))
    dst = broadcast_if_small(w.filter(F.col("Name") == K.TRANSFER_TARGET)
                             .select(F.col("wid").alias("_dst"), F.col("Name").alias("target_name")))
    t = (erp.transfers.filter(F.col("TransferJobStatus") == K.TRANSFER_DONE)
         .withColumn("_src", S.try_guid("SourceWarehouseId"))
         .withColumn("_dst", S.try_guid("TargetWarehouseId")))
    df = (t.join(products, "ProductId").join(src, "_src").join(dst, "_dst")
          .filter(P.transfer_route("source_name", "target_name", "TransferJobStatus")))
    if channels is not None:
        df = df.filter(_any_prefix(channels))
    return df.select(
        S.channel_of("Sku").alias("channel"), F.col("Sku").alias("sku"),
        F.lit(K.SOUTH).alias("region"),
        F.to_date("CompletedOnUtc").alias("checkin_date"),
        F.lit("Transfer").alias("origin"),
        F.lit(None).cast("string").alias("container_number"),
        F.lit(None).cast("string").alias("po_code"),
        F.col("Id").cast("string").alias("transfer_id"),
        F.col("TransferType").cast("string").alias("transfer_type"))


def restock_day_counts(erp: Erp, with_transfers: bool = True, channels: Sequence[str] | None = None, by_key: bool = False) -> DataFrame:
    """Restock events counted per (channel, sku, region, day) and class, without
    materialising line x container pairs: PO lines are counted per (PO, SKU),
    arrived containers per (PO, region, day); the two aggregates are joined on
    the PO and their counts multiplied.  A PO with very many lines and
    containers therefore costs distinct SKUs x arrival days, not lines x
    containers (and AQE splits a hot PO's join partition).

    Columns: n_po (PO events), n_tnull (transfers of null type), n_tkept
    (transfers of a type other than 'Order').  ``by_key`` deals the rows by key before
    they are counted, so a window over the key that follows needs no exchange."""
    products = broadcast_if_small(erp.products.withColumnRenamed("Id", "ProductId"))
    lines = erp.purchase_order_lines.join(products, "ProductId")
    if channels is not None:
        lines = lines.filter(_any_prefix(channels))
    headers = erp.purchase_orders.select(F.col("Id").alias("PurchaseOrderId"))
    lines = (lines.join(headers, "PurchaseOrderId", "left_semi")
             .groupBy("PurchaseOrderId", "Sku").agg(F.count(F.lit(1)).alias("n_lines")))
    cont = (erp.containers.filter(P.arrived("ActualArrivingDate"))
            .groupBy("PurchaseOrderId", S.region_of_port("ShippedtoportId").alias("region"),
                     F.to_date("ActualArrivingDate").alias("checkin_date"))
            .agg(F.count(F.lit(1)).alias("n_cont")))
    po = lines.join(cont, "PurchaseOrderId").select(
        S.channel_of("Sku").alias("channel"), F.col("Sku").alias("sku"), "region", "checkin_date",
        (F.col("n_lines") * F.col("n_cont")).alias("n_po"),
        F.lit(0).cast("bigint").alias("n_tnull"), F.lit(0).cast("bigint").alias("n_tkept"))
    if with_transfers:
        t = transfers_in(erp, channels)
        t = t.select("channel", "sku", "region", "checkin_date", F.lit(0).cast("bigint").alias("n_po"),
                     F.col("transfer_type").isNull().cast("bigint").alias("n_tnull"),
                     P.not_order_type("transfer_type", keep_null=False).cast("bigint").alias("n_tkept"))
        po = po.unionByName(t.filter((F.col("n_tnull") + F.coalesce("n_tkept", F.lit(0))) > 0).na.fill(0))
    po = deal(po) if by_key else po
    return (po.groupBy("channel", "sku", "region", "checkin_date")
            .agg(F.sum("n_po").alias("n_po"), F.sum("n_tnull").alias("n_tnull"), F.sum("n_tkept").alias("n_tkept")))


def po_event_candidates(erp: Erp, channels: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    """PO arrival events as needed by the windows, without materialising all
    line x container pairs of a PO.

    ``top=None`` (for windows that merge same-day events): one row per (PO,
    SKU, region, day) carrying the PO's largest container number of that day —
    the MAX the merge takes anyway.  ``top=N`` (for the window that keeps
    same-day events apart): only the N smallest containers of each (PO,
    region, day), each repeated min(lines of the SKU, N) times; any other
    event of that SKU has N events of the same PO and day ranked before it, so
    the newest-N selection is unchanged."""
    products = broadcast_if_small(erp.products.withColumnRenamed("Id", "ProductId"))
    lines = erp.purchase_order_lines.join(products, "ProductId")
    if channels is not None:
        lines = lines.filter(_any_prefix(channels))
    lines = lines.groupBy("PurchaseOrderId", "Sku").agg(F.count(F.lit(1)).alias("n_lines"))
    headers = erp.purchase_orders.select(F.col("Id").alias("PurchaseOrderId"),
                                         F.col("PurchaseOrderCode").cast("string").alias("po_code"))
    cont = erp.containers.filter(P.arrived("ActualArrivingDate")).select(
        "PurchaseOrderId", S.region_of_port("ShippedtoportId").alias("region"),
        F.to_date("ActualArrivingDate").alias("checkin_date"),
        F.col("ContainerNumber").cast("string").alias("container_number"))
    group = ("PurchaseOrderId", "region", "checkin_date")
    if top is None:
        cont = cont.groupBy(*group).agg(F.max("container_number").alias("container_number"))
    else:
        w = Window.partitionBy(*group).orderBy(F.col("container_number").asc_nulls_last())
        cont = cont.withColumn("_c", F.row_number().over(w)).filter(F.col("_c") <= top).drop("_c")
    j = lines.join(headers, "PurchaseOrderId").join(cont, "PurchaseOrderId")
    if top is not None:
        j = j.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n_lines"), F.lit(top)).cast("int"))))
    return j.select(
        S.channel_of("Sku").alias("channel"), F.col("Sku").alias("sku"), "region", "checkin_date",
        F.lit("PO").alias("origin"), "container_number", "po_code",
        F.lit(None).cast("string").alias("transfer_id"), F.lit(None).cast("string").alias("transfer_type"))


def restock_candidates(erp: Erp, with_transfers: bool = True, channels: Sequence[str] | None = None,
                       top: int | None = None) -> DataFrame:
    """H1 for the windows: PO event candidates (see ``po_event_candidates``)
    and completed transfers (one event per transfer, no pairs)."""
    po = po_event_candidates(erp, channels, top)
    return po.unionByName(transfers_in(erp, channels)) if with_transfers else po


def restock_events(erp: Erp, with_transfers: bool = True, channels: Sequence[str] | None = None) -> DataFrame:
    """H1: UNION ALL of PO arrivals and transfers, every raw event (the event
    list itself; the windows use ``restock_candidates``)."""
    arrivals = po_arrivals(erp, channels)
    if not with_transfers:
        return arrivals
    return arrivals.unionByName(transfers_in(erp, channels))


def rank_order():
    return (F.col("checkin_date").desc(), F.col("container_number").asc_nulls_last(),
            F.col("po_code").asc_nulls_last(), F.col("source_type").asc_nulls_last())


def rank_restocks(events: DataFrame, partition: Sequence[str] = ("channel", "sku", "region"),
                  keep: int | None = 3) -> DataFrame:
    """F1 + C6: ``row_number`` newest first per key; ``keep`` = last N restocks.

    Same-day events only remain in the 30-day window; among them the order is
    container, then code (the source leaves it undefined).  ``rn <= N`` lets
    Spark push a partial top-N (WindowGroupLimit) below the shuffle, so a hot
    key ships at most N rows per task."""
    w = Window.partitionBy(*partition).orderBy(*rank_order())
    ranked = events.withColumn("rn", F.row_number().over(w))
    return ranked.filter(F.col("rn") <= keep) if keep else ranked
