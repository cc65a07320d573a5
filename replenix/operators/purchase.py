"""Open purchase orders: in transit vs in production."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalar as S


def po_rows(po: DataFrame) -> DataFrame:
    """C8 per row: quantity split into transit / production parts.

    Not checked in + container -> in transit; not checked in without one ->
    in production; with no ContainerNumber column everything open is in transit."""
    if "channel" not in po.columns:
        po = po.withColumn("channel", S.channel_of("Sku"))
    open_ = P.not_checked_in("CheckinDate")
    qty = S.parse_number("QuantityOrdered")  # nan and other text: null
    if "ContainerNumber" in po.columns:
        transit = open_ & P.has_container("ContainerNumber")
        production = open_ & ~P.has_container("ContainerNumber")
    else:
        transit, production = open_, F.lit(False)
    return (po.filter(F.col("Sku").isNotNull() & F.col("Region").isNotNull())
            .select("channel", F.col("Sku").cast("string").alias("sku"), F.col("Region").cast("string").alias("region"),
                    F.when(transit, qty).alias("transit_qty"), F.when(production, qty).alias("production_qty")))


def open_po(po: DataFrame) -> DataFrame:
    """E5: one grouped pass with two conditional sums; every PO key is kept
    (checked-in ones too, with 0), since all PO keys enter the key spine."""
    return (po_rows(po).groupBy("channel", "sku", "region")
            .agg(F.coalesce(F.sum("transit_qty"), F.lit(0.0)).alias("in_transit"),
                 F.coalesce(F.sum("production_qty"), F.lit(0.0)).alias("in_production")))
