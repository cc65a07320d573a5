"""Small in-memory ERP builders for operator tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from replenix import constants as K
from replenix.sources.erp import Erp

WH = {  # warehouse id -> name
    "00000000-0000-4000-8000-000000000001": "CHCH Gerald Connelly",
    "00000000-0000-4000-8000-000000000002": "Hamilton Te Rapa",
    "00000000-0000-4000-8000-000000000003": "CHCH in transit",
}
SOUTH_WH = "00000000-0000-4000-8000-000000000001"
NORTH_WH = "00000000-0000-4000-8000-000000000002"
TRANSIT_WH = "00000000-0000-4000-8000-000000000003"


def d(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def make_erp(spark: SparkSession, skus=("918-001",), sales=(), arrivals=(), transfers=()) -> Erp:
    """sales: (order_id, sku, qty, created, paid, warehouse_id)
    arrivals: (po_id, sku, container, port_id, arrival)  — one PO line per row
    transfers: (id, sku, completed, type, status)"""
    products = spark.createDataFrame([(i + 1, s) for i, s in enumerate(skus)], "Id long, Sku string")
    pid = {s: i + 1 for i, s in enumerate(skus)}
    orders = spark.createDataFrame([(o, p and d(p), d(c)) for o, _, _, c, p, _ in sales] or [],
                                   "Id long, PaidDateUtc timestamp_ntz, DateCreatedUtc timestamp_ntz")
    lines = spark.createDataFrame(
        [(o, pid[s], float(q), f'[{{"WarehouseId":"{w}"}}]') for o, s, q, _, _, w in sales] or [],
        "OrderId long, ProductId long, Quantity double, StockSnapshotJson string")
    warehouses = spark.createDataFrame(list(WH.items()), "Id string, Name string")
    pos = sorted({a[0] for a in arrivals})
    purchase_orders = spark.createDataFrame([(p, f"PO{p}") for p in pos] or [], "Id long, PurchaseOrderCode string")
    po_lines = spark.createDataFrame(sorted({(a[0], pid[a[1]]) for a in arrivals}) or [],
                                     "PurchaseOrderId long, ProductId long")
    containers = spark.createDataFrame([(a[0], a[2], a[3], a[4] and d(a[4])) for a in arrivals] or [],
                                       "PurchaseOrderId long, ContainerNumber string, ShippedtoportId string, "
                                       "ActualArrivingDate timestamp_ntz")
    tr = spark.createDataFrame(
        [(t[0], pid[t[1]], TRANSIT_WH, SOUTH_WH, d(t[2]), t[4] if len(t) > 4 else K.TRANSFER_DONE, t[3])
         for t in transfers] or [],
        "Id string, ProductId long, SourceWarehouseId string, TargetWarehouseId string, CompletedOnUtc timestamp_ntz, "
        "TransferJobStatus string, TransferType string")
    return Erp(orders=orders, order_lines=lines, products=products, warehouses=warehouses,
               purchase_orders=purchase_orders, purchase_order_lines=po_lines, containers=containers, transfers=tr)


def write_channel(root: str, channel: str, files: dict[str, str]) -> None:
    import os
    os.makedirs(f"{root}/{channel}", exist_ok=True)
    for name, text in files.items():
        with open(f"{root}/{channel}/{name}", "w", encoding="utf-8") as fh:
            fh.write(text)


# the shipped sample channel (values as stated in FIXTURES.md)
F1_FILES = {
    "stock.csv": "Sku,Name,ProductFamily,PriceRadarVolume,IsDiscontinued,SouthIslandStock,NorthIslandStock\n"
                 "SKU001,Product A,FamilyX,0.01,0,10,5\nSKU002,Product B,FamilyY,0.02,0,20,15\n",
    "PO.csv": "Sku,Region,QuantityOrdered,CheckinDate\nSKU001,北岛,3,\n",
    "Sales 8-30.csv": "Sku,Region,AvgDailyDemand_3Checkins_Avg\nSKU001,北岛,1.0\nSKU002,南岛,0.5\n",
    "Sales 15.csv": "Sku,Region,AvgDailyDemand_3Checkins_Avg\nSKU001,北岛,1.0\nSKU002,南岛,0.5\n",
    "Sales 30.csv": "Sku,Region,AvgDailyDemand_3Checkins_Avg\nSKU001,北岛,1.0\nSKU002,南岛,0.5\n",
}
