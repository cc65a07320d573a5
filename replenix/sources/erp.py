"""ERP tables (A5): the eight relational inputs of the demand pipeline.

The engine only needs the columns below; any reader that yields them works
(parquet folders, JDBC, catalog tables).  Column names follow the ERP.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Columns each ERP table must provide.
ERP_COLUMNS = {
    "Orders": ("Id", "PaidDateUtc", "DateCreatedUtc"),
    "OrderLines": ("OrderId", "ProductId", "Quantity", "StockSnapshotJson"),
    "Products": ("Id", "Sku"),
    "Warehouses": ("Id", "Name"),
    "PurchaseOrders": ("Id", "PurchaseOrderCode"),
    "PurchaseOrderLines": ("PurchaseOrderId", "ProductId"),
    "Containers": ("PurchaseOrderId", "ContainerNumber", "ShippedtoportId", "ActualArrivingDate"),
    "Transfers": ("Id", "ProductId", "SourceWarehouseId", "TargetWarehouseId", "CompletedOnUtc",
                  "TransferJobStatus", "TransferType"),
}


@dataclass(frozen=True)
class Erp:
    orders: DataFrame
    order_lines: DataFrame
    products: DataFrame
    warehouses: DataFrame
    purchase_orders: DataFrame
    purchase_order_lines: DataFrame
    containers: DataFrame
    transfers: DataFrame

    def table(self, name: str) -> DataFrame:
        return getattr(self, _ATTR[name])


_ATTR = {
    "Orders": "orders", "OrderLines": "order_lines", "Products": "products", "Warehouses": "warehouses",
    "PurchaseOrders": "purchase_orders", "PurchaseOrderLines": "purchase_order_lines",
    "Containers": "containers", "Transfers": "transfers",
}


def erp_from_tables(tables: dict[str, DataFrame]) -> Erp:
    missing = [(t, c) for t, cols in ERP_COLUMNS.items() for c in cols if c not in tables[t].columns]
    if missing:
        raise ValueError(f"ERP tables miss columns: {missing}")
    return Erp(**{_ATTR[t]: tables[t].select(*ERP_COLUMNS[t]) for t in ERP_COLUMNS})


def read_erp_parquet(spark: SparkSession, root: str) -> Erp:
    """Eight parquet folders ``root/<Table>`` (only the used columns are read)."""
    return erp_from_tables({t: spark.read.parquet(f"{root}/{t}") for t in ERP_COLUMNS})


def read_erp_jdbc(spark: SparkSession, url: str, properties: dict, schema: str = "dbo",
                  partitioning: dict | None = None) -> Erp:
    """Eight JDBC tables.  ``partitioning`` maps a table to
    ``(column, lower, upper, num_partitions)`` so big tables are read in parallel."""
    partitioning = partitioning or {}
    tables = {}
    for t in ERP_COLUMNS:
        if t in partitioning:
            col, lo, hi, n = partitioning[t]
            tables[t] = spark.read.jdbc(url, f"{schema}.{t}", column=col, lowerBound=lo, upperBound=hi,
                                        numPartitions=n, properties=properties)
        else:
            tables[t] = spark.read.jdbc(url, f"{schema}.{t}", properties=properties)
    return erp_from_tables(tables)
