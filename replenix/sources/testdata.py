"""Adapter: the shared TPC-H-like test tables seen as the ERP and channel inputs.

There are no ERP tables in the test data, so this module derives them from
``part``, ``supplier``, ``orders`` and ``lineitem``.  Every derived table grows
with the inputs; nothing is sampled.  The same mapping is written in SQL for
the DuckDB oracle (``replenix.plans.oracle``) and the two must stay in step.

Mapping (``as_of`` = 2001-06-30):

* product: ``Id = p_partkey``; channel = ``'9' || lpad(brand number, 2, '0')``;
  ``Sku = channel || '-' || p_partkey``; name ``p_name``; family ``p_type``;
  unit volume ``p_size / 1000``.
* warehouse: one per supplier, named by ``s_nationkey`` so that south, north,
  unknown, padded and excluded names all occur; plus the two transfer-route
  warehouses.
* sales: ``lineitem`` rows with return flag ``R``, orders up to ``as_of``;
  created = ``o_orderdate``; paid = created + 1 day when ``o_orderstatus = 'F'``.
* PO arrivals: return flag ``N``; one container per line, arriving at
  ``l_shipdate`` when that is not after ``as_of``; port by supplier nation.
* transfers: return flag ``A``; completed when shipped by ``as_of``;
  type null / ``Order`` / ``Move`` by discount.
* open purchase orders (PO.csv): all ``N`` lines with check-in text and
  container text including the empty tokens.
* stock (stock.csv): one row per part.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .erp import Erp

AS_OF = "2001-06-30"
SALES_FROM = "1996-01-01"
SALES_TO = K.SALES_TO

ROUTE_SOURCE_ID = "ffffffff-0000-4000-8000-000000000001"
ROUTE_TARGET_ID = "ffffffff-0000-4000-8000-000000000002"
OTHER_PORT_PREFIX = "bbbbbbbb-0000-4000-8000-"

# Warehouse name of a supplier, by its nation key (others keep the supplier name,
# which is unknown and so counts as north).
WAREHOUSE_BY_NATION = {
    0: "CHCH Gerald Connelly", 1: "Hamilton Te Rapa", 2: " GC ", 3: "Walls Road", 4: "CHCH Display",
    5: "treffers", 6: "Carbine Rd Warehouse", 7: "CHCH Treffers", 8: "Presale-AKL", 9: "Leonard Warehouse",
}
SOUTH_PORT_NATIONS = (0, 2, 5, 7, 11, 13)
NORTH_PORT_NATIONS = (1, 3, 6, 9, 12, 14)

# Channel settings used with the test data (a settings document, as a user writes it).
SETTINGS_DOCUMENT = {
    "_说明": "test settings",
    "default": {"LeadTime": 90, "LogisticsTime": 30, "备注": "default"},
    "channels": {
        "905": {"LeadTime": 120, "LogisticsTime": 45, "备注": "slow supplier"},
        "910": {"LeadTime": 60, "LogisticsTime": 20},
        "917": {"LeadTime": "100"},
        "920": {"LeadTime": "x", "LogisticsTime": None},
        "923": {"LeadTime": 75.9, "LogisticsTime": True},
        "_template": {"LeadTime": 1},
    },
}


def settings_json() -> str:
    return json.dumps(SETTINGS_DOCUMENT, ensure_ascii=False)


def _guid(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 12, "0"))


def supplier_guid(key: Column) -> Column:
    return _guid("aaaaaaaa-0000-4000-8000-", key)


def channel_of_brand(brand: Column) -> Column:
    return F.concat(F.lit("9"), F.lpad(F.substring(brand, 7, 10), 2, "0"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _memo(fn):
    """Build each derived table once per adapter (the DataFrame is only a plan)."""
    name = fn.__name__

    def wrapper(self):
        if name not in self._memo:
            self._memo[name] = fn(self)
        return self._memo[name]
    wrapper.__name__ = name
    wrapper.__doc__ = fn.__doc__
    return wrapper


class TpchAdapter:
    """Lazily derived ERP and channel inputs over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.as_of = as_of
        self._as_of = F.lit(as_of).cast("date")
        self._tables: dict[str, DataFrame] = {}
        self._memo: dict[str, object] = {}

    def t(self, name: str) -> DataFrame:
        # one scan definition per table: the schema is read once per adapter
        if name not in self._tables:
            self._tables[name] = load(self.spark, self.sf_dir, name)
        return self._tables[name]

    # ---- dimensions ---------------------------------------------------------
    @_memo
    def products(self) -> DataFrame:
        p = self.t("part")
        ch = channel_of_brand(F.col("p_brand"))
        return p.select(F.col("p_partkey").alias("Id"),
                        F.concat(ch, F.lit("-"), F.col("p_partkey").cast("string")).alias("Sku"))

    @_memo
    def warehouses(self) -> DataFrame:
        s = self.t("supplier")
        name = F.col("s_name")
        for nk in sorted(WAREHOUSE_BY_NATION, reverse=True):
            name = F.when(F.col("s_nationkey") == nk, F.lit(WAREHOUSE_BY_NATION[nk])).otherwise(name)
        suppliers = s.select(supplier_guid(F.col("s_suppkey")).alias("Id"), name.alias("Name"))
        # a VALUES relation carries size statistics, so the planner can broadcast it
        route = self.spark.sql(
            f"SELECT * FROM VALUES ('{ROUTE_SOURCE_ID}', '{K.TRANSFER_SOURCE}'), "
            f"('{ROUTE_TARGET_ID}', '{K.TRANSFER_TARGET}') AS t(Id, Name)")
        return suppliers.unionByName(route)

    @_memo
    def port_of_supplier(self) -> DataFrame:
        s = self.t("supplier")
        nk = F.col("s_nationkey")
        port = (F.when(nk.isin(*SOUTH_PORT_NATIONS), F.lit(K.SOUTH_PORT_ID))
                .when(nk.isin(*NORTH_PORT_NATIONS), F.lit(K.NORTH_PORT_ID))
                .otherwise(_guid(OTHER_PORT_PREFIX, nk)))
        return s.select(F.col("s_suppkey").alias("l_suppkey"), port.alias("ShippedtoportId"))

    # ---- sales ------------------------------------------------------------
    @_memo
    def orders(self) -> DataFrame:
        o = self.t("orders").filter(F.to_date("o_orderdate") <= self._as_of)
        paid = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
        return o.select(F.col("o_orderkey").alias("Id"), paid.alias("PaidDateUtc"),
                        F.col("o_orderdate").alias("DateCreatedUtc"))

    @_memo
    def order_lines(self) -> DataFrame:
        li = self.t("lineitem").filter(F.col("l_returnflag") == "R")
        g = supplier_guid(F.col("l_suppkey"))
        snap = (F.when(F.col("l_tax") == 0.08, F.lit("n/a"))
                .when(F.col("l_discount") == 0.1, F.lit("[]"))
                .when(F.col("l_discount") == 0.0, F.concat(F.lit('[{"WarehouseId":"'), F.upper(g), F.lit('"}]')))
                .otherwise(F.concat(F.lit('[{"WarehouseId":"'), g, F.lit('"}]'))))
        return li.select(F.col("l_orderkey").alias("OrderId"), F.col("l_partkey").alias("ProductId"),
                         F.col("l_quantity").alias("Quantity"), snap.alias("StockSnapshotJson"))

    def odd_snapshots(self) -> DataFrame:
        """(kind, x): stock snapshots of all lines as a line system may leave them: whole,
        followed by something, twice, cut off, in other quotes, after a byte order mark, ..."""
        g = supplier_guid(F.col("l_suppkey"))
        one = F.concat(F.lit('{"WarehouseId":"'), g, F.lit('"}'))
        whole = F.concat(F.lit("["), one, F.lit("]"))
        kinds = (whole, F.concat(whole, F.lit(" x")), F.concat(whole, whole), F.concat(F.lit("["), one),
                 F.replace(whole, F.lit('"'), F.lit("'")), F.concat(F.lit("﻿"), whole), one, F.concat(F.lit(" \n"), whole, F.lit("\t")),
                 F.concat(F.lit('[{"Note":"it\'s [a] \\"b\\" {",'), F.substr(one, F.lit(2)), F.lit("]")),
                 F.concat(F.lit("["), one, F.lit(', {"WarehouseId":"other"}]')), F.concat(F.lit('"'), g, F.lit('"')), F.lit(None).cast("string"))
        kind = F.col("l_partkey") % len(kinds)
        x = F.lit(None).cast("string")
        for n, text in enumerate(kinds):
            x = F.when(kind == n, text).otherwise(x)
        return self.t("lineitem").select(kind.alias("kind"), x.alias("x"))

    # ---- restocks -----------------------------------------------------------
    def _po_lines_raw(self) -> DataFrame:
        return self.t("lineitem").filter(F.col("l_returnflag") == "N")

    @_memo
    def purchase_orders(self) -> DataFrame:
        return self.t("orders").select(F.col("o_orderkey").alias("Id"),
                                       F.concat(F.lit("PO"), F.col("o_orderkey").cast("string")).alias("PurchaseOrderCode"))

    @_memo
    def purchase_order_lines(self) -> DataFrame:
        return self._po_lines_raw().select(F.col("l_orderkey").alias("PurchaseOrderId"),
                                           F.col("l_partkey").alias("ProductId"))

    @staticmethod
    def _container_number() -> Column:
        return F.concat(F.lit("C"), F.col("l_orderkey").cast("string"), F.lit("-"),
                        F.col("l_linenumber").cast("string"))

    @_memo
    def containers(self) -> DataFrame:
        li = self._po_lines_raw().join(self.port_of_supplier(), "l_suppkey")
        arrival = F.when(F.to_date("l_shipdate") <= self._as_of, F.col("l_shipdate"))
        return li.select(F.col("l_orderkey").alias("PurchaseOrderId"), self._container_number().alias("ContainerNumber"),
                         "ShippedtoportId", arrival.alias("ActualArrivingDate"))

    @_memo
    def transfers(self) -> DataFrame:
        li = self.t("lineitem").filter(F.col("l_returnflag") == "A")
        done = F.to_date("l_shipdate") <= self._as_of
        ttype = (F.when(F.col("l_discount") == 0.0, F.lit(None).cast("string"))
                 .when(F.col("l_discount") >= 0.09, F.lit("Order"))
                 .otherwise(F.lit("Move")))
        return li.select(
            F.concat(F.lit("T"), F.col("l_orderkey").cast("string"), F.lit("-"),
                     F.col("l_linenumber").cast("string")).alias("Id"),
            F.col("l_partkey").alias("ProductId"),
            F.when(F.col("l_linestatus") == "F", F.lit(ROUTE_SOURCE_ID))
             .otherwise(supplier_guid(F.col("l_suppkey"))).alias("SourceWarehouseId"),
            F.when(F.col("l_linenumber") > 0, F.lit(ROUTE_TARGET_ID))
             .otherwise(supplier_guid(F.col("l_suppkey"))).alias("TargetWarehouseId"),
            F.when(done, F.col("l_shipdate")).alias("CompletedOnUtc"),
            F.when(done, F.lit(K.TRANSFER_DONE)).otherwise(F.lit("InProgress")).alias("TransferJobStatus"),
            ttype.alias("TransferType"))

    @_memo
    def erp(self) -> Erp:
        return Erp(orders=self.orders(), order_lines=self.order_lines(), products=self.products(),
                   warehouses=self.warehouses(), purchase_orders=self.purchase_orders(),
                   purchase_order_lines=self.purchase_order_lines(), containers=self.containers(),
                   transfers=self.transfers())

    # ---- channel inputs (what stock.csv / PO.csv hold) ------------------------
    @_memo
    def stock_wide(self) -> DataFrame:
        """Columns of ``stock.csv``, one row per part."""
        p = self.t("part")
        ch = channel_of_brand(F.col("p_brand"))
        sku = F.concat(ch, F.lit("-"), F.col("p_partkey").cast("string"))
        disc = F.when(F.col("p_size") == 50, F.lit("1")).when(F.col("p_size") == 49, F.lit("2")).otherwise(F.lit("0"))
        return p.select(
            ch.alias("channel"), sku.alias("Sku"), F.col("p_name").alias("Name"), F.col("p_type").alias("ProductFamily"),
            (F.col("p_size") / 1000.0).cast("string").alias("PriceRadarVolume"), disc.alias("IsDiscontinued"),
            (F.col("p_size") - 20).cast("string").alias("SouthIslandStock"),
            (F.floor(F.col("p_retailprice") / 100) - 12).cast("string").alias("NorthIslandStock"),
            F.concat(F.lit("img\\"), F.col("p_type"), F.lit("/"), F.col("p_name"), F.lit(" #"),
                     F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("ImagePath"))

    @_memo
    def po_file(self) -> DataFrame:
        """Columns of ``PO.csv`` over all purchase-order lines (open and checked in)."""
        li = self._po_lines_raw().join(self.port_of_supplier(), "l_suppkey")
        prod = self.products().withColumnRenamed("Id", "l_partkey")
        li = li.join(prod, "l_partkey")
        shipped = F.to_date("l_shipdate")
        checkin = (F.when(shipped <= self._as_of, F.date_format(shipped, "yyyy-MM-dd"))
                   .when(F.col("l_discount") < 0.02, F.lit("NaT"))
                   .otherwise(F.lit("")))
        container = (F.when(F.col("l_tax") < 0.02, F.lit(""))
                     .when(F.col("l_tax") == 0.02, F.lit("nan"))
                     .otherwise(self._container_number()))
        from ..functions.scalar import channel_of, region_of_port
        return li.select(channel_of(F.col("Sku")).alias("channel"), "Sku",
                         region_of_port(F.col("ShippedtoportId")).alias("Region"),
                         F.col("l_quantity").cast("string").alias("QuantityOrdered"),
                         checkin.alias("CheckinDate"), container.alias("ContainerNumber"))

    @_memo
    def channels(self) -> DataFrame:
        return self.t("part").select(channel_of_brand(F.col("p_brand")).alias("channel")).distinct()
