"""Sinks: report (K1), summary (K2), archive (K3), run log (K4) and the
replace-by-channel accumulate step (H3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar as S

# FIXED VALUES: report columns in export order with their headings.
REPORT_COLUMNS = (
    ("channel", "渠道"), ("sku", "SKU"), ("name", "Name"), ("product_family", "ProductFamily"), ("region", "地区"),
    ("on_hand", "在库库存"), ("in_transit", "在途库存"), ("in_production", "在产库存"), ("total_stock", "总量库存"),
    ("demand_8_30", "8-30天日均"), ("demand_15", "15天日均"), ("demand_30", "30天日均"),
    ("daily_demand", "采用日均需求"), ("demand_source", "需求来源"), ("lead_time_need", "LeadTime周期需求"),
    ("logistics_need", "物流周期需求"), ("decision", "决策建议"), ("order_qty", "建议订货量"),
    ("unit_volume", "体积系数"), ("order_volume", "备货体积(m³)"), ("expedite_qty", "催发货数量"),
    ("expedite_volume", "催发货体积(m³)"), ("image_url", "ImageUrl"), ("explanation", "详细说明"),
)
# FIXED VALUES: container status words (bookable / not full).
BOOKABLE, NOT_FULL = "可订柜", "未满柜"


def report(df: DataFrame, headings: bool = True) -> DataFrame:
    """K1: the 24 report columns in order; decisions as labels."""
    cols = []
    for c, h in REPORT_COLUMNS:
        e = S.decision_label(c) if c == "decision" else F.col(c)
        cols.append(e.alias(h if headings else c))
    return df.select(*cols)


def report_summary(df: DataFrame, threshold: float = K.CONTAINER_THRESHOLD, by_channel: bool = True) -> DataFrame:
    """K2: order and expedite volumes (total / north / south) and the container
    status text, per channel (or over all channels)."""
    keys = ["channel"] if by_channel else []
    g = df.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(_cond(d, r), F.col(v))), F.lit(0.0)).alias(a) for d, r, v, a in _SUMMARY])
    t = float(threshold)
    status = F.concat(F.lit(f"{K.NORTH}:"), F.when(F.col("north_order_volume") >= t, BOOKABLE).otherwise(NOT_FULL),
                      F.lit(f", {K.SOUTH}:"), F.when(F.col("south_order_volume") >= t, BOOKABLE).otherwise(NOT_FULL))
    return g.withColumn("container_status", status)


_SUMMARY = (
    (K.ORDER, None, "order_volume", "order_volume"), (K.ORDER, K.NORTH, "order_volume", "north_order_volume"),
    (K.ORDER, K.SOUTH, "order_volume", "south_order_volume"), (K.EXPEDITE, None, "expedite_volume", "expedite_volume"),
    (K.EXPEDITE, K.NORTH, "expedite_volume", "north_expedite_volume"),
    (K.EXPEDITE, K.SOUTH, "expedite_volume", "south_expedite_volume"),
)


def _cond(decision, region):
    c = F.col("decision") == decision
    return c if region is None else c & (F.col("region") == region)


def run_log_rows(df: DataFrame, run_ts: str) -> DataFrame:
    """K4: one log row per channel: rows, order rows, north/south order volume, archive id."""
    return df.groupBy("channel").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("decision") == K.ORDER, 1)).alias("order_rows"),
        F.coalesce(F.sum(F.when(_cond(K.ORDER, K.NORTH), F.col("order_volume"))), F.lit(0.0)).alias("north_volume"),
        F.coalesce(F.sum(F.when(_cond(K.ORDER, K.SOUTH), F.col("order_volume"))), F.lit(0.0)).alias("south_volume"),
    ).withColumn("archive", F.lit(run_ts))


def append_run_log(df: DataFrame, path: str, run_ts: str) -> None:
    """One folder per run stamp or batch, so a retried one replaces its own rows."""
    (run_log_rows(df, run_ts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("archive").parquet(path))


def archive(df: DataFrame, path: str, run_ts: str, fmt: str = "parquet") -> None:
    """K3: one folder per channel and run stamp (yyyyMMdd_HHmm); re-running a
    stamp replaces only that stamp's partitions (dynamic overwrite)."""
    (df.withColumn("run_ts", F.lit(run_ts)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("channel", "run_ts").format(fmt).save(path))


def replace_channels(old: DataFrame, new: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """H3: the accumulated result with ``channels`` replaced by what ``new`` has of them
    (nothing, if the new result is empty).  Without the list, the channels of ``new``."""
    if channels is not None:
        return old.filter(~F.coalesce(F.col("channel").isin(*channels), F.lit(False))).unionByName(new)
    keep = old.join(new.select("channel").distinct(), "channel", "left_anti")
    return keep.unionByName(new)


def write_decisions(df: DataFrame, path: str, channels: Sequence[str] = ()) -> None:
    """H3 as plain partition folders, for readers that know no manifest: dynamic overwrite
    of the channel partitions present in ``df``; other channels stay.  What is left of
    ``channels`` after the write (their new result is empty) goes then, so a failed write
    loses nothing.  A retried batch ends alike.  ``snapshots.commit`` is the table whose
    channels change in one step."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folders = [jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/channel={escape(c)}") for c in channels]
    before = [(fs, s.getPath()) for p in folders for fs in [p.getFileSystem(conf)] if fs.exists(p) for s in fs.listStatus(p)]
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("channel").parquet(path))
    for fs, old in before:
        fs.delete(old, True)
