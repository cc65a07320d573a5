"""Sinks (K1-K4, H3 as a table write) and the parquet ERP reader (A5)."""

from pyspark.sql import functions as F

from replenix import constants as K
from replenix.operators import windows as W
from replenix.sinks import writers as WR
from replenix.sources.erp import ERP_COLUMNS, read_erp_parquet

from helpers import NORTH_WH, make_erp

SCHEMA = ("channel string, sku string, region string, decision string, order_volume double, "
          "expedite_volume double")


def _result(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_archive_and_run_log(spark, tmp_dir):
    a = _result(spark, [("918", "A", K.NORTH, K.ORDER, 1.5, 0.0), ("996", "B", K.SOUTH, K.HOLD, 0.0, 0.0)])
    WR.archive(a, f"{tmp_dir}/arch", "20260701_0800")
    WR.archive(a.filter(F.col("channel") == "918").withColumn("order_volume", F.lit(2.5)),
               f"{tmp_dir}/arch", "20260701_0800")  # rewrite of one channel's run stamp
    WR.archive(a, f"{tmp_dir}/arch", "20260701_0900")
    got = spark.read.parquet(f"{tmp_dir}/arch").withColumn("channel", F.col("channel").cast("string"))
    rows = {(r.channel, r.run_ts): r.order_volume for r in got.collect()}
    assert rows == {("918", "20260701_0800"): 2.5, ("996", "20260701_0800"): 0.0,
                    ("918", "20260701_0900"): 1.5, ("996", "20260701_0900"): 0.0}
    WR.append_run_log(a, f"{tmp_dir}/log", "20260701_0800")
    WR.append_run_log(a, f"{tmp_dir}/log", "20260701_0900")
    log = spark.read.parquet(f"{tmp_dir}/log")
    assert log.count() == 4
    assert {r.archive for r in log.filter(F.col("channel") == "918").collect()} == {"20260701_0800", "20260701_0900"}


def test_write_decisions_replaces_only_given_channels(spark, tmp_dir):
    path = f"{tmp_dir}/dec"
    WR.write_decisions(_result(spark, [("918", "A", K.NORTH, K.ORDER, 1.0, 0.0),
                                       ("996", "B", K.SOUTH, K.HOLD, 0.0, 0.0)]), path)
    new = _result(spark, [("918", "A", K.NORTH, K.HOLD, 0.0, 0.0)])
    WR.write_decisions(new, path)
    WR.write_decisions(new, path)  # a retried batch writes the same partition again
    got = {r.sku: r.decision for r in spark.read.parquet(path).collect()}
    assert got == {"A": K.HOLD, "B": K.HOLD}


def test_report_columns(spark):
    cols = [c for c, _ in WR.REPORT_COLUMNS]
    df = spark.range(1).select(*[F.lit(K.ORDER if c == "decision" else "x").alias(c) for c in cols])
    rep = WR.report(df)
    assert rep.columns == [h for _, h in WR.REPORT_COLUMNS]
    assert rep.collect()[0]["决策建议"] == K.DECISION_LABELS[K.ORDER]


def test_read_erp_parquet_roundtrip(spark, tmp_dir):
    erp = make_erp(spark, sales=[(1, "918-001", 2.0, "2026-07-12", None, NORTH_WH)],
                   arrivals=((1, "918-001", "C1", K.NORTH_PORT_ID, "2026-07-02"),))
    for name in ERP_COLUMNS:
        erp.table(name).write.parquet(f"{tmp_dir}/erp/{name}")
    back = read_erp_parquet(spark, f"{tmp_dir}/erp")
    a = W.window_report(erp, "8_30", "2026-09-01", "2025-01-01").collect()
    b = W.window_report(back, "8_30", "2026-09-01", "2025-01-01").collect()
    assert a == b and len(a) == 1 and a[0].sample_qty == 2.0
