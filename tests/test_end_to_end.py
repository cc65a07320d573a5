"""Oracle parity on the shared test tables, the driver entry, and the streaming scan."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from replenix.operators.settings_ops import effective_settings
from replenix.plans import replenishment as RP
from replenix.sinks import snapshots as SN
from replenix.sources import channel_files as CF
from replenix.sources.settings import read_settings
from replenix.streaming import scan as SC

from helpers import F1_FILES, write_channel

SF = "/root/testdata/sf0.001"
TABLES = ("part", "supplier", "orders", "lineitem", "nation", "region")
PARITY = ("daily_sales", "restock_events", "window_8_30", "window_15", "window_30", "window_diagnostic", "explanations",
          "reconcile_sales", "stock_long", "open_po", "decisions", "container_check", "top_urgent",
          "family_filter_fallback", "settings_effective", "quality_same_demand", "snapshot_json", "input_gate", "rescan_rewritten",
          "demand_order", "quality_report")


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def v(x):
        return repr(round(x, 9)) if isinstance(x, float) else str(x)
    return sorted(tuple(v(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", PARITY)
def test_oracle_parity(spark, duck, name):
    df = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(res.fetchall(), ocols)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "decision" in df.columns


def test_stream_scan_channel_folders(spark, tmp_dir):
    root = f"{tmp_dir}/channels"
    write_channel(root, "918", F1_FILES)
    write_channel(root, "919", {k: v.replace("SKU00", "X") for k, v in F1_FILES.items()})
    settings = read_settings(spark, root)
    q = SC.stream_scan(spark, root, f"{tmp_dir}/out", f"{tmp_dir}/ckpt", settings, layout="channel_folders",
                       available_now=True, log_path=f"{tmp_dir}/log")
    q.awaitTermination()
    out = SN.read(spark, f"{tmp_dir}/out")
    chans = CF.list_channels(spark, root)
    batch = RP.replenishment(CF.read_stock(spark, root), CF.read_po(spark, root),
                             CF.demand_long(CF.read_demand(spark, root)),
                             effective_settings(spark.createDataFrame([(c,) for c in chans], "channel string"),
                                                settings))
    cols = ["channel", "sku", "region", "decision", "order_qty"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    assert spark.read.parquet(f"{tmp_dir}/log").count() == 2
