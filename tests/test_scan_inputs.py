"""Channel files as they come, the gate before the analysis, and repeated scans."""

import glob
import json
import os

from pyspark.sql import functions as F

from helpers import F1_FILES, write_channel
from replenix import constants as K
from replenix.operators import quality as QC
from replenix.operators import purchase as PU
from replenix.operators import stock as ST
from replenix.operators import views as V
from replenix.operators.util import broadcast_if_small, plan_size_bytes
from replenix.sinks import snapshots as SN
from replenix.sinks import writers as WR
from replenix.sources import channel_files as CF
from replenix.sources.settings import read_settings, settings_from_text
from replenix.streaming import scan as SC


def test_csv_cells(spark, tmp_dir):
    head = "Sku,Name,PriceRadarVolume,IsDiscontinued,SouthIslandStock,NorthIslandStock\n"
    write_channel(tmp_dir, "my ch+1%", {"stock.csv": head + '001,"Table 24"" oak, round",0.5,0,3,12f\nNA,x,1,0,1,1\nB,"two\nlines",nan,0,inf,1\n'})
    rows = {(r.sku, r.region): r for r in ST.stock_long(CF.read_stock(spark, tmp_dir)).collect()}
    assert set(rows) == {(s, r) for s in ("001", "B") for r in (K.NORTH, K.SOUTH)}
    south = rows["001", K.SOUTH]
    assert (south.channel, south.name, south.unit_volume, south.on_hand) == ("my ch+1%", 'Table 24" oak, round', 0.5, 3.0)
    assert rows["001", K.NORTH].on_hand == 0.0 and rows["B", K.SOUTH].on_hand == 0.0 and rows["B", K.SOUTH].name == "two\nlines"


def test_nan_quantity_and_first_row(spark, tmp_dir):
    write_channel(tmp_dir, "918", {"PO.csv": "Sku,Region,QuantityOrdered,CheckinDate\nA,南岛,nan,\nA,南岛,2,\n",
                                   "Sales 8-30.csv": "Sku,Region,AvgDailyDemand_3Checkins_Avg,SampleDays\nA,南岛,nan,1\nB,南岛,1,2\nB,南岛,9,2\n",
                                   "Sales 15.csv": "Sku,Region,AvgDailyDemand_3Checkins_Avg\n",
                                   "Sales 30.csv": "Sku,Region,AvgDailyDemand_3Checkins_Avg\nA,南岛,nan\nB,南岛,1\n"})
    (r,) = PU.open_po(CF.read_po(spark, tmp_dir)).collect()
    assert r.in_transit == 2.0
    demand = CF.read_demand(spark, tmp_dir)
    (s,) = QC.same_demand_status(demand).collect()
    assert (s.common_keys, s.equal_keys, s.warn) == (2, 1, False)  # nan is not equal to nan; B by its first row
    assert QC.same_diagnostics_status(demand).collect() == []  # only one of the files has the columns


def test_gate(spark, tmp_dir):
    write_channel(tmp_dir, "918", F1_FILES)
    write_channel(tmp_dir, "no15", {k: v for k, v in F1_FILES.items() if k != "Sales 15.csv"})
    write_channel(tmp_dir, "nocol", {**F1_FILES, "stock.csv": "Sku,PriceRadarVolume,IsDiscontinued,NorthIslandStock\nA,1,0,1\n"})
    good, bad = CF.gate(spark, tmp_dir)
    assert good == ["918"]
    assert sorted(bad) == [("no15", "Sales 15.csv is missing"), ("nocol", "stock.csv lacks SouthIslandStock")]


def test_first_valid_settings(spark, tmp_dir):
    from replenix.sources.settings import LEGACY_FILES
    for name, text in zip(LEGACY_FILES, ("{broken", json.dumps({"LeadTime": 77})), strict=False):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(text)
    if len(LEGACY_FILES) > 1:
        assert [(r.entry, r.lead_time) for r in read_settings(spark, tmp_dir).collect()] == [(None, 77)]


def land(spark, root, channel, on_hand):
    for kind, df in (
            ("stock", spark.createDataFrame([("A", "0.5", "0", str(on_hand), "0")], "Sku string, PriceRadarVolume string, IsDiscontinued string, SouthIslandStock string, NorthIslandStock string")),
            ("po", spark.createDataFrame([("A", K.SOUTH, "4", "", "C1")], "Sku string, Region string, QuantityOrdered string, CheckinDate string, ContainerNumber string")),
            ("demand", spark.createDataFrame([("A", K.SOUTH, "30", "1.0")], "sku string, region string, window string, value string"))):
        df.withColumn("channel", F.lit(channel)).write.mode("append").partitionBy("channel").option("header", True).csv(f"{root}/{kind}")


def scan(spark, tmp_dir, **how):
    SC.stream_scan(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck", lambda: settings_from_text(spark, "{}"),
                   available_now=True, log_path=f"{tmp_dir}/log", archive_path=f"{tmp_dir}/archive", **how).awaitTermination()
    return {(r.channel, r.sku, r.region): r for r in SN.read(spark, f"{tmp_dir}/out").collect()}


def test_second_landing_and_incomplete_channel(spark, tmp_dir):
    land(spark, f"{tmp_dir}/in", "c1", 60)
    spark.createDataFrame([("A", "1", "c2")], "Sku string, SouthIslandStock string, channel string").write.mode("append") \
        .partitionBy("channel").option("header", True).csv(f"{tmp_dir}/in/stock")
    assert {k[0] for k in scan(spark, tmp_dir)} == {"c1"}  # c2 lacks inputs: left out, the scan goes on
    land(spark, f"{tmp_dir}/in", "c1", 2)
    row = scan(spark, tmp_dir)["c1", "A", K.SOUTH]
    assert (row.on_hand, row.in_transit) == (2.0, 4.0)  # the new landing replaces the old one
    assert spark.read.parquet(f"{tmp_dir}/log").count() == 2
    assert len(glob.glob(f"{tmp_dir}/archive/channel=c1/run_ts=*")) == 2


def test_empty_result_clears_the_channel(spark, tmp_dir):
    rows = spark.createDataFrame([("a b", 1), ("c", 2)], "channel string, n int")
    WR.write_decisions(rows, f"{tmp_dir}/t", ["a b", "c"])
    WR.write_decisions(rows.limit(0), f"{tmp_dir}/t", ["a b"])
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_dir}/t").select("channel", "n").collect()] == [("c", 2)]
    assert WR.replace_channels(rows, rows.limit(0), ["c"]).collect()[0].channel == "a b"


def test_nothing_to_expedite(spark):
    empty = spark.createDataFrame([], "region string, decision string, expedite_volume double, expedite_qty double")
    assert sorted((str(r.region), r.expedite_volume) for r in V.expedite_totals(empty).collect()) == sorted([("None", 0.0), (K.NORTH, 0.0), (K.SOUTH, 0.0)])


def test_broadcast_hint_by_size(spark, tmp_dir):
    spark.range(1000).write.parquet(f"{tmp_dir}/small")
    df = spark.read.parquet(f"{tmp_dir}/small")
    assert plan_size_bytes(df) > 0
    hinted = lambda limit: "ResolvedHint" in broadcast_if_small(df, limit)._jdf.queryExecution().logical().toString() \
        or "UnresolvedHint" in broadcast_if_small(df, limit)._jdf.queryExecution().logical().toString()
    assert hinted(1 << 20) and not hinted(1)


def _erp_files(spark, path):
    """A parquet ERP with one warehouse of each kind."""
    from replenix.sources.erp import Erp
    wid = "aaaaaaaa-0000-4000-8000-00000000000{}"
    names = [K.SOUTH_WAREHOUSES[0], K.EXCLUDED_WAREHOUSES[0], "elsewhere"]
    tables = {
        "orders": ([(i, None if i % 2 else "2025-03-02", "2025-03-01" if i < 8 else "2020-01-01") for i in range(10)],
                   "Id long, PaidDateUtc string, DateCreatedUtc string"),
        "order_lines": ([(i, 1, 1.0, s) for i in range(10) for s in (
            *('[{"WarehouseId":"' + wid.format(k).upper() + '"}]' for k in range(4)), "n/a", "[]",
            '[{"WarehouseId":"' + wid.format(0) + '"}', '{"WarehouseId":"' + wid.format(0) + '"}', None)],
            "OrderId long, ProductId long, Quantity double, StockSnapshotJson string"),
        "products": ([(1, "918-1")], "Id long, Sku string"),
        "warehouses": ([(wid.format(k), n) for k, n in enumerate(names)], "Id string, Name string"),
    }
    out = {}
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        for c in ("PaidDateUtc", "DateCreatedUtc"):
            if c in df.columns:
                df = df.withColumn(c, F.col(c).cast("timestamp"))
        df.write.parquet(f"{path}/{name}")
        out[name] = spark.read.parquet(f"{path}/{name}")
    other = spark.range(0)
    return Erp(**out, purchase_orders=other, purchase_order_lines=other, containers=other, transfers=other)


def test_sales_plan_and_spread_join(spark, tmp_dir, monkeypatch):
    from replenix.operators import sales as SL
    erp = _erp_files(spark, tmp_dir)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # the whole list of pushed filters

    def result():
        got = SL.daily_sales(erp, ("paid", "created"), "2025-01-01", "2099-12-31")
        return got, sorted((r.policy, r.region, str(r.order_date), r.daily_qty) for r in got.collect())

    df, rows = result()
    # south and, for the unknown name, north; orders 8 (paid 2025) and 9 (unpaid, created 2020) by the paid date
    assert rows == [("created", r, "2025-03-01", 8.0) for r in sorted((K.NORTH, K.SOUTH))] + sorted(
        [("paid", r, d, n) for r in (K.NORTH, K.SOUTH) for d, n in (("2025-03-01", 4.0), ("2025-03-02", 5.0))])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "StockSnapshotJson" in x]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = [x.split("PushedFilters:")[1] for x in plan.splitlines() if "FileScan" in x and "DateCreatedUtc" in x]
    assert pushed and all("GreaterThanOrEqual(PaidDateUtc" in x and "GreaterThanOrEqual(DateCreatedUtc" in x for x in pushed)
    monkeypatch.setattr(SL, "BROADCAST_LIMIT_BYTES", -1)
    assert result()[1] == rows
    left = SL.reconcile_sales(erp, "2025-01-01", "2025-12-31").collect()
    assert sorted((r.region, r.total_qty) for r in left) == sorted([(K.NORTH, 64.0), (K.SOUTH, 8.0)])


def test_views_by_channel(spark):
    rows = [("a", "s1", K.NORTH, K.ORDER, 5.0, 1.0, 10.0, 70.0, 0.0, 0.0), ("b", "s1", K.NORTH, K.ORDER, 3.0, 1.0, 9.0, 1.0, 0.0, 0.0),
            ("b", "s2", K.SOUTH, K.EXPEDITE, 2.0, 1.0, 0.0, 0.0, 4.0, 2.0), ("b", "s3", K.SOUTH, K.HOLD, 2.0, 1.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "channel string, sku string, region string, decision string, total_stock double, daily_demand double, "
                                     "order_qty double, order_volume double, expedite_qty double, expedite_volume double")
    assert {(r.channel, r.sku) for r in V.top_urgent(df, 1, by_channel=True).collect()} == {("a", "s1"), ("b", "s2")}
    assert {(r.channel, r.decision): round(r.percent, 3) for r in V.decision_distribution(df, by_channel=True).collect()} == {
        ("a", K.ORDER): 100.0, ("b", K.ORDER): 33.333, ("b", K.EXPEDITE): 33.333, ("b", K.HOLD): 33.333}
    assert {(r.channel, r.region): r.bookable for r in V.region_totals(df, by_channel=True).collect()} == {
        ("a", K.NORTH): True, ("a", K.SOUTH): False, ("b", K.NORTH): False, ("b", K.SOUTH): False}
    assert {r.channel: (r.rows, r.order_rows) for r in V.run_summary(df, by_channel=True).collect()} == {"a": (1, 1), "b": (3, 1)}
    assert V.run_summary(df.limit(0)).collect()[0].rows == 0


def test_headers_by_csv_rules(spark, tmp_dir):
    stock = '\ufeff"Sku","Name, long","Price ""Radar"" `x`","PriceRadarVolume","IsDiscontinued",SouthIslandStock,"NorthIslandStock"\nA,"n, m",1,0.5,0,3,4\n'
    write_channel(tmp_dir, "a", F1_FILES | {"stock.csv": stock, "note.txt": "x"})
    write_channel(tmp_dir, "b c", F1_FILES)
    write_channel(tmp_dir, "d", F1_FILES | {"PO.csv": '"Sku,Region",QuantityOrdered,CheckinDate\n', "Sales 15.csv": ""})
    os.remove(f"{tmp_dir}/d/Sales 30.csv")
    rows = {(r.channel, r.file): r.header for r in CF.channel_inputs(spark, tmp_dir).collect()}
    assert rows["a", "stock.csv"][:3] == ["Sku", "Name, long", 'Price "Radar" `x`'] and rows["a", "note.txt"] is None and len(rows) == 15
    good, bad = CF.gate(spark, tmp_dir)
    assert good == ["a", "b c"]
    assert bad == [("d", "PO.csv lacks Sku, Region"), ("d", "Sales 15.csv lacks Sku, Region, AvgDailyDemand_3Checkins_Avg"), ("d", "Sales 30.csv is missing")]
    wide = {r.channel: r for r in CF.read_stock(spark, tmp_dir, ["a", "b c"]).collect() if r.Sku in ("A", "SKU001")}
    assert (wide["a"]["Name, long"], wide["a"]['Price "Radar" `x`'], wide["a"].SouthIslandStock) == ("n, m", "1", "3")
    assert wide["b c"].Name == "Product A" and wide["b c"]["Name, long"] is None
    assert CF.channel_inputs(spark, f"{tmp_dir}/none").count() == 0 and CF.gate(spark, f"file:{tmp_dir}", ["a", "x"])[0] == ["a"]


def test_many_channels_pass_the_gate_in_one_job(spark, tmp_dir):
    for i in range(300):
        write_channel(tmp_dir, f"c{i:03}", {k: "Sku\n" if i == 7 and k == "PO.csv" else v for k, v in F1_FILES.items()})
    tracker, before = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    assert CF.channel_inputs(spark, tmp_dir).count() == 1500
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before <= 3 and tracker
    good, bad = CF.gate(spark, tmp_dir)
    assert len(good) == 299 and bad == [("c007", "PO.csv lacks Region, QuantityOrdered, CheckinDate")]


def test_headers_where_only_hadoop_opens_files(spark, tmp_dir, monkeypatch):
    write_channel(tmp_dir, "a", F1_FILES)
    want = sorted(map(str, CF.channel_inputs(spark, tmp_dir).collect()))
    monkeypatch.setattr(CF, "_arrow_opens", lambda root: False)
    assert sorted(map(str, CF.channel_inputs(spark, tmp_dir).collect())) == want
