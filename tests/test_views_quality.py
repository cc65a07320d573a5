"""Views and aggregates (C10-C13, G2, G4, E7-E15, F7) and quality checks."""

import pytest
from pyspark.sql import functions as F

from replenix import constants as K
from replenix.operators import quality as QC
from replenix.operators import views as V
from replenix.sinks import writers as WR

SCHEMA = ("channel string, sku string, region string, product_family string, name string, decision string, "
          "order_volume double, expedite_qty double, expedite_volume double, order_qty double, "
          "total_stock double, daily_demand double")


@pytest.fixture()
def result(spark):
    rows = [("918", "A", K.NORTH, "Sofa", "Big sofa", K.ORDER, 40.0, 0.0, 0.0, 4.0, 1.0, 1.0),
            ("918", "B", K.NORTH, "Sofa Bed", "Bed", K.ORDER, 30.0, 0.0, 0.0, 3.0, 5.0, 1.0),
            ("918", "C", K.SOUTH, "Table", "Sofa side table", K.EXPEDITE, 0.0, 2.0, 1.5, 0.0, 2.0, 0.0),
            ("996", "D", K.SOUTH, "Chair", "Chair", K.HOLD, 0.0, 0.0, 0.0, 0.0, 9.0, 1.0)]
    return spark.createDataFrame(rows, SCHEMA)


def skus(df):
    return sorted(r.sku for r in df.collect())


def test_f7_family_tiers(spark, result):
    assert skus(V.search_family(result, "sofa")) == ["A"]
    assert skus(V.search_family(result, "sof")) == ["A", "B"]
    assert skus(V.search_family(result, "side", region=K.SOUTH)) == ["C"]
    assert skus(V.search_family(result, "zzz", K.NORTH, "下单备货")) == []
    assert skus(V.search_family(result, K.ALL_CHOICE)) == ["A", "B", "C", "D"]
    assert skus(V.search_family(result, "bed", region=K.SOUTH)) == ["B"]  # tier 3 leaves the view
    assert skus(V.search_family(result, "sofa.", literal=True)) == []


def test_container_and_totals(spark, result):
    cc = {r.channel: r for r in V.container_check(result).collect()}
    assert cc["918"].north_order_volume == 70.0 and cc["918"].north_bookable and cc["918"].north_gap == -1.0
    tot = {r.region: r for r in V.region_totals(result).collect()}
    assert tot[K.NORTH].bookable and not tot[K.SOUTH].bookable and tot[K.SOUTH].order_volume == 0.0
    ex = {r.region: r.expedite_volume for r in V.expedite_totals(result).collect()}
    assert ex == {K.NORTH: 0.0, K.SOUTH: 1.5, None: 1.5}
    dist = {r.decision: r.percent for r in V.decision_distribution(result).collect()}
    assert dist[K.ORDER] == 50.0
    s = V.run_summary(result).collect()[0]
    assert (s.rows, s.order_rows, s.order_volume, s.south_expedite_volume) == (4, 2, 70.0, 1.5)
    summ = {r.channel: r.container_status for r in WR.report_summary(result).collect()}
    assert summ["918"] == f"{K.NORTH}:可订柜, {K.SOUTH}:未满柜"
    info = V.accumulated_info(result).collect()[0]
    assert info.rows == 4 and info.channels == ["918", "996"]


def test_top_urgent_and_sort(spark, result):
    top = V.top_urgent(result.withColumn("total_stock", F.col("total_stock")), 2).collect()
    assert [r.sku for r in top] == ["A", "B"]
    srt = V.sort_view(result, "total_stock", False, "total_stock", True).collect()
    assert [r.sku for r in srt] == ["D", "B", "C", "A"]


def test_replace_channels(spark, result):
    new = result.filter(F.col("channel") == "996").withColumn("decision", F.lit(K.ORDER))
    out = WR.replace_channels(result, new)
    assert out.count() == 4 and out.filter(F.col("channel") == "996").first().decision == K.ORDER


def _demand(spark, rows):
    return spark.createDataFrame(rows, "channel string, Sku string, Region string, window string, WindowType string, "
                                       "AvgDailyDemand_3Checkins_Avg string")


def test_window_type_check(spark):
    dem = _demand(spark, [("918", "A", K.NORTH, "8-30", "8-30", "1"), ("918", "A", K.NORTH, "15", "8-30", "1"),
                          ("918", "A", K.NORTH, "30", None, "1")])
    warn = {(r.channel, r.window): r.warn for r in QC.window_type_status(dem).collect()}
    assert warn == {("918", "8-30"): False, ("918", "15"): True, ("918", "30"): True}  # null reads as 'nan'


def test_same_demand_check(spark):
    same = _demand(spark, [("918", "A", K.NORTH, "8-30", None, "1.0000001"), ("918", "A", K.NORTH, "30", None, "1.0"),
                           ("996", "A", K.NORTH, "8-30", None, "1"), ("996", "A", K.NORTH, "30", None, "2"),
                           ("997", "A", K.NORTH, "8-30", None, "1")])
    st = {r.channel: r.warn for r in QC.same_demand_status(same).collect()}
    assert st == {"918": True, "996": False}
    rep = QC.quality_report(same.drop("WindowType")).collect()
    assert [(r.channel, r.check) for r in rep] == [("918", "same_demand")]


def test_view_and_totals(spark, result):
    v = V.view(result, region=K.NORTH, family="sof", primary="总量库存", ascending=False)
    assert [r.sku for r in v.collect()] == ["B", "A"]
    t = V.totals(result).collect()[0]
    assert (t.rows, t.order_rows, t.north_order_volume, t.north_bookable) == (4, 2, 70.0, True)


def test_same_demand_reads_the_files_once(spark, tmp_dir):
    rows = [("903", "a", "x", "8-30", "1.0"), ("903", "a", "x", "30", "1.0000001"), ("903", "b", "x", "8-30", None), ("903", "b", "x", "30", None),
            ("904", "a", "x", "8-30", "2"), ("904", "a", "y", "30", "2"), ("905", "a", None, "8-30", "2"), ("905", "a", None, "30", "2")]
    spark.createDataFrame(rows, "channel string, Sku string, Region string, window string, AvgDailyDemand_3Checkins_Avg string").write.parquet(f"{tmp_dir}/d")
    got = QC.same_demand_status(spark.read.parquet(f"{tmp_dir}/d"))
    assert [tuple(r) for r in got.collect()] == [("903", 2, 1, False)]
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("relation [") == 1


def test_results_written_or_checked_several_times_are_made_once(spark, monkeypatch):
    """The decisions that the archive writes, and the demand that the checks and the gate
    read, are materialised: what is computed from them scans no input again."""
    from replenix.plans import catalog as C
    from replenix.sinks import writers as WR
    scans = []
    monkeypatch.setattr(C.WR, "archive", lambda df, *a, fn=WR.archive: (scans.append(df), fn(df, *a))[1])
    monkeypatch.setattr(C.QC, "quality_report", lambda df, fn=QC.quality_report: (scans.append(df), fn(df))[1])
    for name in ("archive_stamps", "quality_report"):
        C.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert len(scans) == 4
    for df in scans:
        assert "parquet" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
