"""P2 decisions: golden sample channel (F1) and every decision branch (F2)."""

import pytest
from pyspark.sql import functions as F

from replenix import constants as K
from replenix.operators import decisions as D
from replenix.operators import views as V
from replenix.operators.settings_ops import effective_settings
from replenix.plans import replenishment as RP
from replenix.sources import channel_files as CF
from replenix.sources.settings import read_settings

from helpers import F1_FILES, write_channel


def f1_decisions(spark, root):
    write_channel(root, "918", F1_FILES)
    chans = CF.list_channels(spark, root)
    stock = CF.read_stock(spark, root, chans)
    po = CF.read_po(spark, root, chans)
    dem = CF.demand_long(CF.read_demand(spark, root, chans))
    eff = effective_settings(spark.createDataFrame([(c,) for c in chans], "channel string"), read_settings(spark, root))
    return RP.replenishment(stock, po, dem, eff)


def test_f1_golden(spark, tmp_dir):
    rows = {(r.sku, r.region): r for r in f1_decisions(spark, tmp_dir).collect()}
    assert len(rows) == 4
    a = rows[("SKU001", K.NORTH)]
    assert (a.on_hand, a.in_transit, a.total_stock, a.daily_demand, a.lead_time_need) == (5, 3, 8, 1.0, 90)
    assert a.decision == K.ORDER and a.order_qty == 82 and a.order_volume == pytest.approx(0.82)
    assert a.source_tag == "use_15" and a.channel == "918"
    assert a.explanation == "总库存8≤90天需求(90.0)，缺口82，体积0.8200m³，基于8-30天/15天/30天"
    b = rows[("SKU002", K.SOUTH)]
    assert (b.on_hand, b.total_stock, b.daily_demand, b.lead_time_need, b.decision, b.order_qty) == \
        (20, 20, 0.5, 45, K.ORDER, 25)
    assert b.order_volume == pytest.approx(0.5)
    assert b.explanation == "总库存20≤90天需求(45.0)，缺口25，体积0.5000m³，基于8-30天/15天/30天"
    c = rows[("SKU001", K.SOUTH)]
    assert c.decision == K.NO_SALES and c.order_qty == 0
    assert c.explanation == "无销售记录，当前库存: 现货10+在途0+在产0"
    assert rows[("SKU002", K.NORTH)].explanation == "无销售记录，当前库存: 现货15+在途0+在产0"


def test_f1_region_volumes(spark, tmp_dir):
    cc = V.container_check(f1_decisions(spark, tmp_dir)).collect()[0]
    assert cc.north_order_volume == pytest.approx(0.82) and cc.south_order_volume == pytest.approx(0.5)
    assert not cc.north_bookable and not cc.south_bookable


def _decide(spark, rows, lead=90, logistics=30):
    schema = ("channel string, sku string, region string, on_hand double, in_transit double, in_production double, "
              "unit_volume double, is_discontinued int, name string, product_family string, image_url string, "
              "demand_8_30 double, demand_15 double, demand_30 double")
    df = spark.createDataFrame([("918", f"S{i}", K.NORTH, *r) for i, r in enumerate(rows)], schema)
    st = spark.createDataFrame([("918", lead, logistics)], "channel string, lead_time int, logistics_time int")
    return [r.asDict() for r in D.decide(df, st).orderBy("sku").collect()]


def _row(on_hand, transit, production, daily, disc=0):
    return (float(on_hand), float(transit), float(production), 0.5, disc, "", "", "", float(daily), 0.0, 0.0)


def test_f2_branches(spark):
    out = _decide(spark, [_row(90, 0, 0, 1), _row(-5, 0, 0, 1), _row(10, 0, 100, 1), _row(30, 0, 100, 1),
                          _row(31, 0, 100, 1), _row(7, 1, 2, 0)])
    got = [(r["decision"], r["order_qty"], r["expedite_qty"]) for r in out]
    assert got == [(K.ORDER, 0, 0), (K.ORDER, 95, 0), (K.EXPEDITE, 0, 20), (K.EXPEDITE, 0, 0), (K.HOLD, 0, 0),
                   (K.NO_SALES, 0, 0)]
    assert out[2]["expedite_volume"] == 10
    assert out[4]["explanation"].endswith("可撑131天")
    assert [r["priority"] for r in out] == [0, 0, 1, 1, 2, 3]


def test_f2_nothing_to_expedite(spark):
    out = _decide(spark, [_row(20, 0, 0, 1)], lead=10, logistics=30)
    assert out[0]["decision"] == K.HOLD
    assert "无在产可催" in out[0]["explanation"]


@pytest.mark.parametrize("d8,d15,d30,source,tag", [
    (1, 0.5, 1, "8-30天/30天", "use_8_30"), (1, 1, 0, "8-30天/15天", "use_15"),
    (0, 0, 1, "30天", "use_30"), (0, 0, 0, "无销售数据", "no_sales")])
def test_demand_source(spark, d8, d15, d30, source, tag):
    row = (5.0, 0.0, 0.0, 0.5, 0, "", "", "", float(d8), float(d15), float(d30))
    out = _decide(spark, [row])[0]
    assert (out["demand_source"], out["source_tag"], out["daily_demand"]) == (source, tag, max(d8, d15, d30))


def test_discontinued_filter(spark):
    out = _decide(spark, [_row(1, 0, 0, 1, disc=0), _row(1, 0, 0, 1, disc=1), _row(1, 0, 0, 1, disc=2)])
    assert [r["sku"] for r in out] == ["S0", "S2"]


def test_assemble_spine_and_fill(spark):
    stock = spark.createDataFrame([("918", "A", K.NORTH, 5.0, 0.1, 1, "n", "f", "")],
                                  "channel string, sku string, region string, on_hand double, unit_volume double, "
                                  "is_discontinued int, name string, product_family string, image_url string")
    po = spark.createDataFrame([("918", "B", K.SOUTH, 3.0, None), ("918", "B", K.SOUTH, None, None)],
                               "channel string, sku string, region string, transit_qty double, production_qty double")
    dem = spark.createDataFrame([("918", "C", K.NORTH, "8-30", None), ("918", "C", K.NORTH, "15", 2.0)],
                                "channel string, sku string, region string, window string, value double")
    rows = {r.sku: r for r in D.assemble(stock, po, dem).collect()}
    assert set(rows) == {"A", "B", "C"}
    assert rows["B"].in_transit == 3.0 and rows["B"].on_hand == 0.0 and rows["B"].name == ""
    assert rows["C"].demand_8_30 == 0.0 and rows["C"].demand_15 == 2.0


def test_default_order(spark, tmp_dir):
    rows = D.default_order(f1_decisions(spark, tmp_dir)).collect()
    assert [r.priority for r in rows] == sorted(r.priority for r in rows)
    assert rows[0].decision == K.ORDER and rows[-1].decision == K.NO_SALES
