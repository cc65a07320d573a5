"""Property checks: invariants on the test tables and the decision
rules against a plain-Python statement of them on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from replenix import constants as K
from replenix.operators import decisions as D
from replenix.operators import windows as W
from replenix.plans import catalog as C
from replenix.sources.testdata import AS_OF, SALES_FROM, SALES_TO

SF = "/root/testdata/sf0.001"


def test_one_decision_per_key_and_non_negative(spark):
    dec = C.decisions_df(spark, SF)
    agg = dec.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("channel", "sku", "region").alias("keys"),
                  F.min("order_qty").alias("min_order"), F.min("expedite_qty").alias("min_exp"),
                  F.sum(F.when(F.col("decision") == K.ORDER, (F.col("total_stock") > F.col("lead_time_need"))
                               .cast("int"))).alias("bad_orders")).collect()[0]
    assert agg.n == agg.keys and agg.min_order >= 0 and agg.min_exp >= 0 and (agg.bad_orders or 0) == 0


def test_decisions_cover_spine_minus_discontinued(spark):
    spine = C.queries()["key_spine"](spark, SF).count()
    dec = C.decisions_df(spark, SF).count()
    td = C.adapter(spark, SF)
    dropped = td.stock_wide().filter(F.col("IsDiscontinued") == "1").count() * 2
    assert dec == spine - dropped


def test_8_30_starts_seven_days_after_aligned_30(spark):
    erp = C.adapter(spark, SF).erp()
    perf = W.demand_windows(erp, AS_OF, ("8_30", "30_aligned"), SALES_FROM, SALES_TO)
    a = perf.filter(F.col("variant") == "8_30").select(*W.KEY, "checkin_date", F.col("sample_start").alias("s8"))
    b = perf.filter(F.col("variant") == "30_aligned").select(*W.KEY, "checkin_date",
                                                             F.col("sample_start").alias("s30"))
    j = a.join(b, [*W.KEY, "checkin_date"])
    assert j.count() > 0
    assert j.filter(F.datediff("s8", "s30") != 7).count() == 0


def _rules(on_hand, transit, production, d8, d15, d30, lead, log):
    """The decision rules as plain Python (first match wins)."""
    daily = max(d8, d15, d30)
    total = on_hand + transit + production
    lt_need, log_need = daily * lead, daily * log
    if daily == 0:
        return K.NO_SALES, 0.0, 0.0
    if total <= lt_need:
        return K.ORDER, max(0.0, lt_need - total), 0.0
    if on_hand + transit <= log_need and production > 0:
        return K.EXPEDITE, 0.0, max(0.0, log_need - on_hand - transit)
    return K.HOLD, 0.0, 0.0


def test_decide_matches_rules_on_random_inputs(spark):
    rnd = random.Random(11)

    def q():
        return float(rnd.choice([0, 0, rnd.randint(-5, 60)]))

    rows = []
    for i in range(400):
        demand = [rnd.choice([0.0, round(rnd.uniform(0, 2), 6)]) for _ in range(3)]
        rows.append((f"S{i:04d}", q(), q(), q(), *demand, rnd.choice([10, 60, 90]), rnd.choice([5, 30])))
    schema = ("sku string, on_hand double, in_transit double, in_production double, demand_8_30 double, "
              "demand_15 double, demand_30 double, lead int, log int")
    df = spark.createDataFrame(rows, schema)
    base = df.select(F.concat(F.lit("9"), F.substring("sku", 2, 2)).alias("channel"), "sku",
                     F.lit(K.NORTH).alias("region"), "on_hand", "in_transit", "in_production",
                     F.lit(0.5).alias("unit_volume"), F.lit(0).alias("is_discontinued"), F.lit("").alias("name"),
                     F.lit("").alias("product_family"), F.lit("").alias("image_url"),
                     "demand_8_30", "demand_15", "demand_30")
    settings = df.select(F.concat(F.lit("9"), F.substring("sku", 2, 2)).alias("channel"),
                         F.col("lead").alias("lead_time"), F.col("log").alias("logistics_time")).distinct()
    # one setting per channel: derive it from the first row of each channel for the oracle
    per_channel = {r.channel: (r.lead_time, r.logistics_time)
                   for r in settings.groupBy("channel").agg(F.min("lead_time").alias("lead_time"),
                                                           F.min("logistics_time").alias("logistics_time")).collect()}
    st = spark.createDataFrame([(c, *v) for c, v in per_channel.items()],
                               "channel string, lead_time int, logistics_time int")
    got = {r.sku: (r.decision, r.order_qty, r.expedite_qty) for r in D.decide(base, st).collect()}
    for sku, oh, tr, pr, d8, d15, d30, _, _ in rows:
        lead, log = per_channel["9" + sku[1:3]]
        exp = _rules(oh, tr, pr, d8, d15, d30, lead, log)
        dec, oq, eq = got[sku]
        assert dec == exp[0], sku
        assert oq == pytest.approx(exp[1]) and eq == pytest.approx(exp[2]), sku
