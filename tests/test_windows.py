"""P1 restock windows (F4) and restock events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from replenix import constants as K
from replenix.operators import restocks as R
from replenix.operators import sales as SL
from replenix.operators import windows as W

from helpers import NORTH_WH, SOUTH_WH, make_erp

C = "2026-07-02"


def _windows(spark, today, variant, arrivals=((1, "918-001", "C1", K.NORTH_PORT_ID, C),), sales=(), transfers=()):
    erp = make_erp(spark, sales=sales, arrivals=arrivals, transfers=transfers)
    perf = W.demand_windows(erp, today, (variant,), "2025-01-01", "2099-12-31")
    return [r.asDict() for r in W.with_averages(perf, (variant,)).orderBy("rn").collect()]


@pytest.mark.parametrize("variant,today,start,end,days,partial", [
    ("15", "2026-07-10", "2026-07-03", "2026-07-10", 8, 1),
    ("15", "2026-07-23", "2026-07-03", "2026-07-17", 15, 0),
    ("8_30", "2026-07-02", "2026-07-10", "2026-08-01", 23, 0),
    ("8_30", "2026-07-09", "2026-07-10", "2026-07-09", 0, 1),
    ("8_30", "2026-07-10", "2026-07-10", "2026-07-10", 1, 1),
    ("8_30", "2026-07-31", "2026-07-10", "2026-07-31", 22, 1),
    ("8_30", "2026-08-01", "2026-07-10", "2026-08-01", 23, 0),
    ("diagnostic", "2026-07-02", "2026-07-10", "2026-07-02", 0, 1),
    ("30", "2026-07-02", "2026-07-03", "2026-08-01", 0, 0),
    ("30", "2026-07-10", "2026-07-03", "2026-08-01", 8, 0),
    ("30", "2026-08-05", "2026-07-03", "2026-08-01", 30, 0),
])
def test_f4_window_bounds(spark, variant, today, start, end, days, partial):
    (w,) = _windows(spark, today, variant)
    assert (str(w["sample_start"]), str(w["sample_end"]), w["sample_days"], w["is_partial"]) == \
        (start, end, days, partial)
    if days == 0:
        assert w["single_avg"] is None


def test_f4_30_older_restocks_have_30_days(spark):
    arr = ((1, "918-001", "C1", K.NORTH_PORT_ID, "2026-06-01"), (2, "918-001", "C2", K.NORTH_PORT_ID, C))
    ws = _windows(spark, "2026-07-10", "30", arrivals=arr)
    assert [w["sample_days"] for w in ws] == [8, 30]


def test_sales_window_average(spark):
    # 8-30 window of a restock on 07-02 covers 07-10..08-01 (23 days); 46 sold -> 2/day
    sales = [(i, "918-001", 2.0, f"2026-07-{10 + i:02d}", None, NORTH_WH) for i in range(0, 22)]
    sales += [(100, "918-001", 2.0, "2026-08-01", None, NORTH_WH), (101, "918-001", 50.0, "2026-07-09", None, NORTH_WH),
              (102, "918-001", 7.0, "2026-07-15", None, SOUTH_WH)]
    (w,) = _windows(spark, "2026-09-01", "8_30", sales=sales)
    assert w["sample_qty"] == 46 and w["days_with_sales"] == 23 and w["single_avg"] == 2.0
    assert w["avg_mature"] == 2.0 and w["avg_weighted"] == 2.0


def test_f5_same_day_containers(spark):
    arr = ((1, "918-001", "C1", K.NORTH_PORT_ID, C), (2, "918-001", "C9", K.NORTH_PORT_ID, C))
    assert len(_windows(spark, "2026-09-01", "8_30", arrivals=arr)) == 1
    w8 = _windows(spark, "2026-09-01", "8_30", arrivals=arr)[0]
    assert w8["container_number"] == "C9" and w8["po_code"] == "PO2"
    assert len(_windows(spark, "2026-09-01", "30", arrivals=arr)) == 2


def test_f5_null_transfer_type(spark):
    tr = (("T1", "918-001", "2026-07-02", None), ("T2", "918-001", "2026-06-02", "Order"))
    for variant, n in (("8_30", 1), ("15", 1), ("30", 0), ("diagnostic", 0)):
        ws = _windows(spark, "2026-09-01", variant, arrivals=(), transfers=tr)
        assert len(ws) == n, variant
    (w15,) = _windows(spark, "2026-09-01", "15", arrivals=(), transfers=tr)
    assert (w15["container_number"], w15["po_code"], w15["source_type"], w15["region"]) == \
        ("T1", None, "Transfer_From_North", K.SOUTH)


def test_f5_newest_three(spark):
    arr = tuple((i, "918-001", f"C{i}", K.NORTH_PORT_ID, f"2026-0{i}-01") for i in (2, 3, 4, 5))
    ws = _windows(spark, "2026-09-01", "8_30", arrivals=arr)
    assert [str(w["checkin_date"]) for w in ws] == ["2026-05-01", "2026-04-01", "2026-03-01"]


def test_f5_partial_newest_excluded(spark):
    # check-ins 5 and 20 days before today: newest partial with 0 days (excluded), second cut at today
    today = dt.date(2026, 8, 1)
    arr = ((1, "918-001", "C1", K.NORTH_PORT_ID, str(today - dt.timedelta(days=5))),
           (2, "918-001", "C2", K.NORTH_PORT_ID, str(today - dt.timedelta(days=20))))
    sales = [(1, "918-001", 13.0, "2026-07-25", None, NORTH_WH)]
    ws = _windows(spark, str(today), "8_30", arrivals=arr, sales=sales)
    assert [w["is_partial"] for w in ws] == [1, 0]
    assert ws[0]["sample_days"] == 0 and ws[1]["sample_end"] == today and ws[1]["sample_days"] == 13
    assert ws[1]["avg_mature"] == 1.0 and ws[0]["avg_mature"] == 1.0


def test_daily_sales_policies(spark):
    sales = [(1, "918-001", 3.0, "2026-07-01", "2026-07-02", NORTH_WH), (2, "918-001", 4.0, "2026-07-01", None, NORTH_WH)]
    erp = make_erp(spark, sales=sales)
    rows = {(r.policy, str(r.order_date)): r.daily_qty
            for r in SL.daily_sales(erp, ("paid", "created"), "2025-01-01", "2099-12-31").collect()}
    assert rows == {("paid", "2026-07-02"): 3.0, ("paid", "2026-07-01"): 4.0, ("created", "2026-07-01"): 7.0}


def test_excluded_and_unknown_warehouse(spark):
    erp = make_erp(spark, sales=[(1, "918-001", 3.0, "2026-07-01", None, "ffffffff-0000-4000-8000-00000000ffff")])
    assert SL.daily_sales(erp, ("paid",), "2025-01-01", "2099-12-31").count() == 0  # null name drops out


def test_rank_uses_window_group_limit(spark):
    erp = make_erp(spark, arrivals=((1, "918-001", "C1", K.NORTH_PORT_ID, C),))
    ranked = R.rank_restocks(W.variant_events(erp, ("8_30",)), partition=(*W.VARIANT, *W.KEY))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_day_counts_rank_like_events(spark):
    # one PO with two lines of the SKU and three containers on the newest day: 6 events that day
    arr = tuple((1, "918-001", f"C{i}", K.NORTH_PORT_ID, C) for i in range(3))
    arr += ((2, "918-001", "C9", K.NORTH_PORT_ID, "2026-06-01"),)
    erp = make_erp(spark, arrivals=arr)
    erp = erp.__class__(**{**erp.__dict__, "purchase_order_lines": erp.purchase_order_lines.unionByName(
        erp.purchase_order_lines.filter("PurchaseOrderId = 1"))})
    cols = ["variant", "channel", "sku", "region", "checkin_date", "rn", "sample_days", "sample_qty", "is_partial"]
    for variant in ("30", "8_30", "15"):
        a = W.demand_windows(erp, "2026-07-10", (variant,), "2025-01-01", "2099-12-31", with_refs=True)
        b = W.demand_windows(erp, "2026-07-10", (variant,), "2025-01-01", "2099-12-31", with_refs=False)
        assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect())), variant
    b30 = W.demand_windows(erp, "2026-07-10", ("30",), "2025-01-01", "2099-12-31", with_refs=False)
    assert sorted((str(r.checkin_date), r.rn) for r in b30.collect()) == [(C, 1), (C, 2), (C, 3)]


def test_c7_single_sku_and_channel_filter(spark):
    arr = ((1, "918-001", "C1", K.NORTH_PORT_ID, C), (2, "918-002", "C2", K.NORTH_PORT_ID, C),
           (3, "996-001", "C3", K.NORTH_PORT_ID, C))
    erp = make_erp(spark, skus=("918-001", "918-002", "996-001"), arrivals=arr)
    one = W.window_report(erp, "diagnostic", "2026-09-01", "2025-01-01", sku="918-002").collect()
    assert [r.sku for r in one] == ["918-002"]
    chan = W.window_report(erp, "8_30", "2026-09-01", "2025-01-01", channels=["996"]).collect()
    assert [r.sku for r in chan] == ["996-001"]


def test_top3_candidates_equal_brute_force(spark):
    # PO 1: two lines of the SKU, five containers on the newest day; PO 2: two smaller containers that day
    arr = tuple((1, "918-001", f"C{i}", K.NORTH_PORT_ID, C) for i in (5, 3, 9, 4, 7))
    arr += ((2, "918-001", "C1", K.NORTH_PORT_ID, C), (2, "918-001", "C8", K.NORTH_PORT_ID, C),
            (3, "918-001", "C0", K.NORTH_PORT_ID, "2026-06-01"))
    erp = make_erp(spark, arrivals=arr)
    erp = erp.__class__(**{**erp.__dict__, "purchase_order_lines": erp.purchase_order_lines.unionByName(
        erp.purchase_order_lines.filter("PurchaseOrderId = 1"))})
    fast = R.rank_restocks(W.variant_events(erp, ("30",)), partition=(*W.VARIANT, *W.KEY), keep=3)
    raw = R.restock_events(erp).select(*W.KEY, "checkin_date", "container_number", "po_code",
                                       F.col("origin").alias("source_type"))
    brute = R.rank_restocks(raw, keep=3)
    cols = ["checkin_date", "container_number", "po_code", "rn"]
    got = sorted(map(tuple, fast.select(*cols).collect()))
    assert got == sorted(map(tuple, brute.select(*cols).collect()))
    assert [c for _, c, _, _ in got] == ["C1", "C3", "C3"]


def test_window_sums_equal_brute_force(spark):
    """Running sums subtracted at the windows' edges against adding up each window's days."""
    import datetime as dt
    import random
    rnd = random.Random(11)
    day0 = dt.date(2025, 1, 1)
    daily, windows = [], []
    for sku in ("a", "b", "c", None):
        for policy in ("paid", "created"):
            for i in rnd.sample(range(120), 60):
                daily.append((policy, "9", sku, K.SOUTH, day0 + dt.timedelta(i), rnd.choice([1.0, 0.25, -3.0, 0.0, 1e7, 0.1, None])))
            for rn in (1, 2, 3):
                start = rnd.randrange(-20, 130)
                for variant, length in (("8_30", rnd.randrange(0, 30)), ("diagnostic", -rnd.randrange(1, 9))):
                    windows.append((variant, policy, "9", sku, K.SOUTH, day0, None, "p", "PO", rn, day0 + dt.timedelta(start), day0 + dt.timedelta(start + length), 0))
    windows.append(("8_30", "paid", "9", "none sold", K.SOUTH, day0, None, "p", "PO", 1, day0, day0, 0))
    d = spark.createDataFrame(daily, "policy string, channel string, sku string, region string, order_date date, daily_qty double")
    w = spark.createDataFrame(windows, "variant string, policy string, channel string, sku string, region string, checkin_date date, "
                                       "container_number string, po_code string, source_type string, rn int, sample_start date, sample_end date, is_partial int")
    got = {(r.variant, r.policy, r.sku, r.rn): (r.sample_qty, r.days_with_sales) for r in W.window_performance(w, d, "2026-01-01", ("8_30", "diagnostic")).collect()}
    assert len(got) == len(windows)
    for v, p, _, sku, _, _, _, _, _, rn, start, end, _ in windows:
        inside = [q for pp, _, s, _, day, q in daily if (pp, s) == (p, sku) and start <= day <= end and q is not None]
        days = sum(q > 0 if v == "diagnostic" else 1 <= q <= 999999 for q in inside)
        assert got[v, p, sku, rn] == (pytest.approx(sum(inside), abs=1e-9), days), (v, p, sku, rn)


def test_windows_are_not_exploded(spark):
    erp = make_erp(spark, sales=[(1, "918-001", 3.0, "2026-07-01", None, SOUTH_WH)], arrivals=((1, "918-001", "C1", K.NORTH_PORT_ID, C),))
    plan = W.demand_windows(erp, "2026-07-10", ("8_30", "30"), "2025-01-01", "2099-12-31")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(sample_start" not in plan and "LeftOuter" not in plan.split("_edge")[0]


def test_events_of_a_large_order_are_dealt(spark, monkeypatch):
    """One PO of 3,000 lines and 40 containers among small ones: the same events, and no
    task that lists them alone."""
    skus = [f"918-{i:04}" for i in range(3_000)]
    erp = make_erp(spark, skus=skus, arrivals=[(1, skus[0], f"C{i:02}", K.NORTH_PORT_ID, C) for i in range(40)] + [(p, skus[p], "D", K.NORTH_PORT_ID, C) for p in range(2, 40)])
    lines = spark.range(1, 3_001).select(F.lit(1).cast("long").alias("PurchaseOrderId"), F.col("id").alias("ProductId"))
    erp = erp.__class__(**{**erp.__dict__, "purchase_order_lines": erp.purchase_order_lines.filter("PurchaseOrderId > 1").unionByName(lines).repartition(8)})
    cols = ["sku", "region", "checkin_date", "container_number", "po_code"]
    plain = sorted(map(str, R.po_arrivals(erp).select(*cols).collect()))  # below the limit: not dealt
    assert len(plain) == 3_000 * 40 + 38
    monkeypatch.setattr(R, "LINES_IN_PART", 100)
    assert sorted(map(str, R.po_arrivals(erp).select(*cols).collect())) == plain
    dealt, repeated = R.deal_hot_orders(erp.purchase_order_lines, erp.containers)
    sizes = {(r.PurchaseOrderId, r._part): r["count"] for r in dealt.groupBy("PurchaseOrderId", "_part").count().collect()}
    big = [n for (po, _), n in sizes.items() if po == 1]
    assert len(big) == 30 and max(big) <= 2 * 100 and all(part == 0 for po, part in sizes if po != 1)
    assert {(r.PurchaseOrderId, r["count"]) for r in repeated.groupBy("PurchaseOrderId").count().collect()} >= {(1, 30 * 40), (2, 1)}
    monkeypatch.setattr(R, "MOST_HOT", 0)  # more of them than are broadcast
    assert sorted(map(str, R.po_arrivals(erp).select(*cols).collect())) == plain


def test_days_ranked_in_one_pass_by_key(spark):
    """The newest events of all variants are those of the event list, and the rows of a
    key move twice at most: its events and its sales."""
    days = ["2001-01-05", "2001-01-05", "2001-02-01", "2001-03-01", "2001-04-01", "2001-05-01"]
    erp = make_erp(spark, skus=("918-001", "918-002"), sales=[(1, "918-001", 2, "2001-03-05", None, SOUTH_WH)],
                   arrivals=[(i, f"918-00{1 + i % 2}", f"C{i}-{n}", K.SOUTH_PORT_ID, x) for i, x in enumerate(days) for n in range(1 + i % 3)],
                   transfers=[(f"T{i}", "918-001", x, kind) for i, (x, kind) in enumerate([("2001-05-02", None), ("2001-05-03", "Order"), ("2001-04-20", "Move"), ("2001-04-20", None)])])
    every = tuple(W.SPECS)
    listed = R.rank_restocks(W.variant_events(erp, every), partition=(*W.VARIANT, *W.KEY))
    rows = lambda df: sorted(map(str, df.select("variant", "policy", *W.KEY, "checkin_date", "rn").collect()))
    assert rows(W.ranked_day_events(erp, every)) == rows(listed)
    for v in ("po_only", "30"):
        one = R.rank_restocks(W.variant_events(erp, (v,)), partition=(*W.VARIANT, *W.KEY))
        assert rows(W.ranked_day_events(erp, (v,))) == rows(one)
    demand = W.key_demand(W.demand_windows(erp, "2001-06-30", with_refs=False), ("8_30", "15", "30"))
    plan = demand._jdf.queryExecution().executedPlan().toString().lower()
    assert sum("exchange hashpartitioning(" in line and "sku#" in line and "region#" in line for line in plan.splitlines()) == 2, plan


def test_windows_meet_the_days_where_they_lie(spark):
    """A window is one row that meets the days of its key by a merge of rows that are dealt
    and, on its side, sorted already; a product without a SKU keeps its demand."""
    sales = [(1, "918-001", 3.0, "2026-05-20", None, SOUTH_WH), (2, None, 46.0, "2026-05-20", None, SOUTH_WH)]
    arrivals = ((1, "918-001", "C1", K.SOUTH_PORT_ID, "2026-05-10"), (2, None, "C2", K.SOUTH_PORT_ID, "2026-05-10"))
    for skus in (("918-001",), ("918-001", None)):
        erp = make_erp(spark, skus=skus, sales=[x for x in sales if x[1] in skus], arrivals=[x for x in arrivals if x[1] in skus])
        for with_refs in (False, True):
            perf = W.demand_windows(erp, "2026-07-10", ("8_30",), "2025-01-01", "2099-12-31", with_refs=with_refs)
            assert {r.sku: r.sample_qty for r in perf.collect()} == {s: 46.0 if s is None else 3.0 for s in skus}
        if None not in skus:
            demand = W.key_demand(W.demand_windows(erp, "2026-07-10", with_refs=False), ("8_30", "15", "30"))
            plan = demand._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin [_sku", 1)
            sides = [line for line in plan[1].splitlines() if "_sku#" in line and "Sort [" in line]
            assert "Window" not in plan[0] and len(sides) == 1 and "Sort [sku" not in plan[1].split("Generate explode", 1)[0], plan
