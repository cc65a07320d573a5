"""Views over a decision result and its aggregates (C10-C13, G2, G4, E7-E15,
B29-B32).  Every total is one conditional aggregate; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import predicates as P
from ..functions import scalar as S


def _decision_code(decision: str | None) -> str | None:
    if decision is None or decision == K.ALL_CHOICE:
        return None
    labels = {v: k for k, v in K.DECISION_LABELS.items()}
    return labels.get(decision, decision)


# C10
def filter_view(df: DataFrame, region: str | None = None, decision: str | None = None) -> DataFrame:
    """Optional region and decision filters ('全部' = all; labels or codes)."""
    if region is not None and region != K.ALL_CHOICE:
        df = df.filter(F.col("region") == region)
    code = _decision_code(decision)
    if code is not None:
        df = df.filter(F.col("decision") == code)
    return df


# C11
def search_family(rows: DataFrame, text: str | None, region: str | None = None, decision: str | None = None,
                  literal: bool = False) -> DataFrame:
    """Family search in tiers: (1) case-insensitive exact family within the
    region/decision view; (2) else family contains ``text`` (a regex unless
    ``literal``) within the view; (3) if still empty, family or name contains
    it over all rows.  The first non-empty tier wins; still empty gives none.

    Each row gets its tier flags in one projection; the best tier is a scalar
    subquery (one value), so nothing is collected and no global window is used."""
    t = (text or "").strip()
    in_view = F.lit(True)
    if region is not None and region != K.ALL_CHOICE:
        in_view = in_view & (F.col("region") == region)
    code = _decision_code(decision)
    if code is not None:
        in_view = in_view & (F.col("decision") == code)
    if not t or t == K.ALL_CHOICE:
        return rows.filter(in_view)
    needle = t.lower()

    def contains(c):
        return F.coalesce(F.lower(F.col(c)).contains(needle) if literal else F.lower(F.col(c)).rlike(needle),
                          F.lit(False))

    flagged = rows.select("*", (in_view & (F.lower(F.col("product_family")) == needle)).alias("_t1"),
                          (in_view & contains("product_family")).alias("_t2"),
                          (contains("product_family") | contains("name")).alias("_t3"))
    row_tier = F.least(F.when(F.col("_t1"), 1), F.when(F.col("_t2"), 2), F.when(F.col("_t3"), 3))
    best = flagged.select(F.min(row_tier)).scalar()
    keep = F.when(best == 1, F.col("_t1")).when(best == 2, F.col("_t2")).when(best == 3, F.col("_t3"))
    return flagged.filter(F.coalesce(keep, F.lit(False))).drop("_t1", "_t2", "_t3")


# C12 + B26 + G4
def top_urgent(df: DataFrame, n: int = 30, by_channel: bool = False) -> DataFrame:
    """Active rows (order/expedite) with the fewest days of supply, over all or
    of each channel (a top-N report: no full sort, at most n rows a key and task)."""
    act = df.filter(P.is_active("decision")).withColumn("days_of_supply", S.days_of_supply())
    if by_channel:
        w = Window.partitionBy("channel").orderBy(F.col("days_of_supply").asc(), "sku", "region")
        return act.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
    return act.orderBy(F.col("days_of_supply").asc(), "sku", "region", "channel").limit(n)


# FIXED VALUES: display headings of the view that a user may sort by, and our column for each.
SORT_HEADINGS = {
    "SKU": "sku", "Name": "name", "ProductFamily": "product_family", "地区": "region", "在库库存": "on_hand",
    "在途库存": "in_transit", "在产库存": "in_production", "总量库存": "total_stock", "8-30天": "demand_8_30",
    "15天": "demand_15", "30天": "demand_30", "采用需求": "daily_demand", "需求来源": "demand_source",
    "LT预估": "lead_time_need", "物流预估": "logistics_need", "决策建议": "decision", "建议订货量": "order_qty",
    "体积系数": "unit_volume", "备货体积": "order_volume", "催发货数量": "expedite_qty",
    "催发货体积": "expedite_volume", "详细说明": "explanation", "渠道": "channel",
}


def _sort_column(name: str | None) -> str | None:
    return SORT_HEADINGS.get(name, name) if name else None


# G2
def sort_view(df: DataFrame, primary: str | None = None, ascending: bool = True, secondary: str | None = None,
              ascending2: bool = True) -> DataFrame:
    """User sort on one or two columns, nulls last; the same column twice
    drops the secondary."""
    primary, secondary = _sort_column(primary), _sort_column(secondary)
    keys = []
    if primary:
        keys.append(F.col(primary).asc_nulls_last() if ascending else F.col(primary).desc_nulls_last())
    if secondary and secondary != primary:
        keys.append(F.col(secondary).asc_nulls_last() if ascending2 else F.col(secondary).desc_nulls_last())
    return df.orderBy(*keys) if keys else df


# B29
def display(df: DataFrame) -> DataFrame:
    """The view's text columns: fixed decimals as Python prints them;
    quantities not positive as '-'."""
    c = F.col
    specs = {"on_hand": (c("on_hand"), 0), "in_transit": (c("in_transit"), 0),
             "in_production": (c("in_production"), 0), "total_stock": (c("total_stock"), 0),
             "demand_8_30": (c("demand_8_30"), 3), "demand_15": (c("demand_15"), 3), "demand_30": (c("demand_30"), 3),
             "daily_demand": (c("daily_demand"), 3), "lead_time_need": (c("lead_time_need"), 1),
             "logistics_need": (c("logistics_need"), 1), "order_qty": (c("order_qty"), 0, True),
             "unit_volume": (c("unit_volume"), 5), "order_volume": (c("order_volume"), 4, True),
             "expedite_qty": (c("expedite_qty"), 0, True), "expedite_volume": (c("expedite_volume"), 4, True)}
    base = df.select("channel", "sku", "name", "product_family", "region", "demand_source", "decision", "explanation",
                     *[v[0].alias(f"_v_{k}") for k, v in specs.items()])
    t = S.with_fixed_texts(base, {k: (F.col(f"_v_{k}"), *v[1:]) for k, v in specs.items()})
    return t.select("channel", "sku", "name", "product_family", "region", "on_hand", "in_transit", "in_production",
                    "total_stock", "demand_8_30", "demand_15", "demand_30", "daily_demand", "demand_source",
                    "lead_time_need", "logistics_need", S.decision_label().alias("decision"), "order_qty",
                    "unit_volume", "order_volume", "expedite_qty", "expedite_volume", "explanation")


def _keys(by_channel: bool) -> list[str]:
    return ["channel"] if by_channel else []


def _vol(decision: str, region: str | None, col: str):
    cond = F.col("decision") == decision
    if region is not None:
        cond = cond & (F.col("region") == region)
    return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0.0))


# E7 + B32 + E11
def container_check(df: DataFrame, threshold: float = K.CONTAINER_THRESHOLD, by_channel: bool = True) -> DataFrame:
    """Order volume per region against the container threshold (per channel
    or over all channels), with the gap still missing (B32)."""
    keys = _keys(by_channel)
    g = df.groupBy(*keys).agg(_vol(K.ORDER, K.NORTH, "order_volume").alias("north_order_volume"),
                              _vol(K.ORDER, K.SOUTH, "order_volume").alias("south_order_volume"),
                              _vol(K.ORDER, None, "order_volume").alias("total_order_volume"))
    t = float(threshold)
    return g.select(*keys, "north_order_volume", "south_order_volume", "total_order_volume",
                    (F.col("north_order_volume") >= t).alias("north_bookable"),
                    (F.col("south_order_volume") >= t).alias("south_bookable"),
                    S.container_gap("north_order_volume", t).alias("north_gap"),
                    S.container_gap("south_order_volume", t).alias("south_gap"))


def region_totals(df: DataFrame, threshold: float = K.CONTAINER_THRESHOLD, by_channel: bool = False) -> DataFrame:
    """Order volume per region (both regions always present) vs threshold."""
    keys = _keys(by_channel)
    regions = F.explode(F.array(F.lit(K.NORTH), F.lit(K.SOUTH))).alias("region")
    g = container_check(df, threshold, by_channel)
    return g.select(*keys, regions, "north_order_volume", "south_order_volume").select(
        *keys, "region", F.when(F.col("region") == K.NORTH, F.col("north_order_volume"))
                   .otherwise(F.col("south_order_volume")).alias("order_volume")).select(
        *keys, "region", "order_volume", F.lit(float(threshold)).alias("threshold"),
        (F.col("order_volume") >= float(threshold)).alias("bookable"))


# E8
def expedite_totals(df: DataFrame) -> DataFrame:
    """Expedite volume and quantity: north, south and (null region) all; 0 where
    there is nothing to expedite."""
    cols = ("expedite_volume", "expedite_qty")
    g = df.agg(*[_vol(K.EXPEDITE, r, c).alias(f"{k}_{c}") for k, r in (("n", K.NORTH), ("s", K.SOUTH), ("t", None)) for c in cols])
    rows = [F.struct(F.lit(r).cast("string").alias("region"), *[F.col(f"{k}_{c}").alias(c) for c in cols])
            for k, r in (("n", K.NORTH), ("s", K.SOUTH), ("t", None))]
    return g.select(F.inline(F.array(*rows)))


# E9
def decision_badges(df: DataFrame, by_channel: bool = False) -> DataFrame:
    return df.groupBy(*_keys(by_channel), "decision").agg(F.count(F.lit(1)).alias("rows"), F.sum("order_volume").alias("order_volume"),
                                      F.sum("expedite_qty").alias("expedite_qty"),
                                      F.sum("expedite_volume").alias("expedite_volume"))


# E10 + B30
def decision_distribution(df: DataFrame, by_channel: bool = False) -> DataFrame:
    """Rows per decision and their percent of all rows, or of the channel's."""
    keys = _keys(by_channel)
    g = df.groupBy(*keys, "decision").agg(F.count(F.lit(1)).alias("rows"))
    # the total of the few grouped rows: the input is read once
    total = F.sum("rows").over(Window.partitionBy(*(keys or [F.lit(1)])))
    return g.select(
        *keys, "decision", S.decision_label("decision").alias("label"), S.decision_label("decision", "en").alias("label_en"),
        "rows", (F.col("rows") * 100.0 / total).alias("percent"))


# E12
def run_summary(df: DataFrame, dropped: DataFrame | None = None, by_channel: bool = False) -> DataFrame:
    """One row, or one per channel: rows per decision, order quantity, volumes per region,
    discontinued rows dropped (counted where C9 drops them)."""
    cnt = {d: F.count(F.when(F.col("decision") == d, F.lit(1))).alias(f"{d}_rows")
           for d in (K.ORDER, K.EXPEDITE, K.HOLD, K.NO_SALES)}
    out = df.groupBy(*_keys(by_channel)).agg(F.count(F.lit(1)).alias("rows"), *cnt.values(),
                 F.coalesce(F.sum(F.when(F.col("decision") == K.ORDER, F.col("order_qty"))), F.lit(0.0)).alias("order_qty"),
                 _vol(K.ORDER, None, "order_volume").alias("order_volume"),
                 _vol(K.ORDER, K.NORTH, "order_volume").alias("north_order_volume"),
                 _vol(K.ORDER, K.SOUTH, "order_volume").alias("south_order_volume"),
                 _vol(K.EXPEDITE, None, "expedite_volume").alias("expedite_volume"),
                 _vol(K.EXPEDITE, K.NORTH, "expedite_volume").alias("north_expedite_volume"),
                 _vol(K.EXPEDITE, K.SOUTH, "expedite_volume").alias("south_expedite_volume"))
    if dropped is not None:
        out = out.withColumn("discontinued_dropped", dropped.select(F.count(F.lit(1))).scalar())
    return out


# E15
def accumulated_info(df: DataFrame) -> DataFrame:
    """Row count and the sorted channel list of an accumulated result."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("channel")).alias("channels"))


def active_only(df: DataFrame) -> DataFrame:
    """C12."""
    return df.filter(P.is_active("decision"))


def per_decision(df: DataFrame, decisions: Sequence[str]) -> DataFrame:
    """The rows of the given decisions."""
    return df.filter(F.col("decision").isin(*decisions))


def view(df: DataFrame, region: str | None = None, decision: str | None = None, family: str | None = None,
         primary: str | None = None, ascending: bool = True, secondary: str | None = None,
         ascending2: bool = True, literal: bool = False) -> DataFrame:
    """The view of a decision result: region/decision filters (C10), tiered
    family search (C11, its fallback tier searches the whole result) and the
    user sort (G2); lazy, nothing is collected."""
    rows = search_family(df, family, region, decision, literal)
    return sort_view(rows, primary, ascending, secondary, ascending2)


def totals(df: DataFrame, threshold: float = K.CONTAINER_THRESHOLD) -> DataFrame:
    """The totals shown with a view: rows, order and expedite rows, order and
    expedite volumes per region and in total, container status per region."""
    s = run_summary(df)
    t = float(threshold)
    return s.select("rows", F.col("order_rows"), F.col("expedite_rows"), "order_volume", "north_order_volume",
                    "south_order_volume", "expedite_volume", "north_expedite_volume", "south_expedite_volume",
                    (F.col("north_order_volume") >= t).alias("north_bookable"),
                    (F.col("south_order_volume") >= t).alias("south_bookable"))
