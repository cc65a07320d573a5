"""Registered queries over the shared test tables: Spark plan + DuckDB oracle.

Every query reads the whole test tables (through the adapter), nothing is
sampled or capped.  Column names and types match the oracle SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar as S
from ..operators import decisions as D
from ..operators import purchase as PU
from ..operators import quality as QC
from ..operators import restocks as R
from ..operators import sales as SL
from ..operators import stock as ST
from ..operators import views as V
from ..operators import windows as W
from ..operators.settings_ops import effective_settings, settings_document, sync_settings, upsert_setting
from ..operators.util import with_places
from ..session import checkpoint_dir, cut_lineage
from ..sinks import snapshots as SN
from ..sinks import writers as WR
from ..sources import channel_files as CF
from ..sources.settings import settings_from_text
from ..sources.testdata import AS_OF, SALES_FROM, SALES_TO, TpchAdapter, settings_json
from ..streaming import scan as SC
from . import oracle as O
from . import replenishment as RP

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = O.swap_round8(sql)
        return fn
    return deco


def r8(c) -> "F.Column":
    """Output normalisation to 8 places (same IEEE steps as the oracle's r8):
    absorbs last-bit differences of float sums between engines."""
    return F.floor(F.col(c) * 1e8 + 0.5) / 1e8


def round_doubles(df: DataFrame, cols) -> DataFrame:
    return df.select(*[r8(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def adapter(spark: SparkSession, sf_dir: str) -> TpchAdapter:
    """One adapter per session and folder, so repeated queries reuse its plans."""
    cache = spark.__dict__.setdefault("_replenix_adapters", {})
    if sf_dir not in cache:
        cache[sf_dir] = TpchAdapter(spark, sf_dir)
    return cache[sf_dir]


def settings(spark: SparkSession, td: TpchAdapter) -> DataFrame:
    return effective_settings(td.channels(), settings_from_text(spark, settings_json()))


# ---------------------------------------------------------------- P1 layers
@register("daily_sales", O.with_ctes(O.ADAPTER, O.SALES) + "\nSELECT * FROM daily_paid UNION ALL SELECT * FROM daily_created")
def q_daily_sales(spark, sf_dir):
    erp = adapter(spark, sf_dir).erp()
    return SL.daily_sales(erp, ("paid", "created"), SALES_FROM, SALES_TO)


@register("restock_events", O.with_ctes(O.ADAPTER, O.SALES) + "\nSELECT * FROM raw_events")
def q_restock_events(spark, sf_dir):
    return R.restock_events(adapter(spark, sf_dir).erp())


@register("restock_day_counts", O.with_ctes(O.ADAPTER, O.SALES) + """
SELECT channel, sku, region, checkin_date, COUNT(*) FILTER (WHERE origin = 'PO') AS n_po,
       COUNT(*) FILTER (WHERE origin = 'Transfer' AND transfer_type IS NULL) AS n_tnull,
       COUNT(*) FILTER (WHERE origin = 'Transfer' AND transfer_type <> 'Order') AS n_tkept
FROM raw_events WHERE origin = 'PO' OR transfer_type IS DISTINCT FROM 'Order' GROUP BY ALL""")
def q_restock_day_counts(spark, sf_dir):
    """H1 counted: events per key and day, without the line x container pairs."""
    return R.restock_day_counts(adapter(spark, sf_dir).erp())


@register("restock_ranked", O.with_ctes(O.ADAPTER, O.SALES, *[O.window_ctes(k) for k in O.DECISION_VARIANTS]) + "\n" +
          "\nUNION ALL\n".join(
              f"SELECT '{k}' AS variant, channel, sku, region, checkin_date, container_number, po_code, source_type, "
              f"CAST(rn AS BIGINT) AS rn FROM rk_{k}" for k in O.DECISION_VARIANTS))
def q_restock_ranked(spark, sf_dir):
    erp = adapter(spark, sf_dir).erp()
    ev = W.variant_events(erp, O.DECISION_VARIANTS)
    ranked = R.rank_restocks(ev, partition=(*W.VARIANT, *W.KEY), keep=3)
    return ranked.select("variant", *W.KEY, "checkin_date", "container_number", "po_code", "source_type",
                         F.col("rn").cast("bigint").alias("rn"))


def _window_query(key: str) -> Query:
    def run(spark, sf_dir):
        df = W.window_report(adapter(spark, sf_dir).erp(), key, AS_OF, SALES_FROM, SALES_TO)
        return round_doubles(df, ("single_avg", "avg_daily_demand")) if key == "30" else df
    return run


for _k in ("8_30", "15", "30", "30_aligned", "diagnostic", "po_only"):
    register(f"window_{_k}", O.window_sql(_k))(_window_query(_k))

EMPTIED = "905"  # the channel that replace_channel_empty clears
RECONCILE_FROM, RECONCILE_TO = "2000-01-01", "2000-12-31"


@register("reconcile_sales", O.with_ctes(O.ADAPTER) + f"""
SELECT substr(sku, 1, 3) AS channel, sku, region, SUM(qty) AS total_qty, COUNT(DISTINCT day) AS order_days FROM (
  SELECT (SELECT Sku FROM erp_products WHERE Id = ol.ProductId) AS sku, ol.Quantity AS qty, days.day,
         CASE WHEN EXISTS (SELECT 1 FROM erp_warehouses w WHERE {O.try_guid('w.Id')} = {O.WAREHOUSE_OF_LINE}
                           AND trim(w.Name) IN {O.in_list(K.SOUTH_WAREHOUSES)}) THEN {O.q(K.SOUTH)} ELSE {O.q(K.NORTH)} END AS region
  FROM erp_order_lines ol JOIN (SELECT Id, CAST(DateCreatedUtc AS DATE) AS day FROM erp_orders) days ON days.Id = ol.OrderId
  WHERE days.day >= DATE '{RECONCILE_FROM}' AND days.day <= DATE '{RECONCILE_TO}') lines
WHERE sku IS NOT NULL GROUP BY 1, 2, 3""")
def q_reconcile(spark, sf_dir):
    return SL.reconcile_sales(adapter(spark, sf_dir).erp(), RECONCILE_FROM, RECONCILE_TO)


# ---------------------------------------------------------------- P2 layers
@register("stock_long", O.with_ctes(O.ADAPTER, O.STOCK_LONG) + f"""
SELECT s.*, COALESCE(img.image_url, '') AS image_url FROM stock_long s LEFT JOIN
(SELECT channel, sku, max(image_url) AS image_url FROM ({O.image_urls_sql()}) GROUP BY ALL) img USING (channel, sku)""")
def q_stock_long(spark, sf_dir):
    return ST.stock_long(adapter(spark, sf_dir).stock_wide())


@register("open_po", O.with_ctes(O.ADAPTER, O.PO_ROWS) + """
SELECT channel, sku, region, COALESCE(SUM(transit_qty), 0.0) AS in_transit,
       COALESCE(SUM(production_qty), 0.0) AS in_production FROM po_rows GROUP BY ALL""")
def q_open_po(spark, sf_dir):
    return PU.open_po(adapter(spark, sf_dir).po_file())


@register("demand_by_key", O.decision_ctes() + """
SELECT channel, sku, region, demand_8_30, demand_15, ROUND(demand_30, 8) AS demand_30,
       ROUND(greatest(demand_8_30, demand_15, demand_30), 8) AS daily_demand,
       CASE WHEN greatest(demand_8_30, demand_15, demand_30) = 0 THEN 'no_sales'
            WHEN demand_15 = greatest(demand_8_30, demand_15, demand_30) THEN 'use_15'
            WHEN demand_8_30 = greatest(demand_8_30, demand_15, demand_30) THEN 'use_8_30' ELSE 'use_30' END AS source_tag
FROM filled""")
def q_demand_by_key(spark, sf_dir):
    td = adapter(spark, sf_dir)
    dem = _demand(td)
    a = D.assemble(ST.stock_long(td.stock_wide()), PU.po_rows(td.po_file()), dem)
    out = a.select("channel", "sku", "region", "demand_8_30", "demand_15", "demand_30",
                   S.daily_demand().alias("daily_demand"), S.source_tag().alias("source_tag"))
    return round_doubles(out, ("demand_30", "daily_demand"))


@register("key_spine", O.decision_ctes() + "\nSELECT channel, sku, region FROM assembled")
def q_key_spine(spark, sf_dir):
    td = adapter(spark, sf_dir)
    dem = _demand(td)
    return D.key_spine(ST.stock_long(td.stock_wide()), PU.po_rows(td.po_file()), dem)


DECISION_DOUBLES = ("demand_30", "daily_demand", "lead_time_need", "logistics_need", "order_qty", "order_volume",
                    "expedite_qty", "expedite_volume")


def _demand(td: TpchAdapter) -> DataFrame:
    if "demand" not in td._memo:
        td._memo["demand"] = RP.demand(td.erp(), AS_OF, date_from=SALES_FROM, date_to=SALES_TO)
    return td._memo["demand"]


def decisions_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: P1 demand (three windows) -> P2 decisions, all channels.
    The plan is built once per adapter and shared by the dependent queries."""
    td = adapter(spark, sf_dir)
    if "decisions" not in td._memo:
        td._memo["decisions"] = RP.replenishment(td.stock_wide(), td.po_file(), _demand(td), settings(spark, td))
    return td._memo["decisions"]


def _pf(x: str, d: int) -> str:
    return f"printf('%.{d}f', {x})"


SUPPLY_DAYS = "CASE WHEN daily_demand > 0 THEN total_stock / daily_demand ELSE 0.0 END"
EXPLANATION_SQL = f"""CASE decision
  WHEN 'no_sales' THEN printf({O.q(D.TEXT_NO_SALES)}, {_pf('on_hand', 0)}, {_pf('in_transit', 0)}, {_pf('in_production', 0)})
  WHEN 'order' THEN printf({O.q(D.TEXT_ORDER)}, {_pf('total_stock', 0)}, lead_time, {_pf('lead_time_need', 1)},
                           {_pf('order_qty', 0)}, {_pf('order_volume', 4)}, demand_source)
  WHEN 'expedite' THEN printf({O.q(D.TEXT_EXPEDITE)}, {_pf('on_hand + in_transit', 0)}, logistics_time,
                              {_pf('logistics_need', 1)}, {_pf('expedite_qty', 0)}, {_pf('expedite_volume', 4)})
  ELSE CASE WHEN on_hand + in_transit <= logistics_need AND in_production = 0
            THEN printf({O.q(D.TEXT_HOLD_NOTHING_TO_EXPEDITE)}, {_pf('on_hand + in_transit', 0)}, logistics_time,
                        {_pf('logistics_need', 1)}, {_pf(SUPPLY_DAYS, 0)})
            ELSE printf({O.q(D.TEXT_HOLD)}, {_pf('on_hand', 0)}, {_pf('in_transit', 0)}, {_pf('in_production', 0)},
                        demand_source, {_pf(SUPPLY_DAYS, 0)}) END
END"""


def _dash(x: str, d: int) -> str:
    return f"CASE WHEN {x} > 0 THEN {_pf(x, d)} ELSE '-' END"


def decisions_out(df: DataFrame) -> DataFrame:
    out = df.select(*[F.col(c).cast("bigint").alias(c) if c in ("lead_time", "logistics_time", "priority")
                      else (F.coalesce(c, F.lit("")).alias(c) if c == "image_url" else F.col(c)) for c in D.DECISION_COLUMNS])
    return round_doubles(out, DECISION_DOUBLES)


# image URL per SKU: keys of SKUs without stock or without an image have none
IMAGES = f"(SELECT channel, sku, max(image_url) AS image_url FROM ({O.image_urls_sql()}) GROUP BY ALL)"
FULL_SQL = O.decisions_sql(f"""
SELECT v.* EXCLUDE (image_url), COALESCE(v.image_url, '') AS image_url FROM (
SELECT {O.DECISION_OUT}, {EXPLANATION_SQL} AS explanation, image_url FROM decisions_v LEFT JOIN {IMAGES} img USING (channel, sku)) v""")


@register("decisions", FULL_SQL)
def q_decisions(spark, sf_dir):
    return decisions_out(decisions_df(spark, sf_dir))


@register("explanations", O.decisions_sql(
    f"SELECT channel, sku, region, decision, {EXPLANATION_SQL} AS explanation FROM decisions_v"))
def q_explanations(spark, sf_dir):
    return decisions_df(spark, sf_dir).select("channel", "sku", "region", "decision", "explanation")


@register("image_urls", O.image_urls_sql())
def q_image_urls(spark, sf_dir):
    return ST.image_lookup(ST.stock_long(adapter(spark, sf_dir).stock_wide()))


# ---------------------------------------------------------------- views and aggregates
DEC = "decisions_v"
NORTH, SOUTH = O.q(K.NORTH), O.q(K.SOUTH)


def _sum_when(cond: str, col: str) -> str:
    return f"COALESCE(SUM(CASE WHEN {cond} THEN {col} END), 0.0)"


@register("container_check", O.decisions_sql(f"""
SELECT channel, ROUND(n, 8) AS north_order_volume, ROUND(s, 8) AS south_order_volume, ROUND(t, 8) AS total_order_volume,
       n >= 69.0 AS north_bookable, s >= 69.0 AS south_bookable, ROUND(69.0 - n, 8) AS north_gap, ROUND(69.0 - s, 8) AS south_gap
FROM (SELECT channel, {_sum_when(f"decision = 'order' AND region = {NORTH}", 'order_volume')} AS n,
             {_sum_when(f"decision = 'order' AND region = {SOUTH}", 'order_volume')} AS s,
             {_sum_when("decision = 'order'", 'order_volume')} AS t FROM {DEC} GROUP BY channel)"""))
def q_container_check(spark, sf_dir):
    df = V.container_check(decisions_df(spark, sf_dir))
    return round_doubles(df, ("north_order_volume", "south_order_volume", "total_order_volume", "north_gap",
                              "south_gap"))


@register("region_totals_by_channel", O.decisions_sql(f"""
SELECT c.channel, r.region, ROUND(COALESCE(SUM(d.order_volume), 0.0), 8) AS order_volume, 69.0::DOUBLE AS threshold,
       COALESCE(SUM(d.order_volume), 0.0) >= 69.0 AS bookable
FROM (SELECT DISTINCT channel FROM {DEC}) c, (VALUES ({NORTH}), ({SOUTH})) r(region)
LEFT JOIN {DEC} d ON d.channel = c.channel AND d.region = r.region AND d.decision = 'order' GROUP BY ALL"""))
def q_region_totals_by_channel(spark, sf_dir):
    return round_doubles(V.region_totals(decisions_df(spark, sf_dir), by_channel=True), ("order_volume",))


@register("region_totals", O.decisions_sql(f"""
SELECT region, ROUND(v, 8) AS order_volume, 69.0::DOUBLE AS threshold, v >= 69.0 AS bookable FROM (
  SELECT {NORTH} AS region, {_sum_when(f"decision = 'order' AND region = {NORTH}", 'order_volume')} AS v FROM {DEC}
  UNION ALL
  SELECT {SOUTH}, {_sum_when(f"decision = 'order' AND region = {SOUTH}", 'order_volume')} FROM {DEC})"""))
def q_region_totals(spark, sf_dir):
    return round_doubles(V.region_totals(decisions_df(spark, sf_dir)), ("order_volume",))


@register("expedite_totals", O.decisions_sql(f"""
SELECT r.region, ROUND(COALESCE(SUM(d.expedite_volume), 0.0), 8) AS expedite_volume, ROUND(COALESCE(SUM(d.expedite_qty), 0.0), 8) AS expedite_qty
FROM (VALUES ({NORTH}), ({SOUTH}), (NULL)) r(region)
LEFT JOIN (SELECT * FROM {DEC} WHERE decision = 'expedite') d ON r.region IS NULL OR d.region = r.region GROUP BY r.region"""))
def q_expedite_totals(spark, sf_dir):
    return round_doubles(V.expedite_totals(decisions_df(spark, sf_dir)), ("expedite_volume", "expedite_qty"))


@register("decision_badges", O.decisions_sql(f"""
SELECT decision, COUNT(*) AS rows, ROUND(SUM(order_volume), 8) AS order_volume,
       ROUND(SUM(expedite_qty), 8) AS expedite_qty, ROUND(SUM(expedite_volume), 8) AS expedite_volume
FROM {DEC} GROUP BY decision"""))
def q_decision_badges(spark, sf_dir):
    return round_doubles(V.decision_badges(decisions_df(spark, sf_dir)),
                         ("order_volume", "expedite_qty", "expedite_volume"))


@register("decision_badges_by_channel", O.decisions_sql(f"""
SELECT channel, decision, COUNT(*) AS rows, ROUND(SUM(order_volume), 8) AS order_volume,
       ROUND(SUM(expedite_qty), 8) AS expedite_qty, ROUND(SUM(expedite_volume), 8) AS expedite_volume
FROM {DEC} GROUP BY channel, decision"""))
def q_decision_badges_by_channel(spark, sf_dir):
    return round_doubles(V.decision_badges(decisions_df(spark, sf_dir), by_channel=True),
                         ("order_volume", "expedite_qty", "expedite_volume"))


def _label_sql(col: str, labels: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {O.q(k)} THEN {O.q(v)}" for k, v in labels.items()) + " END"


@register("decision_distribution", O.decisions_sql(f"""
SELECT decision, {_label_sql('decision', K.DECISION_LABELS)} AS label, {_label_sql('decision', K.DECISION_LABELS_EN)}
       AS label_en, COUNT(*) AS rows, ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM {DEC}), 8) AS percent
FROM {DEC} GROUP BY decision"""))
def q_decision_distribution(spark, sf_dir):
    return round_doubles(V.decision_distribution(decisions_df(spark, sf_dir)), ("percent",))


@register("decision_distribution_by_channel", O.decisions_sql(f"""
SELECT channel, decision, {_label_sql('decision', K.DECISION_LABELS)} AS label,
       {_label_sql('decision', K.DECISION_LABELS_EN)} AS label_en, COUNT(*) AS rows,
       ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY channel), 8) AS percent
FROM {DEC} GROUP BY channel, decision"""))
def q_decision_distribution_by_channel(spark, sf_dir):
    return round_doubles(V.decision_distribution(decisions_df(spark, sf_dir), by_channel=True), ("percent",))


@register("run_summary_by_channel", O.decisions_sql(f"""
SELECT channel, COUNT(*) AS rows, COUNT(*) FILTER (WHERE decision = 'order') AS order_rows,
       COUNT(*) FILTER (WHERE decision = 'expedite') AS expedite_rows,
       ROUND({_sum_when("decision = 'order'", 'order_qty')}, 8) AS order_qty,
       ROUND({_sum_when("decision = 'expedite'", 'expedite_volume')}, 8) AS expedite_volume
FROM {DEC} GROUP BY channel"""))
def q_run_summary_by_channel(spark, sf_dir):
    out = V.run_summary(decisions_df(spark, sf_dir), by_channel=True)
    return round_doubles(out.select("channel", "rows", "order_rows", "expedite_rows", "order_qty", "expedite_volume"),
                         ("order_qty", "expedite_volume"))


@register("run_summary", O.decisions_sql(f"""
SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE decision = 'order') AS order_rows,
       COUNT(*) FILTER (WHERE decision = 'expedite') AS expedite_rows,
       COUNT(*) FILTER (WHERE decision = 'hold') AS hold_rows, COUNT(*) FILTER (WHERE decision = 'no_sales') AS no_sales_rows,
       ROUND({_sum_when("decision = 'order'", 'order_qty')}, 8) AS order_qty,
       ROUND({_sum_when("decision = 'order'", 'order_volume')}, 8) AS order_volume,
       ROUND({_sum_when(f"decision = 'order' AND region = {NORTH}", 'order_volume')}, 8) AS north_order_volume,
       ROUND({_sum_when(f"decision = 'order' AND region = {SOUTH}", 'order_volume')}, 8) AS south_order_volume,
       ROUND({_sum_when("decision = 'expedite'", 'expedite_volume')}, 8) AS expedite_volume,
       ROUND({_sum_when(f"decision = 'expedite' AND region = {NORTH}", 'expedite_volume')}, 8) AS north_expedite_volume,
       ROUND({_sum_when(f"decision = 'expedite' AND region = {SOUTH}", 'expedite_volume')}, 8) AS south_expedite_volume,
       (SELECT COUNT(*) FROM filled WHERE is_discontinued = 1) AS discontinued_dropped
FROM {DEC}"""))
def q_run_summary(spark, sf_dir):
    td = adapter(spark, sf_dir)
    dem = _demand(td)
    dec = RP.replenishment(td.stock_wide(), td.po_file(), dem, settings(spark, td))
    dropped = RP.discontinued_dropped(td.stock_wide(), td.po_file(), dem)
    out = V.run_summary(dec, dropped)
    return round_doubles(out, [c for c in out.columns if "volume" in c or c == "order_qty"])


@register("top_urgent", O.decisions_sql(f"""
SELECT channel, sku, region, decision, total_stock, ROUND(daily_demand, 8) AS daily_demand,
       ROUND(CASE WHEN daily_demand > 0 THEN total_stock / daily_demand ELSE 999.0 END, 8) AS days_of_supply
FROM {DEC} WHERE decision IN ('order', 'expedite')
ORDER BY CASE WHEN daily_demand > 0 THEN total_stock / daily_demand ELSE 999.0 END, sku, region, channel LIMIT 30"""))
def q_top_urgent(spark, sf_dir):
    df = V.top_urgent(decisions_df(spark, sf_dir), 30)
    return round_doubles(df.select("channel", "sku", "region", "decision", "total_stock", "daily_demand",
                                   "days_of_supply"), ("daily_demand", "days_of_supply"))


@register("top_urgent_by_channel", O.decisions_sql(f"""
SELECT channel, sku, region, decision, total_stock, ROUND(daily_demand, 8) AS daily_demand, ROUND(days, 8) AS days_of_supply
FROM (SELECT *, CASE WHEN daily_demand > 0 THEN total_stock / daily_demand ELSE 999.0 END AS days,
             ROW_NUMBER() OVER (PARTITION BY channel ORDER BY CASE WHEN daily_demand > 0 THEN total_stock / daily_demand
                                ELSE 999.0 END, sku, region) AS n FROM {DEC} WHERE decision IN ('order', 'expedite'))
WHERE n <= 30"""))
def q_top_urgent_by_channel(spark, sf_dir):
    df = V.top_urgent(decisions_df(spark, sf_dir), 30, by_channel=True)
    return round_doubles(df.select("channel", "sku", "region", "decision", "total_stock", "daily_demand",
                                   "days_of_supply"), ("daily_demand", "days_of_supply"))


@register("active_rows", O.decisions_sql(f"SELECT channel, sku, region, decision FROM {DEC} WHERE decision IN ('order', 'expedite')"))
def q_active_rows(spark, sf_dir):
    return V.per_decision(decisions_df(spark, sf_dir), (K.ORDER, K.EXPEDITE)).select("channel", "sku", "region", "decision")


@register("replace_channel_empty", O.decisions_sql(f"SELECT channel, sku, region, decision FROM {DEC} WHERE channel <> '{EMPTIED}'"))
def q_replace_channel_empty(spark, sf_dir):
    """H3 as a table: a channel whose new result is empty keeps no old rows."""
    out = f"{scratch_dir(spark, 'replace')}/decisions"
    dec = decisions_df(spark, sf_dir).select("channel", "sku", "region", "decision")
    SN.commit(dec, out)
    SN.commit(dec.limit(0), out, [EMPTIED])
    return SN.read(spark, out)


FAMILY_CASES = {
    "family_filter_exact": (K.SOUTH, None, "economy"),
    "family_filter_contains": (K.NORTH, K.ORDER, "ar"),
    "family_filter_fallback": (K.SOUTH, K.EXPEDITE, "anvil"),
}
VIEW_COLS = ("channel", "sku", "region", "product_family", "name", "decision")


def _family_sql(region, decision, text) -> str:
    conds = [f"region = {O.q(region)}"] + ([f"decision = {O.q(decision)}"] if decision else [])
    cols = ", ".join(VIEW_COLS)
    t = O.q(text.lower())
    return O.decisions_sql(f"""
, v AS (SELECT {cols} FROM {DEC} WHERE {' AND '.join(conds)}),
tiers AS (
  SELECT *, 1 AS tier FROM v WHERE lower(product_family) = {t}
  UNION ALL SELECT *, 2 FROM v WHERE regexp_matches(lower(product_family), {t})
  UNION ALL SELECT {cols}, 3 FROM {DEC} WHERE regexp_matches(lower(product_family), {t}) OR regexp_matches(lower(name), {t}))
SELECT {cols} FROM tiers WHERE tier = (SELECT MIN(tier) FROM tiers)""").replace("\n, v AS", ", v AS")


def _family_query(region, decision, text) -> Query:
    def run(spark, sf_dir):
        # the search needs the best tier over all rows before it filters, so the
        # decision result is materialised once (reliable checkpoint) and read twice
        dec = cut_lineage(decisions_df(spark, sf_dir).select(*VIEW_COLS))
        return V.search_family(dec, text, region, decision)
    return run


for _name, (_r, _d, _t) in FAMILY_CASES.items():
    register(_name, _family_sql(_r, _d, _t))(_family_query(_r, _d, _t))


@register("family_facets", O.with_ctes(O.ADAPTER, O.STOCK_LONG) + """
SELECT DISTINCT channel, product_family FROM stock_long WHERE product_family IS NOT NULL AND product_family <> ''""")
def q_family_facets(spark, sf_dir):
    return ST.family_facets(ST.stock_long(adapter(spark, sf_dir).stock_wide()))


@register("sorted_view", O.decisions_sql(f"""
SELECT channel, sku, region, decision, ROUND(daily_demand, 8) AS daily_demand FROM {DEC}
ORDER BY daily_demand DESC NULLS LAST, sku ASC NULLS LAST"""))
def q_sorted_view(spark, sf_dir):
    df = V.sort_view(decisions_df(spark, sf_dir), "daily_demand", False, "sku", True)
    return round_doubles(df.select("channel", "sku", "region", "decision", "daily_demand"), ("daily_demand",))


@register("display_view", O.decisions_sql(f"""
SELECT channel, sku, name, product_family, region, {_pf('on_hand', 0)} AS on_hand, {_pf('in_transit', 0)} AS in_transit,
       {_pf('in_production', 0)} AS in_production, {_pf('total_stock', 0)} AS total_stock,
       {_pf('demand_8_30', 3)} AS demand_8_30, {_pf('demand_15', 3)} AS demand_15, {_pf('demand_30', 3)} AS demand_30,
       {_pf('daily_demand', 3)} AS daily_demand, demand_source, {_pf('lead_time_need', 1)} AS lead_time_need,
       {_pf('logistics_need', 1)} AS logistics_need, {_label_sql('decision', K.DECISION_LABELS)} AS decision,
       {_dash('order_qty', 0)} AS order_qty, {_pf('unit_volume', 5)} AS unit_volume,
       {_dash('order_volume', 4)} AS order_volume, {_dash('expedite_qty', 0)} AS expedite_qty,
       {_dash('expedite_volume', 4)} AS expedite_volume, {EXPLANATION_SQL} AS explanation
FROM decisions_v ORDER BY priority, sku"""))
def q_display_view(spark, sf_dir):
    return V.display(V.sort_view(decisions_df(spark, sf_dir), "priority", True, "sku", True))


# ---------------------------------------------------------------- settings
SETTINGS_SQL = O.with_ctes(O.ADAPTER)


@register("settings_effective", SETTINGS_SQL + """
SELECT channel, CAST(lead_time AS BIGINT) AS lead_time, CAST(logistics_time AS BIGINT) AS logistics_time, settings_source
FROM settings_eff""")
def q_settings_effective(spark, sf_dir):
    df = settings(spark, adapter(spark, sf_dir))
    return df.select("channel", F.col("lead_time").cast("bigint").alias("lead_time"),
                     F.col("logistics_time").cast("bigint").alias("logistics_time"), "settings_source")


@register("settings_sync", SETTINGS_SQL + """
SELECT CAST(NULL AS VARCHAR) AS entry, 90::BIGINT AS lead_time, 30::BIGINT AS logistics_time, 'default' AS note
UNION ALL
SELECT channel, CAST(lead_time AS BIGINT), CAST(logistics_time AS BIGINT),
       CASE WHEN channel = '905' THEN 'slow supplier' ELSE 'default' END FROM settings_eff""")
def q_settings_sync(spark, sf_dir):
    td = adapter(spark, sf_dir)
    df = sync_settings(td.channels(), settings_from_text(spark, settings_json()))
    return df.select("entry", F.col("lead_time").cast("bigint").alias("lead_time"),
                     F.col("logistics_time").cast("bigint").alias("logistics_time"), "note")


# ---------------------------------------------------------------- accumulate
OVERRIDE_CHANNELS = ("901", "905")
OVERRIDE_LEAD, OVERRIDE_LOG = 200, 60


def _accumulated(spark, sf_dir) -> DataFrame:
    td = adapter(spark, sf_dir)
    dem = cut_lineage(_demand(td))  # both results read it, each with filters of its own
    base = RP.replenishment(td.stock_wide(), td.po_file(), dem, settings(spark, td))
    ovr = spark.createDataFrame([(c, OVERRIDE_LEAD, OVERRIDE_LOG) for c in OVERRIDE_CHANNELS],
                                "channel string, lead_time int, logistics_time int")
    chans = td.channels().filter(F.col("channel").isin(*OVERRIDE_CHANNELS))
    eff = effective_settings(chans, settings_from_text(spark, settings_json()), ovr)
    new = RP.replenishment(td.stock_wide().filter(F.col("channel").isin(*OVERRIDE_CHANNELS)),
                           td.po_file().filter(F.col("channel").isin(*OVERRIDE_CHANNELS)),
                           dem.filter(F.col("channel").isin(*OVERRIDE_CHANNELS)), eff)
    new = cut_lineage(new)  # read for its rows and for its channels
    return WR.replace_channels(base, new)


ACCUMULATE_SQL_OVR = f"""
settings_ovr AS (
  SELECT channel, CASE WHEN channel IN {O.in_list(OVERRIDE_CHANNELS)} THEN {OVERRIDE_LEAD} ELSE lead_time END AS lead_time,
         CASE WHEN channel IN {O.in_list(OVERRIDE_CHANNELS)} THEN {OVERRIDE_LOG} ELSE logistics_time END AS logistics_time
  FROM settings_eff)"""


@register("accumulate_replace", O.decision_ctes(ACCUMULATE_SQL_OVR, "settings_ovr") + """
SELECT channel, sku, region, decision, CAST(lead_time AS BIGINT) AS lead_time, ROUND(order_qty, 8) AS order_qty
FROM decisions_v""")
def q_accumulate_replace(spark, sf_dir):
    df = _accumulated(spark, sf_dir).select("channel", "sku", "region", "decision",
                                             F.col("lead_time").cast("bigint").alias("lead_time"), "order_qty")
    return round_doubles(df, ("order_qty",))


@register("accumulated_info", O.decisions_sql("""
SELECT COUNT(*) AS rows, COUNT(DISTINCT channel) AS n_channels,
       string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM decisions_v"""))
def q_accumulated_info(spark, sf_dir):
    info = V.accumulated_info(_accumulated(spark, sf_dir))
    return info.select("rows", F.size("channels").cast("bigint").alias("n_channels"),
                       F.concat_ws(",", "channels").alias("channels"))


# ---------------------------------------------------------------- quality
def _demand_files(spark, sf_dir) -> DataFrame:
    """The three demand outputs as the demand "files" of each channel (the
    8-30 and 15 files carry WindowType; 30 does not)."""
    erp = adapter(spark, sf_dir).erp()
    variants = ("8_30", "15", "30")
    perf = W.key_demand(W.demand_windows(erp, AS_OF, variants, SALES_FROM, SALES_TO, with_refs=False), variants)
    win = F.create_map(F.lit("8_30"), F.lit("8-30"), F.lit("15"), F.lit("15"), F.lit("30"), F.lit("30"))
    base = perf.select(
        "channel", F.col("sku").alias("Sku"), F.col("region").alias("Region"), win[F.col("variant")].alias("window"),
        F.when(F.col("variant") != "30", win[F.col("variant")]).alias("WindowType"),
        F.when(F.col("variant") != "30", K.HEADER_SEP.join(("Sku", "Region", "WindowType"))).otherwise(K.HEADER_SEP.join(("Sku", "Region"))).alias("_header"),
        F.col("avg_main").cast("string").alias("AvgDailyDemand_3Checkins_Avg"))
    return base


@register("quality_completeness", O.decision_ctes() + f"""
SELECT c.channel, f.file, COALESCE(p.present, FALSE) AS present
FROM channels c CROSS JOIN (VALUES {', '.join(f"('{x}')" for x in K.REQUIRED_FILES)}) f(file)
LEFT JOIN (
  SELECT DISTINCT channel, 'stock.csv' AS file, TRUE AS present FROM stock_file
  UNION SELECT DISTINCT channel, 'PO.csv', TRUE FROM po_file
  UNION SELECT DISTINCT channel, 'Sales 8-30.csv', TRUE FROM kd_8_30
  UNION SELECT DISTINCT channel, 'Sales 15.csv', TRUE FROM kd_15
  UNION SELECT DISTINCT channel, 'Sales 30.csv', TRUE FROM kd_30) p ON p.channel = c.channel AND p.file = f.file""")
def q_quality_completeness(spark, sf_dir):
    td = adapter(spark, sf_dir)
    dem = _demand(td)
    names = F.create_map(F.lit("8-30"), F.lit("Sales 8-30.csv"), F.lit("15"), F.lit("Sales 15.csv"),
                         F.lit("30"), F.lit("Sales 30.csv"))
    files = (td.stock_wide().select("channel", F.lit("stock.csv").alias("file"))
             .unionByName(td.po_file().select("channel", F.lit("PO.csv").alias("file")))
             .unionByName(dem.select("channel", names[F.col("window")].alias("file"))))
    return QC.file_presence(td.channels(), files)


@register("quality_window_type", O.decision_ctes() + """
SELECT channel, "window", COUNT(DISTINCT wt) AS distinct_values, MAX(wt) AS value,
       COUNT(DISTINCT wt) = 1 AND MAX(wt) <> '' AND MAX(wt) <> "window" AS warn
FROM (SELECT channel, '8-30' AS "window", '8-30' AS wt FROM fin_8_30 UNION ALL SELECT channel, '15', '15' FROM fin_15)
GROUP BY channel, "window"
""")
def q_quality_window_type(spark, sf_dir):
    return QC.window_type_status(_demand_files(spark, sf_dir))


@register("quality_same_demand", O.decision_ctes() + """
SELECT a.channel, COUNT(*) AS common_keys, COUNT(*) FILTER (WHERE round_even(a.value * 1e6, 0) / 1e6 = round_even(b.value * 1e6, 0) / 1e6) AS equal_keys,
       COUNT(*) > 0 AND COUNT(*) = COUNT(*) FILTER (WHERE round_even(a.value * 1e6, 0) / 1e6
                                                    = round_even(b.value * 1e6, 0) / 1e6) AS warn
FROM kd_8_30 a JOIN kd_30 b USING (channel, sku, region) GROUP BY a.channel""")
def q_quality_same_demand(spark, sf_dir):
    return QC.same_demand_status(_demand_files(spark, sf_dir))


@register("quality_same_diag", O.with_ctes(O.ADAPTER, O.SALES, O.window_ctes("8_30"), O.window_ctes("30_aligned")) + """
SELECT a.channel, COUNT(*) AS common_rows,
       bool_and(a.sample_start IS NOT DISTINCT FROM b.sample_start AND a.sample_days IS NOT DISTINCT FROM b.sample_days
                AND a.sample_qty IS NOT DISTINCT FROM b.sample_qty) AS same
FROM (SELECT DISTINCT channel, sku, region, checkin_date, sample_start, sample_days, sample_qty FROM fin_8_30) a
JOIN (SELECT DISTINCT channel, sku, region, checkin_date, sample_start, sample_days, sample_qty FROM fin_30_aligned) b
USING (channel, sku, region, checkin_date) GROUP BY a.channel""")
def q_quality_same_diag(spark, sf_dir):
    erp = adapter(spark, sf_dir).erp()
    perf = W.demand_windows(erp, AS_OF, ("8_30", "30_aligned"), SALES_FROM, SALES_TO)
    win = F.when(F.col("variant") == "8_30", F.lit("8-30")).otherwise(F.lit("30"))
    files = perf.select("channel", F.col("sku").alias("Sku"), F.col("region").alias("Region"), win.alias("window"),
                        F.col("checkin_date").alias("CheckinDate"), F.col("sample_start").alias("SampleStart"),
                        F.col("sample_days").alias("SampleDays"), F.col("sample_qty").alias("SampleQty"))
    return QC.same_diagnostics_status(files)


# ---------------------------------------------------------------- sinks (K1, K2, K4) and streaming
_REPORT_TEXT = {"image_url": "COALESCE(image_url, '')", "explanation": EXPLANATION_SQL}
REPORT_SQL_COLS = ", ".join(
    f'{_label_sql(c, K.DECISION_LABELS) if c == "decision" else (f"ROUND({c}, 8)" if c in DECISION_DOUBLES else _REPORT_TEXT.get(c, c))} AS "{h}"'
    for c, h in WR.REPORT_COLUMNS)


@register("report", O.decisions_sql(f"SELECT {REPORT_SQL_COLS} FROM {DEC} LEFT JOIN {IMAGES} img USING (channel, sku)"))
def q_report(spark, sf_dir):
    rep = WR.report(decisions_df(spark, sf_dir))
    heads = dict(WR.REPORT_COLUMNS)
    rep = rep.withColumn(heads["image_url"], F.coalesce(F.col(heads["image_url"]), F.lit("")))
    return round_doubles(rep, [heads[c] for c in DECISION_DOUBLES if c in heads])


@register("report_summary", O.decisions_sql(f"""
SELECT channel, ROUND(ov, 8) AS order_volume, ROUND(nov, 8) AS north_order_volume, ROUND(sov, 8) AS south_order_volume,
       ROUND(ev, 8) AS expedite_volume, ROUND(nev, 8) AS north_expedite_volume, ROUND(sev, 8) AS south_expedite_volume,
       {NORTH} || ':' || CASE WHEN nov >= 69.0 THEN '{WR.BOOKABLE}' ELSE '{WR.NOT_FULL}' END || ', ' || {SOUTH} || ':' ||
       CASE WHEN sov >= 69.0 THEN '{WR.BOOKABLE}' ELSE '{WR.NOT_FULL}' END AS container_status
FROM (SELECT channel, {_sum_when("decision = 'order'", 'order_volume')} AS ov,
             {_sum_when(f"decision = 'order' AND region = {NORTH}", 'order_volume')} AS nov,
             {_sum_when(f"decision = 'order' AND region = {SOUTH}", 'order_volume')} AS sov,
             {_sum_when("decision = 'expedite'", 'expedite_volume')} AS ev,
             {_sum_when(f"decision = 'expedite' AND region = {NORTH}", 'expedite_volume')} AS nev,
             {_sum_when(f"decision = 'expedite' AND region = {SOUTH}", 'expedite_volume')} AS sev
      FROM {DEC} GROUP BY channel)"""))
def q_report_summary(spark, sf_dir):
    df = WR.report_summary(decisions_df(spark, sf_dir))
    return round_doubles(df, [c for c in df.columns if "volume" in c])


RUN_TS = "20010630_0000"


@register("run_log", O.decisions_sql(f"""
SELECT channel, COUNT(*) AS rows, COUNT(*) FILTER (WHERE decision = 'order') AS order_rows,
       ROUND({_sum_when(f"decision = 'order' AND region = {NORTH}", 'order_volume')}, 8) AS north_volume,
       ROUND({_sum_when(f"decision = 'order' AND region = {SOUTH}", 'order_volume')}, 8) AS south_volume,
       '{RUN_TS}' AS archive FROM {DEC} GROUP BY channel"""))
def q_run_log(spark, sf_dir):
    """Archive the decisions (K3), append the run log (K4), read the log back."""
    scratch = scratch_dir(spark, "runlog")
    dec = decisions_df(spark, sf_dir)
    WR.archive(dec, f"{scratch}/archive", RUN_TS)
    archived = spark.read.parquet(f"{scratch}/archive").filter(F.col("run_ts") == RUN_TS)
    archived = archived.withColumn("channel", F.col("channel").cast("string"))
    WR.append_run_log(archived, f"{scratch}/scan_log", RUN_TS)
    return round_doubles(spark.read.parquet(f"{scratch}/scan_log"), ("north_volume", "south_volume"))


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


@register("stream_scan", FULL_SQL)
def q_stream_scan(spark, sf_dir):
    """S1/S2 end to end: the channel inputs land as files partitioned by
    channel; the streaming scan (availableNow) recomputes the touched channels
    and overwrites their partitions of the decision table, read back here."""
    td = adapter(spark, sf_dir)
    scratch = scratch_dir(spark, "stream")
    land = f"{scratch}/landing"
    dem = _demand(td)
    for kind, df in (("stock", td.stock_wide()), ("po", td.po_file()), ("demand", dem)):
        df.write.partitionBy("channel").option("header", True).csv(f"{land}/{kind}")
    query = SC.stream_scan(spark, land, f"{scratch}/decisions", f"{scratch}/_checkpoint",
                           settings_from_text(spark, settings_json()), available_now=True)
    query.awaitTermination()
    return decisions_out(SN.read(spark, f"{scratch}/decisions"))


# ---------------------------------------------------------------- rescans of rewritten files
REWRITTEN = ("903", "917")
REWRITTEN_BY = 400


def place_files(spark: SparkSession, df: DataFrame, folder: str, name: str, prefix: str = "channel=") -> None:
    """One CSV file ``<folder>/<prefix><c>/<name>`` per channel, written over the old one."""
    aside = f"{scratch_dir(spark, 'place')}/files"
    df.repartition("channel").write.partitionBy("channel").option("header", True).csv(aside)
    src, dst = SN.Folder(spark, aside), SN.Folder(spark, folder)
    for part in src.names(""):
        if part.startswith("channel="):
            to = prefix + part[len("channel="):]
            dst.fs.mkdirs(dst.at(to))
            (file,) = [n for n in src.names(part) if n.endswith(".csv")]
            dst.delete(f"{to}/{name}")
            dst.fs.rename(src.at(f"{part}/{file}"), dst.at(f"{to}/{name}"))


@register("rescan_rewritten", FULL_SQL.replace(
    "CAST(p_size - 20 AS DOUBLE) AS SouthIslandStock",
    f"CAST(p_size - 20 + CASE WHEN {O.channel_of_brand('p_brand')} IN {O.in_list(REWRITTEN)} THEN {REWRITTEN_BY} ELSE 0 END AS DOUBLE) "
    "AS SouthIslandStock"))
def q_rescan_rewritten(spark, sf_dir):
    """S1 with files that are rewritten in place: the scan runs, the stock files of two
    channels are written again under the same names, the scan goes on from its
    checkpoint; the result is that of the new files for these and as it was for others."""
    td = adapter(spark, sf_dir)
    scratch = scratch_dir(spark, "rescan")
    land = f"{scratch}/landing"
    for kind, df in (("stock", td.stock_wide()), ("po", td.po_file()), ("demand", _demand(td))):
        place_files(spark, df, f"{land}/{kind}", f"{kind}.csv")

    def scan() -> None:
        SC.stream_scan(spark, land, f"{scratch}/decisions", f"{scratch}/_checkpoint",
                       settings_from_text(spark, settings_json()), available_now=True).awaitTermination()

    scan()
    again = td.stock_wide().filter(F.col("channel").isin(*REWRITTEN)).withColumn(
        "SouthIslandStock", (F.col("SouthIslandStock").cast("int") + REWRITTEN_BY).cast("string"))
    place_files(spark, again, f"{land}/stock", "stock.csv")
    scan()
    return decisions_out(SN.read(spark, f"{scratch}/decisions"))


# ---------------------------------------------------------------- orders made visible
@register("default_order", O.decisions_sql(f"""
SELECT ROW_NUMBER() OVER (ORDER BY CASE decision WHEN 'order' THEN 0 WHEN 'expedite' THEN 1 WHEN 'hold' THEN 2 ELSE 3 END, sku, region, channel) AS place,
       channel, sku, region FROM {DEC}"""))
def q_default_order(spark, sf_dir):
    dec = decisions_df(spark, sf_dir).select("priority", "sku", "region", "channel")
    return with_places(D.default_order(dec)).select("place", "channel", "sku", "region")


@register("demand_order", O.with_ctes(O.ADAPTER, O.SALES, O.window_ctes("8_30")) + """
SELECT ROW_NUMBER() OVER (ORDER BY sku, region, checkin_date DESC) AS place, sku, region, checkin_date FROM fin_8_30""")
def q_demand_order(spark, sf_dir):
    df = W.window_report(adapter(spark, sf_dir).erp(), "8_30", AS_OF, SALES_FROM, SALES_TO)
    return with_places(W.demand_order(df)).select("place", "sku", "region", "checkin_date")


@register("sorted_places", O.decisions_sql(f"""
SELECT RANK() OVER (ORDER BY daily_demand DESC NULLS LAST, sku) AS place, channel, sku, region FROM {DEC}"""))
def q_sorted_places(spark, sf_dir):
    """Rows that the two sort columns do not tell apart share their first place."""
    dec = decisions_df(spark, sf_dir).select("daily_demand", "sku", "region", "channel")
    df = with_places(V.sort_view(dec, "daily_demand", False, "sku", True))
    return df.select(F.min("place").over(Window.partitionBy("daily_demand", "sku")).alias("place"), "channel", "sku", "region")


# ---------------------------------------------------------------- one SKU, some channels
@register("window_single_sku", O.window_sql("8_30") + " WHERE sku = (SELECT max(sku) FROM fin_8_30)")
def q_window_single_sku(spark, sf_dir):
    """The SKU is pushed into the product dimension."""
    erp = adapter(spark, sf_dir).erp()
    sku = W.window_report(erp, "8_30", AS_OF, SALES_FROM, SALES_TO).agg(F.max("sku")).first()[0]
    return W.window_report(erp, "8_30", AS_OF, SALES_FROM, SALES_TO, sku=sku)


SOME_CHANNELS = ("903", "911", "925")


@register("window_channels", O.window_sql("15") + f" WHERE channel IN {O.in_list(SOME_CHANNELS)}")
def q_window_channels(spark, sf_dir):
    """Sales and restocks of other channels are dropped at their first join."""
    return W.window_report(adapter(spark, sf_dir).erp(), "15", AS_OF, SALES_FROM, SALES_TO, channels=SOME_CHANNELS)


# ---------------------------------------------------------------- input gate
FILE_OF_WINDOW = {w: f for w, f in K.DEMAND_FILES}


@register("input_gate", O.decision_ctes() + f"""
, there AS (
  SELECT DISTINCT channel, 'stock.csv' AS file FROM stock_file UNION SELECT DISTINCT channel, 'PO.csv' FROM po_file
  UNION SELECT DISTINCT channel, 'Sales 8-30.csv' FROM kd_8_30 UNION SELECT DISTINCT channel, 'Sales 15.csv' FROM kd_15 WHERE CAST(channel AS INT) % 5 <> 1
  UNION SELECT DISTINCT channel, 'Sales 30.csv' FROM kd_30)
SELECT c.channel, f.file, f.file || CASE WHEN t.file IS NULL THEN ' is missing' WHEN f.file = 'stock.csv' THEN ' lacks PriceRadarVolume, IsDiscontinued'
                                         ELSE ' lacks Sku, Region' END AS problem
FROM channels c CROSS JOIN (VALUES {', '.join(f"('{x}')" for x in K.REQUIRED_FILES)}) f(file)
LEFT JOIN there t ON t.channel = c.channel AND t.file = f.file
WHERE t.file IS NULL OR (f.file = 'stock.csv' AND CAST(c.channel AS INT) % 5 = 2) OR (f.file = 'PO.csv' AND CAST(c.channel AS INT) % 5 = 3)""")
def q_input_gate(spark, sf_dir):
    """J1, J2 over channel folders: some lack a file, in some the stock file lacks two
    columns, in some a quoted comma makes two columns of PO.csv one."""
    td = adapter(spark, sf_dir)
    root, fifth = f"{scratch_dir(spark, 'gate')}/channels", F.col("channel").cast("int") % 5
    stock, po = td.stock_wide(), td.po_file()
    place_files(spark, stock.filter(fifth != 2), root, "stock.csv", "")
    place_files(spark, stock.filter(fifth == 2).drop("PriceRadarVolume", "IsDiscontinued"), root, "stock.csv", "")
    place_files(spark, po.filter(fifth != 3), root, "PO.csv", "")
    place_files(spark, po.filter(fifth == 3).withColumn("Sku,Region", F.concat_ws(",", "Sku", "Region")).drop("Sku", "Region"), root, "PO.csv", "")
    demand = cut_lineage(_demand_files(spark, sf_dir).select("window", "channel", "Sku", "Region", "AvgDailyDemand_3Checkins_Avg"))
    for window, file in FILE_OF_WINDOW.items():
        df = demand.filter(F.col("window") == window).drop("window")
        place_files(spark, df.filter(fifth != 1) if file == "Sales 15.csv" else df, root, file, "")
    return CF.input_problems(td.channels(), CF.channel_inputs(spark, root, CF.list_channels(spark, root)))


# ---------------------------------------------------------------- warnings (J6), archive (K3), one setting (K6)
@register("quality_report", O.decision_ctes() + """
SELECT channel, 'window_type' AS check, 'Sales 15 WindowType=8-30, expected 15' AS message FROM (SELECT DISTINCT channel FROM kd_15) WHERE CAST(channel AS INT) % 4 = 1
UNION ALL
SELECT channel, 'same_demand', '8-30 and 30 demand identical'
FROM kd_8_30 a LEFT JOIN kd_30 b USING (channel, sku, region)
WHERE CAST(channel AS INT) % 4 = 2 OR b.channel IS NOT NULL GROUP BY channel
HAVING COUNT(*) = COUNT(*) FILTER (WHERE round_even(a.value * 1e6, 0) = round_even(CASE WHEN CAST(channel AS INT) % 4 = 2 THEN a.value ELSE b.value END * 1e6, 0))""")
def q_quality_report(spark, sf_dir):
    """In some channels the 15 file carries the other file's WindowType, in some the
    30 file is a copy of the 8-30 file's demand."""
    files = cut_lineage(_demand_files(spark, sf_dir))  # the checks read it several times
    fourth = F.col("channel").cast("int") % 4
    wrong = F.when((fourth == 1) & (F.col("window") == "15"), F.lit("8-30")).otherwise(F.col("WindowType"))
    own = files.filter((fourth != 2) | (F.col("window") != "30")).withColumn("WindowType", wrong)
    copied = files.filter((fourth == 2) & (F.col("window") == "8-30")).withColumns({
        "window": F.lit("30"), "WindowType": F.lit(None).cast("string"), "_header": F.lit(K.HEADER_SEP.join(("Sku", "Region")))})
    return QC.quality_report(own.unionByName(copied))


@register("archive_stamps", O.decisions_sql(f"""
SELECT run_ts, channel, sku, region, CASE WHEN run_ts = 'a' AND channel = '{EMPTIED}' THEN 'again' ELSE decision END AS decision
FROM {DEC} CROSS JOIN (VALUES ('a'), ('b')) t(run_ts)"""))
def q_archive_stamps(spark, sf_dir):
    """K3: two run stamps; one channel of the first is archived again."""
    out = f"{scratch_dir(spark, 'archive')}/archive"
    dec = cut_lineage(decisions_df(spark, sf_dir).select("channel", "sku", "region", "decision"))  # written three times
    for stamp in ("a", "b"):
        WR.archive(dec, out, stamp)
    WR.archive(dec.filter(F.col("channel") == EMPTIED).withColumn("decision", F.lit("again")), out, "a")
    return spark.read.schema("sku string, region string, decision string, channel string, run_ts string").parquet(out)


@register("settings_upsert", SETTINGS_SQL + """
SELECT CAST(NULL AS VARCHAR) AS entry, 90::BIGINT AS lead_time, 30::BIGINT AS logistics_time
UNION ALL
SELECT channel, CASE WHEN channel IN ('901', '905') THEN 111 ELSE CAST(lead_time AS BIGINT) END,
       CASE WHEN channel IN ('901', '905') THEN 11 ELSE CAST(logistics_time AS BIGINT) END FROM settings_eff""")
def q_settings_upsert(spark, sf_dir):
    """K6 after K5, through the document that K6 writes and the reader takes."""
    synced = sync_settings(adapter(spark, sf_dir).channels(), settings_from_text(spark, settings_json()))
    rows = spark.createDataFrame([("901", 111, 11, "x"), ("905", 111, 11, "x")], synced.schema)
    text = settings_document(upsert_setting(synced, rows)).first()[0]
    return settings_from_text(spark, text).select("entry", F.col("lead_time").cast("bigint").alias("lead_time"),
                                                  F.col("logistics_time").cast("bigint").alias("logistics_time"))


# ---------------------------------------------------------------- stock snapshots as JSON
@register("snapshot_json", f"""
WITH s AS (SELECT l_partkey % 12 AS kind, {O.sguid('l_suppkey')} AS g, '[{{"WarehouseId":"' || {O.sguid('l_suppkey')} || '"}}]' AS w FROM lineitem),
t AS (SELECT kind, CASE kind
        WHEN 0 THEN w WHEN 1 THEN w || ' x' WHEN 2 THEN w || w WHEN 3 THEN left(w, length(w) - 1) WHEN 4 THEN replace(w, '"', chr(39))
        WHEN 5 THEN chr(65279) || w WHEN 6 THEN substr(w, 2, length(w) - 2) WHEN 7 THEN ' ' || chr(10) || w || chr(9)
        WHEN 8 THEN '[{{"Note":"it' || chr(39) || 's [a] \\"b\\" {{","WarehouseId":"' || g || '"}}]'
        WHEN 9 THEN left(w, length(w) - 1) || ', {{"WarehouseId":"other"}}]' WHEN 10 THEN '"' || g || '"' END AS x FROM s)
SELECT kind, coalesce(json_valid(x) AND regexp_matches(x, '^[ \\t\\r\\n]*[\\[{{]'), FALSE) AS is_json,
       CASE WHEN json_valid(x) THEN json_extract_string(x, '$[0].WarehouseId') END AS warehouse_id, COUNT(*) AS n
FROM t GROUP BY ALL""")
def q_snapshot_json(spark, sf_dir):
    """Snapshots of every line, whole ones and ones that are broken in some way."""
    rows = adapter(spark, sf_dir).odd_snapshots().select(
        "kind", S.is_json("x").alias("is_json"), S.json_first_warehouse("x").alias("warehouse_id"))
    return rows.groupBy("kind", "is_json", "warehouse_id").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
