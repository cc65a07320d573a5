"""Replenishment decisions per (channel, sku, region).

The key spine (H2) and the six left joins of the source (D7) are one
``unionByName`` of long rows plus a single ``groupBy``: one shuffle on the key
instead of six joins.  Decisions are ``when`` chains (no row UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import predicates as P
from ..functions import scalar as S
from .util import DEAL, broadcast_if_small

KEY = ("channel", "sku", "region")
DEMAND_COLS = {"8-30": "demand_8_30", "15": "demand_15", "30": "demand_30"}

# FIXED VALUES: explanation texts of each decision (format patterns; the numbers
# are formatted as Python formats floats, see functions.scalar.py_fixed).
TEXT_NO_SALES = "无销售记录，当前库存: 现货%s+在途%s+在产%s"
TEXT_ORDER = "总库存%s≤%d天需求(%s)，缺口%s，体积%sm³，基于%s"
TEXT_EXPEDITE = "现货+在途%s≤%d天物流需求(%s)，需催发%s件(物流预估-现货-在途)，催发货体积%sm³"
TEXT_HOLD_NOTHING_TO_EXPEDITE = "现货+在途%s≤%d天物流需求(%s)，无在产可催，总库存可撑%s天"
TEXT_HOLD = "库存充足(现货%s+在途%s+在产%s)，基于%s可撑%s天"


def _long(df: DataFrame, **cols: Column) -> DataFrame:
    all_cols = ["on_hand", "unit_volume", "is_discontinued", "name", "product_family", "image_url",
                "transit_qty", "production_qty", "demand_8_30", "demand_15", "demand_30", "in_stock_file"]
    types = {"is_discontinued": "int", "name": "string", "product_family": "string", "image_url": "string",
             "in_stock_file": "boolean"}
    return df.select(*KEY, *[(cols[c] if c in cols else F.lit(None)).cast(types.get(c, "double")).alias(c)
                             for c in all_cols])


def key_spine(*frames: DataFrame) -> DataFrame:
    """H2: distinct union of the keys of all inputs."""
    out = frames[0].select(*KEY)
    for f in frames[1:]:
        out = out.unionByName(f.select(*KEY))
    return out.distinct()


def demand_rows(demand: DataFrame) -> DataFrame:
    """Long demand rows (channel, sku, region, window, value) -> one column per window."""
    w = F.col("window")
    return demand.select(*KEY, *[F.when(w == win, F.col("value")).alias(col) for win, col in DEMAND_COLS.items()])


def assemble(stock: DataFrame, po_rows: DataFrame, demand: DataFrame) -> DataFrame:
    """H2 + D7 + E5 + E6 + B14 in one aggregation.

    ``stock``: one row per key (after E16); ``po_rows``: purchase-order rows
    with transit/production parts; ``demand``: long rows (window, value)."""
    parts = [
        _long(stock, on_hand=F.col("on_hand"), unit_volume=F.col("unit_volume"),
              is_discontinued=F.col("is_discontinued"), name=F.col("name"), product_family=F.col("product_family"),
              image_url=F.col("image_url"), in_stock_file=F.lit(True)),
        # purchase-order rows are many: sum them per key first (a hash aggregate
        # with map-side combine), so the text-carrying aggregate below sees at
        # most a handful of rows per key
        _long(po_rows.groupBy(*KEY).agg(F.sum("transit_qty").alias("transit_qty"),
                                        F.sum("production_qty").alias("production_qty")),
              transit_qty=F.col("transit_qty"), production_qty=F.col("production_qty")),
        _long(demand_rows(demand), demand_8_30=F.col("demand_8_30"), demand_15=F.col("demand_15"),
              demand_30=F.col("demand_30")),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    g = u.groupBy(*DEAL).agg(  # texts are aggregated by a sort
        F.max("on_hand").alias("on_hand"), F.max("unit_volume").alias("unit_volume"),
        F.max("is_discontinued").alias("is_discontinued"), F.max("name").alias("name"),
        F.max("product_family").alias("product_family"), F.max("image_url").alias("image_url"),
        F.sum("transit_qty").alias("in_transit"), F.sum("production_qty").alias("in_production"),
        F.avg("demand_8_30").alias("demand_8_30"), F.avg("demand_15").alias("demand_15"),
        F.avg("demand_30").alias("demand_30"))
    return fill_defaults(g)


def fill_defaults(df: DataFrame) -> DataFrame:
    """Numbers 0, texts ''."""
    return df.select(
        *KEY,
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("on_hand", "in_transit", "in_production")],
        F.coalesce("unit_volume", F.lit(0.0)).alias("unit_volume"),
        F.coalesce("is_discontinued", F.lit(0)).alias("is_discontinued"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", "product_family")],
        F.trim(F.coalesce("image_url", F.lit(""))).alias("image_url"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("demand_8_30", "demand_15", "demand_30")])


def decide(df: DataFrame, settings: DataFrame) -> DataFrame:
    """B16-B25 + C9 + D9: needs from the channel's lead/logistics days, then the
    first matching decision: no sales; total <= lead need -> order; on hand +
    transit <= logistics need with production -> expedite; else hold."""
    s = broadcast_if_small(settings.select("channel", "lead_time", "logistics_time"))
    df = df.filter(P.not_discontinued("is_discontinued")).join(s, "channel", "left")
    lead = F.coalesce("lead_time", F.lit(K.DEFAULT_LEAD_TIME))
    logi = F.coalesce("logistics_time", F.lit(K.DEFAULT_LOGISTICS_TIME))
    df = df.withColumns({"lead_time": lead, "logistics_time": logi, "total_stock": S.total_stock(),
                         "daily_demand": S.daily_demand(), "demand_source": S.demand_source(),
                         "source_tag": S.source_tag()})
    df = df.withColumns({"lead_time_need": F.col("daily_demand") * F.col("lead_time"),
                         "logistics_need": F.col("daily_demand") * F.col("logistics_time")})
    total, daily = F.col("total_stock"), F.col("daily_demand")
    near = F.col("on_hand") + F.col("in_transit")
    production = F.col("in_production")
    dec = (F.when(daily == 0, F.lit(K.NO_SALES))
           .when(total <= F.col("lead_time_need"), F.lit(K.ORDER))
           .when((near <= F.col("logistics_need")) & (production > 0), F.lit(K.EXPEDITE))
           .otherwise(F.lit(K.HOLD)))
    df = df.withColumn("decision", dec)
    d = F.col("decision")
    order_qty = F.when(d == K.ORDER, F.greatest(F.lit(0.0), F.col("lead_time_need") - total)).otherwise(F.lit(0.0))
    exp_qty = F.when(d == K.EXPEDITE, F.greatest(F.lit(0.0), F.col("logistics_need") - near)).otherwise(F.lit(0.0))
    df = df.withColumns({"order_qty": order_qty, "expedite_qty": exp_qty, "priority": S.priority("decision")})
    df = df.withColumns({"order_volume": F.col("order_qty") * F.col("unit_volume"),
                         "expedite_volume": F.col("expedite_qty") * F.col("unit_volume")})
    return with_explanation(df)


def with_explanation(df: DataFrame) -> DataFrame:
    """The five explanation texts (numbers formatted like Python floats)."""
    total, daily = F.col("total_stock"), F.col("daily_demand")
    near = F.col("on_hand") + F.col("in_transit")
    supply_days = F.when(daily > 0, total / daily).otherwise(F.lit(0.0))
    t = S.with_fixed_texts(df, {
        "_t_on_hand": (F.col("on_hand"), 0), "_t_transit": (F.col("in_transit"), 0),
        "_t_production": (F.col("in_production"), 0), "_t_total": (total, 0), "_t_near": (near, 0),
        "_t_lead_need": (F.col("lead_time_need"), 1), "_t_log_need": (F.col("logistics_need"), 1),
        "_t_order_qty": (F.col("order_qty"), 0), "_t_order_vol": (F.col("order_volume"), 4),
        "_t_exp_qty": (F.col("expedite_qty"), 0), "_t_exp_vol": (F.col("expedite_volume"), 4),
        "_t_days": (supply_days, 0)})
    d = F.col("decision")
    c = F.col
    lead_days = c("lead_time").cast("int")
    log_days = c("logistics_time").cast("int")
    no_sales = F.format_string(TEXT_NO_SALES, c("_t_on_hand"), c("_t_transit"), c("_t_production"))
    order = F.format_string(TEXT_ORDER, c("_t_total"), lead_days, c("_t_lead_need"), c("_t_order_qty"),
                            c("_t_order_vol"), c("demand_source"))
    expedite = F.format_string(TEXT_EXPEDITE, c("_t_near"), log_days, c("_t_log_need"), c("_t_exp_qty"),
                               c("_t_exp_vol"))
    hold_nothing = F.format_string(TEXT_HOLD_NOTHING_TO_EXPEDITE, c("_t_near"), log_days, c("_t_log_need"),
                                   c("_t_days"))
    hold = F.format_string(TEXT_HOLD, c("_t_on_hand"), c("_t_transit"), c("_t_production"), c("demand_source"),
                           c("_t_days"))
    nothing_to_expedite = (near <= c("logistics_need")) & (c("in_production") == 0)
    text = (F.when(d == K.NO_SALES, no_sales).when(d == K.ORDER, order).when(d == K.EXPEDITE, expedite)
            .when(nothing_to_expedite, hold_nothing).otherwise(hold))
    return t.withColumn("explanation", text).drop(*[x for x in t.columns if x.startswith("_t_")])


DECISION_COLUMNS = ("channel", "sku", "name", "product_family", "region", "on_hand", "in_transit", "in_production",
                    "total_stock", "demand_8_30", "demand_15", "demand_30", "daily_demand", "demand_source",
                    "source_tag", "lead_time", "logistics_time", "lead_time_need", "logistics_need", "decision",
                    "order_qty", "unit_volume", "order_volume", "expedite_qty", "expedite_volume", "image_url",
                    "priority", "explanation")


def default_order(df: DataFrame) -> DataFrame:
    """G1: priority, SKU (region and channel added to break ties)."""
    return df.orderBy("priority", "sku", "region", "channel")
