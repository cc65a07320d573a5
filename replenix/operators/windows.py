"""Restock windows (the P1 variants) as data, their sums over daily sales
(D5, D6), window performance (E3, E4) and the three averages (F2, F3, F4).

All variants that are asked for run in one plan: each restock event is
exploded into one row per variant (a generator, not a join), so the sales scan,
the daily aggregate and the join on the key are shared."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import predicates as P
from ..functions import scalar as S
from ..sources.erp import Erp
from . import restocks as R
from . import sales as SL
from .util import DEAL


@dataclass(frozen=True)
class WindowSpec:
    """One demand window (a sales-window template)."""
    name: str                  # window_type text
    policy: str                # sale date: "paid" (coalesce) or "created"
    transfers: bool            # transfers are restocks too
    keep_null_type: bool       # a transfer with null type is kept
    merge_same_day: bool       # E2
    ref_style: str             # "plain" | "reference" (transfer id/type as refs)
    kind: str                  # "day_window" | "thirty" (the 30-day template as shipped)
    start_offset: int          # first sales day = checkin + start_offset
    end_offset: int            # last sales day of a complete window
    partial_rule: str          # "between": today in [c+1, c+end-1]; "before_end": today < c+end
    main_avg: str              # "mature" (F2) | "all" (F3) | "float_all" (30)
    days_with_sales_rule: str  # "range" (1..999999) | "positive"


# FIXED VALUES: the sales-window templates.
SPEC_8_30 = WindowSpec("8-30", "paid", True, True, True, "plain", "day_window", 8, 30, "between", "mature", "range")
SPEC_15 = WindowSpec("15", "paid", True, True, True, "reference", "day_window", 1, 15, "between", "mature", "range")
SPEC_30 = WindowSpec("30", "created", True, False, False, "plain", "thirty", 1, 30, "none", "float_all", "range")
SPEC_DIAGNOSTIC = WindowSpec("8-30", "created", True, False, True, "plain", "day_window", 8, 30, "before_end",
                             "all", "positive")
SPEC_PO_ONLY = WindowSpec("8-30", "paid", False, True, True, "plain", "day_window", 8, 30, "between", "mature", "range")
SPEC_30_ALIGNED = WindowSpec("30", "paid", True, True, True, "plain", "day_window", 1, 30, "between", "mature", "range")

SPECS = {
    "8_30": SPEC_8_30, "15": SPEC_15, "30": SPEC_30, "diagnostic": SPEC_DIAGNOSTIC,
    "po_only": SPEC_PO_ONLY, "30_aligned": SPEC_30_ALIGNED,
}

KEY = ("channel", "sku", "region")
VARIANT = ("variant", "policy")


def _today(as_of: str | None) -> Column:
    """The report date; ``None`` means the current date."""
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")


def _sql_literal(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def _spec_struct(key: str, spec: WindowSpec) -> Column:
    """The variant's parameters as a constant struct (one SQL expression)."""
    fields = {"variant": key, **asdict(spec)}
    return F.expr("named_struct(" + ", ".join(f"'{k}', {_sql_literal(v)}" for k, v in fields.items()) + ")")


def _merged_day_events(raw: DataFrame) -> DataFrame:
    """E2 once for all merging variants: one row per key and day with the
    maximum texts of each event class (PO; transfer of null type; transfer of
    another type that is not 'Order').  A variant's merged texts are then the
    greatest of the classes it admits, so the text aggregation runs once over
    the raw events instead of once per variant."""
    is_po = F.col("origin") == "PO"
    is_t = F.col("origin") == "Transfer"
    t_null = is_t & F.col("transfer_type").isNull()
    t_kept = is_t & P.not_order_type("transfer_type", keep_null=False)
    return raw.groupBy(*KEY, "checkin_date").agg(
        F.max(F.when(is_po, F.col("container_number"))).alias("po_container"),
        F.max(F.when(is_po, F.col("po_code"))).alias("po_code_max"),
        F.max(is_po).alias("has_po"),
        F.max(F.when(t_null, F.col("transfer_id"))).alias("tn_id"),
        F.max(t_null).alias("has_tn"),
        F.max(F.when(t_kept, F.col("transfer_id"))).alias("tk_id"),
        F.max(F.when(t_kept, F.col("transfer_type"))).alias("tk_type"),
        F.max(t_kept).alias("has_tk"))


def variant_events(erp: Erp, variants: Sequence[str], channels: Sequence[str] | None = None,
                   with_refs: bool = True, keep: int = 3) -> DataFrame:
    """Restock events per variant (C5 per variant; E2 where the variant merges)
    with the variant's reference texts.

    ``with_refs=False`` keeps only key and date: the reference texts change no
    demand number (same-day events of the 30 window give identical windows
    whichever gets the lower rank), so the merge is a plain distinct."""
    specs = {v: SPECS[v] for v in variants}
    null = F.lit(None).cast("string")
    parts = []
    merging = [k for k, s in specs.items() if s.merge_same_day]
    plain = [k for k, s in specs.items() if not s.merge_same_day]
    if merging:
        raw = R.restock_candidates(erp, any(specs[k].transfers for k in merging), channels, top=None)
        m = _merged_day_events(raw) if with_refs else raw.groupBy(*KEY, "checkin_date").agg(
            F.max(F.col("origin") == "PO").alias("has_po"),
            F.max((F.col("origin") == "Transfer") & F.col("transfer_type").isNull()).alias("has_tn"),
            F.max((F.col("origin") == "Transfer") & P.not_order_type("transfer_type", keep_null=False)).alias("has_tk"))
        m = m.withColumn("_v", F.explode(F.array(*[_spec_struct(k, specs[k]) for k in merging])))
        v = F.col("_v")
        t_any = v.transfers & (F.col("has_tk") | (v.keep_null_type & F.col("has_tn")))
        ref = v.ref_style == "reference"
        if with_refs:
            container = F.when(ref, F.greatest(F.col("po_container"), F.when(v.transfers, F.col("tk_id")),
                                               F.when(v.transfers & v.keep_null_type, F.col("tn_id"))))\
                         .otherwise(F.col("po_container"))
            code = F.when(ref, F.greatest(F.col("po_code_max"), F.when(v.transfers, F.col("tk_type"))))\
                    .otherwise(F.greatest(F.col("po_code_max"), F.when(t_any, F.lit("Transfer"))))
            source = F.when(ref, F.greatest(F.when(F.col("has_po"), F.lit("PO_Arrival")),
                                            F.when(t_any, F.lit("Transfer_From_North"))))\
                      .otherwise(F.greatest(F.when(F.col("has_po"), F.lit("PO")), F.when(t_any, F.lit("Transfer"))))
        else:
            container = code = source = null
        parts.append(m.filter(F.col("has_po") | t_any).select(
            F.col("_v.variant").alias("variant"), F.col("_v.policy").alias("policy"), *KEY, "checkin_date",
            container.alias("container_number"), code.alias("po_code"), source.alias("source_type")))
    if plain:
        raw = R.restock_candidates(erp, any(specs[k].transfers for k in plain), channels, top=keep)
        e = raw.withColumn("_v", F.explode(F.array(*[_spec_struct(k, specs[k]) for k in plain])))
        v = F.col("_v")
        is_transfer = F.col("origin") == "Transfer"
        applicable = (~is_transfer) | (v.transfers & P.not_order_type("transfer_type", keep_null=True)
                                       & (v.keep_null_type | F.col("transfer_type").isNotNull()))
        ref = v.ref_style == "reference"
        if with_refs:
            container = F.when(ref & is_transfer, F.col("transfer_id")).otherwise(F.col("container_number"))
            code = (F.when(ref & is_transfer, F.col("transfer_type"))
                    .when(is_transfer, F.lit("Transfer")).otherwise(F.col("po_code")))
            source = (F.when(ref, F.when(is_transfer, F.lit("Transfer_From_North")).otherwise(F.lit("PO_Arrival")))
                      .otherwise(F.col("origin")))
        else:
            container = code = source = null
        parts.append(e.filter(applicable).select(
            F.col("_v.variant").alias("variant"), F.col("_v.policy").alias("policy"), *KEY, "checkin_date",
            container.alias("container_number"), code.alias("po_code"), source.alias("source_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked_day_events(erp: Erp, variants: Sequence[str], channels: Sequence[str] | None = None,
                      keep: int = 3) -> DataFrame:
    """The newest ``keep`` restock events per key and variant, numbered (rn),
    from per-day event counts (no reference texts; see ``variant_events``).

    Merging variants rank their event days.  A variant without the same-day
    merge (30) counts every event: a day with c events takes ranks s+1..s+c
    where s counts the events of newer days, so at most ``keep`` rows per key
    are produced however many events share a day."""
    specs = {v: SPECS[v] for v in variants}
    counts = R.restock_day_counts(erp, with_transfers=any(s.transfers for s in specs.values()), channels=channels, by_key=True)
    null = F.lit(None).cast("string")
    texts = [null.alias("container_number"), null.alias("po_code"), null.alias("source_type")]
    # variants that admit the same events share their counts; all are ranked in one pass,
    # and a row per variant is made of the ranked days only
    admits = {k: (s.transfers, s.transfers and s.keep_null_type) for k, s in specs.items()}
    classes = sorted(set(admits.values()))
    newest = Window.partitionBy(*DEAL).orderBy(F.col("checkin_date").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = counts.select(*KEY, "checkin_date", *[
        (F.col("n_po") + (F.col("n_tkept") if moved else 0) + (F.col("n_tnull") if null_type else 0)).alias(f"_n{i}")
        for i, (moved, null_type) in enumerate(classes)])
    e = e.withColumns({name: value for i in range(len(classes)) for name, value in (
        (f"_days{i}", F.sum((F.col(f"_n{i}") > 0).cast("bigint")).over(newest)), (f"_events{i}", F.sum(f"_n{i}").over(newest)))})
    e = e.filter(F.least(*[F.col(f"_days{i}") for i in range(len(classes))], F.lit(keep + 1)) <= keep)

    def ranks(k: str) -> Column:
        i = classes.index(admits[k])
        n, last = (F.lit(1), F.col(f"_days{i}")) if specs[k].merge_same_day else (F.col(f"_n{i}"), F.col(f"_events{i}"))
        there = F.col(f"_n{i}") > 0
        return F.struct(F.lit(k).alias("variant"), F.lit(specs[k].policy).alias("policy"),
                        F.when(there, last - n).alias("before"), last.alias("last"))

    days = e.select(*KEY, "checkin_date", F.explode(F.array(*[ranks(k) for k in specs])).alias("_v")).filter(F.col("_v.before") < keep)
    rn = F.sequence((F.col("_v.before") + 1).cast("int"), F.least(F.col("_v.last"), F.lit(keep)).cast("int"))
    return days.select("_v.variant", "_v.policy", *KEY, "checkin_date", *texts, F.explode(rn).alias("rn"))


def checkin_windows(ranked: DataFrame, as_of: str | None, variants: Sequence[str]) -> DataFrame:
    """Sample start/end, partial flag for the newest restocks (rn <= 3)."""
    today = _today(as_of)
    c = F.col("checkin_date")
    specs = {v: SPECS[v] for v in variants}

    def per_variant(fn) -> Column:
        expr = None
        for k, s in specs.items():
            val = fn(s)
            expr = F.when(F.col("variant") == k, val) if expr is None else expr.when(F.col("variant") == k, val)
        return expr

    def start(s: WindowSpec) -> Column:
        return F.date_add(c, s.start_offset)

    def in_progress(s: WindowSpec) -> Column:
        if s.partial_rule == "between":
            return today.between(F.date_add(c, 1), F.date_add(c, s.end_offset - 1))
        if s.partial_rule == "before_end":
            return today < F.date_add(c, s.end_offset)
        return F.lit(False)

    def end(s: WindowSpec) -> Column:
        return F.when(in_progress(s), today).otherwise(F.date_add(c, s.end_offset))

    def partial(s: WindowSpec) -> Column:
        return F.when((F.col("rn") == 1) & in_progress(s), F.lit(1)).otherwise(F.lit(0))

    return ranked.select(*VARIANT, *KEY, "checkin_date", "container_number", "po_code", "source_type", "rn",
                         per_variant(start).alias("sample_start"), per_variant(end).alias("sample_end"),
                         per_variant(partial).alias("is_partial"))


def window_sums(windows: DataFrame, daily: DataFrame, counted: Sequence[Column]) -> DataFrame:
    """The daily sales of each window's key and policy over its days; a window
    without sales has sums of 0.

    Both sides lie dealt by key, so the join moves nothing, and what was ranked by key is
    sorted already: one row for a window, however long, meets the days of its key, of which
    there is at most one row a policy and day.  A window that ends before it starts counts
    nothing.  Sums run in decimals (six places), so they are exact in any order.
    ``counted`` marks the daily rows that ``days_with_sales`` counts, by rule."""
    rules = ("range", "positive")
    d = daily.select(F.col("policy").alias("_policy"), *[F.col(k).alias(f"_{k}") for k in KEY], F.col("order_date").alias("_day"),
                     F.coalesce(F.col("daily_qty").try_cast("decimal(28,6)"), F.lit(0)).alias("_qty"),
                     *[F.when(c, 1).otherwise(0).cast("bigint").alias(f"_{r}") for r, c in zip(rules, counted, strict=True)])
    w = windows.select("policy", *KEY, F.struct("variant", *WINDOW_COLUMNS).alias("_w"))
    # the policy is compared by order: as a further key of the join it would deal both sides anew
    policy = (F.col("_policy") >= F.col("policy")) & (F.col("_policy") <= F.col("policy"))
    inside = F.col("_day").between(F.col("_w.sample_start"), F.col("_w.sample_end"))
    # a null key meets a null key; keys that cannot be null are joined as they are dealt
    may_be_null = {k for k in KEY if d.schema[f"_{k}"].nullable or w.schema[k].nullable}
    keys = [F.col(f"_{k}").eqNullSafe(F.col(k)) if k in may_be_null else F.col(f"_{k}") == F.col(k) for k in DEAL]
    on = reduce(operator.and_, keys) & policy & inside
    sums = d.join(w.hint("merge"), on, "right").groupBy("policy", *KEY, "_w")
    return (sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_qty", "_range", "_positive")])
            .select("_w.variant", "policy", *KEY, *[f"_w.{c}" for c in WINDOW_COLUMNS], F.col("_qty").cast("double").alias("sample_qty"),
                    *[F.col(f"_{r}") for r in rules]))


#: what a window carries beside its key
WINDOW_COLUMNS = ("rn", "checkin_date", "container_number", "po_code", "source_type", "sample_start", "sample_end", "is_partial")


def window_performance(windows: DataFrame, daily: DataFrame, as_of: str | None, variants: Sequence[str]) -> DataFrame:
    """D5/D6 + E3/E4: each window with its quantity, days and single average; windows
    without sales stay (a left join by meaning)."""
    today = _today(as_of)
    specs = {v: SPECS[v] for v in variants}
    positive_rule = [k for k, s in specs.items() if s.days_with_sales_rule == "positive"]
    sums = window_sums(windows, daily, (F.col("daily_qty").between(1, 999999), F.col("daily_qty") > 0))
    days_with = F.when(F.col("variant").isin(*positive_rule), F.col("_positive")).otherwise(F.col("_range")) if positive_rule else F.col("_range")
    grouped = sums.withColumn("days_with_sales", days_with).drop("_range", "_positive")
    thirty = [k for k, s in specs.items() if s.kind == "thirty"]
    is30 = F.col("variant").isin(*thirty) if thirty else F.lit(False)
    c = F.col("checkin_date")
    # 30 as shipped: rn = 1 counts days up to today (at least 0), older ones 30
    days30 = F.when(F.col("rn") == 1,
                    F.greatest(F.datediff(F.least(today, F.date_add(c, 30)), c), F.lit(0))).otherwise(F.lit(30))
    days = F.when(is30, days30).otherwise(S.day_span("sample_start", "sample_end"))
    out = grouped.withColumn("sample_days", days.cast("bigint"))
    return out.withColumns({
        "single_avg_dec": F.when(~is30, S.decimal6("sample_qty", "sample_days")),
        "single_avg_f": F.when(is30, F.col("sample_qty") / F.nullif(F.col("sample_days").cast("double"), F.lit(0.0)))})


def _main_avg_expr(variants: Sequence[str], mature: Column, all_: Column, float_all: Column) -> Column:
    expr = None
    for k in variants:
        s = SPECS[k]
        val = {"mature": mature, "all": all_, "float_all": float_all}[s.main_avg]
        expr = F.when(F.col("variant") == k, val) if expr is None else expr.when(F.col("variant") == k, val)
    return expr


def _mature_value() -> Column:
    return F.when((F.col("rn") == 1) & (F.col("is_partial") == 1), F.lit(None)).otherwise(F.col("single_avg_dec"))


def with_averages(perf: DataFrame, variants: Sequence[str]) -> DataFrame:
    """F2/F3/F4 over the (up to 3) windows of a key, as window aggregates.
    ``policy`` is in the partition so the join's partitioning is reused."""
    w = Window.partitionBy(*DEAL, *VARIANT)
    mature = F.avg(_mature_value()).over(w).cast("decimal(18,6)").cast("double")
    all_ = F.avg("single_avg_dec").over(w).cast("decimal(18,6)").cast("double")
    weighted = S.decimal6(F.sum("sample_qty").over(w), F.sum("sample_days").over(w)).cast("double")
    float_all = F.avg("single_avg_f").over(w)
    out = perf.withColumns({"avg_mature": mature, "avg_all": all_, "avg_weighted": weighted, "avg_float": float_all})
    return out.withColumns({
        "avg_main": _main_avg_expr(variants, F.col("avg_mature"), F.col("avg_all"), F.col("avg_float")),
        "single_avg": F.coalesce(F.col("single_avg_dec").cast("double"), F.col("single_avg_f"))})


def key_demand(perf: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Per key and variant, the main average (what the demand file carries on
    every row of the key) as one grouped aggregate instead of a window."""
    mature = F.avg(_mature_value()).cast("decimal(18,6)").cast("double")
    all_ = F.avg("single_avg_dec").cast("decimal(18,6)").cast("double")
    float_all = F.avg("single_avg_f")
    return (perf.groupBy(*VARIANT, *KEY)
            .agg(_main_avg_expr(variants, mature, all_, float_all).alias("avg_main")))


def demand_windows(erp: Erp, as_of: str | None, variants: Sequence[str] = ("8_30", "15", "30"),
                   date_from: str = K.SALES_FROM, date_to: str | None = K.SALES_TO,
                   channels: Sequence[str] | None = None, keep: int = 3, with_refs: bool = True,
                   sku: str | None = None) -> DataFrame:
    """Window performance rows of all requested variants (before averages).

    ``sku`` (C7) restricts the product dimension, so sales and restocks of
    other SKUs are dropped at their first join."""
    if sku is not None:
        erp = Erp(**{**erp.__dict__, "products": erp.products.filter(F.col("Sku") == sku)})
    if erp.products.filter(F.col("Sku").isNull()).isEmpty():  # changes no row, but tells the plan that no key is null
        erp = Erp(**{**erp.__dict__, "products": erp.products.withColumn("Sku", F.coalesce("Sku", F.lit("")))})
    policies = sorted({SPECS[v].policy for v in variants})
    daily = SL.daily_sales(erp, policies, date_from, date_to, channels, by_key=True)
    if with_refs:
        ranked = R.rank_restocks(variant_events(erp, variants, channels, keep=keep), partition=(*DEAL, *VARIANT),
                                 keep=keep)
    else:
        ranked = ranked_day_events(erp, variants, channels, keep)
    windows = checkin_windows(ranked, as_of, variants)
    return window_performance(windows, daily, as_of, variants)


def export_columns(df: DataFrame, variant: str) -> DataFrame:
    """K7: each template's own output columns (snake_case names)."""
    s = SPECS[variant]
    common = ["channel", "sku", "region", "checkin_date", "container_number", "po_code"]
    rank = F.col("rn").cast("bigint").alias("checkin_rank")
    wt = F.lit(s.name).alias("window_type")
    if variant in ("8_30", "15", "30_aligned"):
        cols = [wt, *common, *(["source_type"] if variant == "15" else []), rank,
                F.col("is_partial").cast("bigint").alias("is_partial"), "sample_start", "sample_end", "sample_days",
                "sample_qty", F.col("days_with_sales").cast("bigint").alias("days_with_sales"), "single_avg",
                F.col("avg_mature").alias("avg_daily_demand"), "avg_all", "avg_weighted"]
    elif variant == "30":
        cols = [*common, rank, F.col("sample_days").alias("actual_days"), "sample_qty", "single_avg",
                F.col("avg_float").alias("avg_daily_demand")]
    elif variant == "diagnostic":
        cols = [wt, *common, "source_type", rank, F.col("is_partial").cast("bigint").alias("is_partial"),
                "sample_start", "sample_end", "sample_days", "sample_qty",
                F.col("days_with_sales").cast("bigint").alias("days_with_sales"), "single_avg",
                F.col("avg_all").alias("avg_daily_demand"), F.col("avg_mature").alias("avg_mature_only"),
                S.qty_div_days(F.col("sample_qty").cast("decimal(18,2)"), "sample_days").alias("qty_div_days")]
    elif variant == "po_only":
        cols = [wt, *common, "single_avg", F.col("avg_mature").alias("avg_daily_demand"), "sample_start",
                "sample_end", "sample_days"]
    else:
        raise ValueError(variant)
    return df.filter(F.col("variant") == variant).select(*cols)


def window_report(erp: Erp, variant: str, as_of: str | None, date_from: str = K.SALES_FROM,
                  date_to: str | None = K.SALES_TO, channels: Sequence[str] | None = None,
                  sku: str | None = None) -> DataFrame:
    """K7: one template's export rows (all channels, or ``channels``; one SKU with ``sku``)."""
    perf = demand_windows(erp, as_of, (variant,), date_from, date_to, channels, sku=sku)
    return export_columns(with_averages(perf, (variant,)), variant)


def demand_order(df: DataFrame) -> DataFrame:
    """SKU, region, check-in date newest first."""
    return df.orderBy("sku", "region", F.col("checkin_date").desc())
