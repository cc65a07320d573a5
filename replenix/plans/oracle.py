"""DuckDB SQL for every registered query (the correctness oracle).

The SQL is written independently of the Spark plans, directly from the
sales-window templates and the decision rules, on the same test tables
(pre-registered views ``part``, ``supplier``, ``orders``, ``lineitem`` ...).
The test-table adapter of ``replenix.sources.testdata`` is repeated here as
CTEs.  Exact decimal averages are computed in integer micro-units so they
round half-up like Spark's exact decimal arithmetic (DuckDB's AVG of a
decimal is a DOUBLE).
"""

from __future__ import annotations

from types import SimpleNamespace

from .. import constants as K
from ..sources import testdata as TD

AS_OF = f"DATE '{TD.AS_OF}'"
SALES_FROM = TD.SALES_FROM
SALES_TO = TD.SALES_TO


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def try_guid(x: str) -> str:
    return (f"CASE WHEN regexp_full_match(trim({x}), '[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-"
            f"[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}') THEN lower(trim({x})) END")


def region_of_warehouse(name: str) -> str:
    return (f"CASE WHEN trim({name}) IN {in_list(K.SOUTH_WAREHOUSES)} THEN {q(K.SOUTH)} "
            f"WHEN trim({name}) IN {in_list(K.NORTH_WAREHOUSES)} THEN {q(K.NORTH)} ELSE {q(K.NORTH)} END")


def region_of_port(port: str) -> str:
    return (f"CASE WHEN {port} = {q(K.SOUTH_PORT_ID)} THEN {q(K.SOUTH)} "
            f"WHEN {port} = {q(K.NORTH_PORT_ID)} THEN {q(K.NORTH)} ELSE {q(K.NORTH)} END")


def avg6(x: str, over: str = "") -> str:
    """AVG of a DECIMAL(18,6) expression, exact, rounded half-up to 6 places."""
    s = f"CAST(SUM({x}) {over} AS DECIMAL(38,6))"
    n = f"COUNT({x}) {over}"
    m = f"CAST({s} * 1000000 AS HUGEINT)"
    r = f"(sign({m}) * ((2 * abs({m}) + {n}) // (2 * {n})))"
    return f"(CASE WHEN {n} > 0 THEN CAST(CAST({r} AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(18,6)) END)"


def dec6(num: str, den: str) -> str:
    return f"CAST(CAST({num} AS DECIMAL(28,6)) / NULLIF({den}, 0) AS DECIMAL(18,6))"


def sguid(key: str) -> str:
    return f"'aaaaaaaa-0000-4000-8000-' || lpad(CAST({key} AS VARCHAR), 12, '0')"


def channel_of_brand(b: str) -> str:
    return f"('9' || lpad(substr({b}, 7, 10), 2, '0'))"


def _warehouse_case() -> str:
    whens = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in sorted(TD.WAREHOUSE_BY_NATION.items()))
    return f"CASE s_nationkey {whens} ELSE s_name END"


def _in_ints(xs) -> str:
    return "(" + ", ".join(str(x) for x in xs) + ")"


ADAPTER = f"""
erp_products AS (
  SELECT p_partkey AS Id, {channel_of_brand('p_brand')} || '-' || CAST(p_partkey AS VARCHAR) AS Sku FROM part),
erp_warehouses AS (
  SELECT {sguid('s_suppkey')} AS Id, {_warehouse_case()} AS Name FROM supplier
  UNION ALL SELECT {q(TD.ROUTE_SOURCE_ID)}, {q(K.TRANSFER_SOURCE)}
  UNION ALL SELECT {q(TD.ROUTE_TARGET_ID)}, {q(K.TRANSFER_TARGET)}),
supplier_port AS (
  SELECT s_suppkey AS l_suppkey,
         CASE WHEN s_nationkey IN {_in_ints(TD.SOUTH_PORT_NATIONS)} THEN {q(K.SOUTH_PORT_ID)}
              WHEN s_nationkey IN {_in_ints(TD.NORTH_PORT_NATIONS)} THEN {q(K.NORTH_PORT_ID)}
              ELSE {q(TD.OTHER_PORT_PREFIX)} || lpad(CAST(s_nationkey AS VARCHAR), 12, '0') END AS ShippedtoportId
  FROM supplier),
erp_orders AS (
  SELECT o_orderkey AS Id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS PaidDateUtc,
         o_orderdate AS DateCreatedUtc
  FROM orders WHERE CAST(o_orderdate AS DATE) <= {AS_OF}),
erp_order_lines AS (
  SELECT l_orderkey AS OrderId, l_partkey AS ProductId, l_quantity AS Quantity,
         CASE WHEN l_tax = 0.08 THEN 'n/a' WHEN l_discount = 0.1 THEN '[]'
              WHEN l_discount = 0.0 THEN '[{{"WarehouseId":"' || upper({sguid('l_suppkey')}) || '"}}]'
              ELSE '[{{"WarehouseId":"' || {sguid('l_suppkey')} || '"}}]' END AS StockSnapshotJson
  FROM lineitem WHERE l_returnflag = 'R'),
erp_purchase_orders AS (SELECT o_orderkey AS Id, 'PO' || CAST(o_orderkey AS VARCHAR) AS PurchaseOrderCode FROM orders),
erp_po_lines AS (SELECT l_orderkey AS PurchaseOrderId, l_partkey AS ProductId FROM lineitem WHERE l_returnflag = 'N'),
erp_containers AS (
  SELECT l_orderkey AS PurchaseOrderId, 'C' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS ContainerNumber,
         sp.ShippedtoportId, CASE WHEN CAST(l_shipdate AS DATE) <= {AS_OF} THEN l_shipdate END AS ActualArrivingDate
  FROM lineitem l JOIN supplier_port sp USING (l_suppkey) WHERE l_returnflag = 'N'),
erp_transfers AS (
  SELECT 'T' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS Id, l_partkey AS ProductId,
         CASE WHEN l_linestatus = 'F' THEN {q(TD.ROUTE_SOURCE_ID)} ELSE {sguid('l_suppkey')} END AS SourceWarehouseId,
         CASE WHEN l_linenumber > 0 THEN {q(TD.ROUTE_TARGET_ID)} ELSE {sguid('l_suppkey')} END AS TargetWarehouseId,
         CASE WHEN CAST(l_shipdate AS DATE) <= {AS_OF} THEN l_shipdate END AS CompletedOnUtc,
         CASE WHEN CAST(l_shipdate AS DATE) <= {AS_OF} THEN {q(K.TRANSFER_DONE)} ELSE 'InProgress' END AS TransferJobStatus,
         CASE WHEN l_discount = 0.0 THEN NULL WHEN l_discount >= 0.09 THEN 'Order' ELSE 'Move' END AS TransferType
  FROM lineitem WHERE l_returnflag = 'A'),
stock_file AS (
  SELECT {channel_of_brand('p_brand')} AS channel, {channel_of_brand('p_brand')} || '-' || CAST(p_partkey AS VARCHAR) AS Sku,
         p_name AS Name, p_type AS ProductFamily, p_size / 1000.0::DOUBLE AS unit_volume,
         CASE WHEN p_size = 50 THEN 1 WHEN p_size = 49 THEN 2 ELSE 0 END AS is_discontinued,
         CAST(p_size - 20 AS DOUBLE) AS SouthIslandStock, CAST(floor(p_retailprice / 100) - 12 AS DOUBLE) AS NorthIslandStock,
         'img\\' || p_type || '/' || p_name || ' #' || CAST(p_partkey AS VARCHAR) || '.jpg' AS ImagePath
  FROM part),
po_file AS (
  SELECT left(p.Sku, 3) AS channel, p.Sku, {region_of_port('sp.ShippedtoportId')} AS Region, l_quantity AS QuantityOrdered,
         CASE WHEN CAST(l_shipdate AS DATE) <= {AS_OF} THEN strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d')
              WHEN l_discount < 0.02 THEN 'NaT' ELSE '' END AS CheckinDate,
         CASE WHEN l_tax < 0.02 THEN '' WHEN l_tax = 0.02 THEN 'nan'
              ELSE 'C' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS ContainerNumber
  FROM lineitem l JOIN supplier_port sp USING (l_suppkey) JOIN erp_products p ON p.Id = l.l_partkey
  WHERE l_returnflag = 'N'),
channels AS (SELECT DISTINCT {channel_of_brand('p_brand')} AS channel FROM part),
settings_eff AS (
  SELECT channel,
         CASE channel WHEN '905' THEN 120 WHEN '910' THEN 60 WHEN '917' THEN 100 WHEN '923' THEN 75 ELSE 90 END AS lead_time,
         CASE channel WHEN '905' THEN 45 WHEN '910' THEN 20 WHEN '923' THEN 1 ELSE 30 END AS logistics_time,
         CASE WHEN channel IN ('905', '910', '917', '920', '923') THEN 'channels_settings.json' ELSE 'default' END
           AS settings_source
  FROM channels)"""

IS_JSON = "(json_valid(StockSnapshotJson) AND left(ltrim(StockSnapshotJson), 1) IN ('{', '['))"
WAREHOUSE_OF_LINE = try_guid("CASE WHEN json_valid(StockSnapshotJson) THEN "
                             "json_extract_string(StockSnapshotJson, '$[0].WarehouseId') END")

SALES = f"""
sales_base AS (
  SELECT o.PaidDateUtc, o.DateCreatedUtc, p.Sku, ol.Quantity, w.Name AS warehouse_name
  FROM erp_orders o JOIN erp_order_lines ol ON ol.OrderId = o.Id JOIN erp_products p ON ol.ProductId = p.Id
  LEFT JOIN erp_warehouses w ON {WAREHOUSE_OF_LINE} = {try_guid('w.Id')}
  WHERE {IS_JSON} AND trim(w.Name) NOT IN {in_list(K.EXCLUDED_WAREHOUSES)}),
daily_paid AS (
  SELECT 'paid' AS policy, left(Sku, 3) AS channel, Sku AS sku, {region_of_warehouse('warehouse_name')} AS region,
         CAST(COALESCE(PaidDateUtc, DateCreatedUtc) AS DATE) AS order_date, SUM(Quantity) AS daily_qty
  FROM sales_base
  WHERE CAST(COALESCE(PaidDateUtc, DateCreatedUtc) AS DATE) BETWEEN DATE '{SALES_FROM}' AND DATE '{SALES_TO}'
  GROUP BY ALL),
daily_created AS (
  SELECT 'created' AS policy, left(Sku, 3) AS channel, Sku AS sku, {region_of_warehouse('warehouse_name')} AS region,
         CAST(DateCreatedUtc AS DATE) AS order_date, SUM(Quantity) AS daily_qty
  FROM sales_base WHERE DateCreatedUtc >= DATE '{SALES_FROM}'
  GROUP BY ALL),
raw_events AS (
  SELECT left(p.Sku, 3) AS channel, p.Sku AS sku, {region_of_port('c.ShippedtoportId')} AS region,
         CAST(c.ActualArrivingDate AS DATE) AS checkin_date, 'PO' AS origin, c.ContainerNumber AS container_number,
         po.PurchaseOrderCode AS po_code, CAST(NULL AS VARCHAR) AS transfer_id, CAST(NULL AS VARCHAR) AS transfer_type
  FROM erp_purchase_orders po JOIN erp_po_lines pol ON pol.PurchaseOrderId = po.Id
  JOIN erp_products p ON pol.ProductId = p.Id LEFT JOIN erp_containers c ON c.PurchaseOrderId = po.Id
  WHERE c.ActualArrivingDate IS NOT NULL
  UNION ALL
  SELECT left(p.Sku, 3), p.Sku, {q(K.SOUTH)}, CAST(t.CompletedOnUtc AS DATE), 'Transfer', NULL, NULL, t.Id, t.TransferType
  FROM erp_transfers t JOIN erp_products p ON t.ProductId = p.Id
  LEFT JOIN erp_warehouses ws ON {try_guid('t.SourceWarehouseId')} = {try_guid('ws.Id')}
  LEFT JOIN erp_warehouses wt ON {try_guid('t.TargetWarehouseId')} = {try_guid('wt.Id')}
  WHERE wt.Name = {q(K.TRANSFER_TARGET)} AND ws.Name = {q(K.TRANSFER_SOURCE)} AND t.TransferJobStatus = {q(K.TRANSFER_DONE)})"""


def _variant(name, daily, start, end, **other) -> SimpleNamespace:
    """One window as the oracle states it, apart from the engine's own table."""
    usual = dict(transfers=True, keep_null_type=True, merge_same_day=True, ref_style="plain", kind="day_window",
                 partial_rule="between", main_avg="mature", days_with_sales_rule="range")
    return SimpleNamespace(name=name, policy=daily, start_offset=start, end_offset=end, **(usual | other))


# FIXED VALUES: window text, sale date, first and last sales day after the check-in.
SPECS = {
    "8_30": _variant("8-30", "paid", 8, 30),
    "15": _variant("15", "paid", 1, 15, ref_style="reference"),
    "30": _variant("30", "created", 1, 30, keep_null_type=False, merge_same_day=False, kind="thirty",
                   partial_rule="none", main_avg="float_all"),
    "diagnostic": _variant("8-30", "created", 8, 30, keep_null_type=False, partial_rule="before_end", main_avg="all",
                           days_with_sales_rule="positive"),
    "po_only": _variant("8-30", "paid", 8, 30, transfers=False),
    "30_aligned": _variant("30", "paid", 1, 30),
}


def window_ctes(key: str) -> str:
    """CTEs ev_, rk_, cw_, perf_, fin_ for one variant (as the template computes it)."""
    s = SPECS[key]
    k = key
    applicable = "origin = 'PO'"
    if s.transfers:
        applicable += " OR (transfer_type IS DISTINCT FROM 'Order'" + ("" if s.keep_null_type else
                                                                       " AND transfer_type IS NOT NULL") + ")"
    if s.ref_style == "reference":
        cn = "CASE WHEN origin = 'Transfer' THEN transfer_id ELSE container_number END"
        pc = "CASE WHEN origin = 'Transfer' THEN transfer_type ELSE po_code END"
        st = "CASE WHEN origin = 'Transfer' THEN 'Transfer_From_North' ELSE 'PO_Arrival' END"
    else:
        cn = "container_number"
        pc = "CASE WHEN origin = 'Transfer' THEN 'Transfer' ELSE po_code END"
        st = "origin"
    ev = (f"SELECT channel, sku, region, checkin_date, {cn} AS container_number, {pc} AS po_code, {st} AS source_type "
          f"FROM raw_events WHERE {applicable}")
    if s.merge_same_day:
        ev = (f"SELECT channel, sku, region, checkin_date, MAX(container_number) AS container_number, "
              f"MAX(po_code) AS po_code, MAX(source_type) AS source_type FROM ({ev}) GROUP BY channel, sku, region, checkin_date")
    rk = (f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY channel, sku, region ORDER BY checkin_date DESC, "
          f"container_number ASC NULLS LAST, po_code ASC NULLS LAST, source_type ASC NULLS LAST) AS rn FROM ev_{k}) "
          f"WHERE rn <= 3")
    c = "checkin_date"
    if s.partial_rule == "between":
        prog = f"({AS_OF} BETWEEN {c} + 1 AND {c} + {s.end_offset - 1})"
    elif s.partial_rule == "before_end":
        prog = f"({AS_OF} < {c} + {s.end_offset})"
    else:
        prog = "FALSE"
    cw = (f"SELECT *, {c} + {s.start_offset} AS sample_start, "
          f"CASE WHEN {prog} THEN {AS_OF} ELSE {c} + {s.end_offset} END AS sample_end, "
          f"CASE WHEN rn = 1 AND {prog} THEN 1 ELSE 0 END AS is_partial FROM rk_{k}")
    daily = "daily_paid" if s.policy == "paid" else "daily_created"
    dws = "ds.daily_qty > 0" if s.days_with_sales_rule == "positive" else "ds.daily_qty BETWEEN 1 AND 999999"
    if s.kind == "thirty":
        days = (f"CASE WHEN cw.rn = 1 THEN greatest(date_diff('day', cw.{c}, least({AS_OF}, cw.{c} + 30)), 0) "
                f"ELSE 30 END")
    else:
        days = "CASE WHEN cw.sample_end < cw.sample_start THEN 0 ELSE date_diff('day', cw.sample_start, cw.sample_end) + 1 END"
    perf = (f"SELECT cw.channel, cw.sku, cw.region, cw.{c}, cw.container_number, cw.po_code, cw.source_type, cw.rn, "
            f"cw.sample_start, cw.sample_end, cw.is_partial, CAST({days} AS BIGINT) AS sample_days, "
            f"COALESCE(SUM(ds.daily_qty), 0.0) AS sample_qty, "
            f"COUNT(DISTINCT CASE WHEN {dws} THEN ds.order_date END) AS days_with_sales "
            f"FROM cw_{k} cw LEFT JOIN {daily} ds ON cw.channel = ds.channel AND cw.sku = ds.sku "
            f"AND cw.region = ds.region AND ds.order_date BETWEEN cw.sample_start AND cw.sample_end "
            f"GROUP BY ALL")
    w = "OVER (PARTITION BY channel, sku, region)"
    mature = "CASE WHEN rn = 1 AND is_partial = 1 THEN NULL ELSE single_avg_dec END"
    fin = (f"SELECT *, {avg6(mature, w)} AS avg_mature, {avg6('single_avg_dec', w)} AS avg_all, "
           f"{dec6(f'SUM(sample_qty) {w}', f'SUM(sample_days) {w}')} AS avg_weighted, "
           f"AVG(single_avg_f) {w} AS avg_float FROM (SELECT *, "
           + (f"CAST(NULL AS DECIMAL(18,6)) AS single_avg_dec, sample_qty / NULLIF(CAST(sample_days AS DOUBLE), 0) AS single_avg_f"
              if s.kind == "thirty" else
              f"{dec6('sample_qty', 'sample_days')} AS single_avg_dec, CAST(NULL AS DOUBLE) AS single_avg_f")
           + f" FROM perf_{k})")
    return (f"ev_{k} AS ({ev}),\nrk_{k} AS ({rk}),\ncw_{k} AS ({cw}),\nperf_{k} AS ({perf}),\n"
            f"fin_{k} AS ({fin})")


def key_demand_cte(key: str) -> str:
    """Per key: the main average of the variant (what the demand file holds)."""
    s = SPECS[key]
    mature = "CASE WHEN rn = 1 AND is_partial = 1 THEN NULL ELSE single_avg_dec END"
    val = {"mature": f"CAST({avg6(mature)} AS DOUBLE)", "all": f"CAST({avg6('single_avg_dec')} AS DOUBLE)",
           "float_all": "AVG(single_avg_f)"}[s.main_avg]
    return (f"kd_{key} AS (SELECT channel, sku, region, {val} AS value FROM (SELECT *, "
            + ("CAST(NULL AS DECIMAL(18,6)) AS single_avg_dec, sample_qty / NULLIF(CAST(sample_days AS DOUBLE), 0) AS single_avg_f"
               if s.kind == "thirty" else
               f"{dec6('sample_qty', 'sample_days')} AS single_avg_dec, CAST(NULL AS DOUBLE) AS single_avg_f")
            + f" FROM perf_{key}) GROUP BY channel, sku, region)")


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes if c.strip())


def r8(x: str) -> str:
    """Output normalisation to 8 places with the same IEEE steps as the Spark side."""
    return f"(floor(({x}) * 1e8 + 0.5) / 1e8)"


def swap_round8(sql: str) -> str:
    """Rewrite every ``ROUND(expr, 8)`` into ``r8(expr)`` (balanced-parenthesis scan)."""
    out, i = [], 0
    while True:
        j = sql.find("ROUND(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + 5
        while True:
            ch = sql[k]
            depth += ch == "("
            depth -= ch == ")"
            if depth == 0:
                break
            k += 1
        inner = sql[j + 6:k]
        if inner.rstrip().endswith(", 8"):
            expr = inner.rstrip()[:-3]
            out.append(sql[i:j] + r8(swap_round8(expr)))
        else:
            out.append(sql[i:k + 1])
        i = k + 1


def export_select(key: str) -> str:
    s = SPECS[key]
    wt = q(s.name)
    common = "channel, sku, region, checkin_date, container_number, po_code"
    single = "COALESCE(CAST(single_avg_dec AS DOUBLE), single_avg_f)"
    if key in ("8_30", "15", "30_aligned"):
        src = ", source_type" if key == "15" else ""
        return (f"SELECT {wt} AS window_type, {common}{src}, CAST(rn AS BIGINT) AS checkin_rank, "
                f"CAST(is_partial AS BIGINT) AS is_partial, sample_start, sample_end, sample_days, sample_qty, "
                f"days_with_sales, {single} AS single_avg, CAST(avg_mature AS DOUBLE) AS avg_daily_demand, "
                f"CAST(avg_all AS DOUBLE) AS avg_all, CAST(avg_weighted AS DOUBLE) AS avg_weighted FROM fin_{key}")
    if key == "30":
        return (f"SELECT {common}, CAST(rn AS BIGINT) AS checkin_rank, sample_days AS actual_days, sample_qty, "
                f"{r8(single)} AS single_avg, {r8('avg_float')} AS avg_daily_demand FROM fin_{key}")
    if key == "diagnostic":
        return (f"SELECT {wt} AS window_type, {common}, source_type, CAST(rn AS BIGINT) AS checkin_rank, "
                f"CAST(is_partial AS BIGINT) AS is_partial, sample_start, sample_end, sample_days, sample_qty, "
                f"days_with_sales, {single} AS single_avg, CAST(avg_all AS DOUBLE) AS avg_daily_demand, "
                f"CAST(avg_mature AS DOUBLE) AS avg_mature_only, "
                f"CAST(CAST(sample_qty AS DECIMAL(18,2)) AS VARCHAR) || ' / ' || CAST(sample_days AS VARCHAR) AS qty_div_days "
                f"FROM fin_{key}")
    if key == "po_only":
        return (f"SELECT {wt} AS window_type, {common}, {single} AS single_avg, CAST(avg_mature AS DOUBLE) AS "
                f"avg_daily_demand, sample_start, sample_end, sample_days FROM fin_{key}")
    raise ValueError(key)


def window_sql(key: str) -> str:
    return with_ctes(ADAPTER, SALES, window_ctes(key)) + "\n" + export_select(key)


DECISION_VARIANTS = ("8_30", "15", "30")

STOCK_LONG = f"""
stock_long AS (
  SELECT channel, Sku AS sku, {q(K.SOUTH)} AS region, SouthIslandStock AS on_hand, unit_volume, is_discontinued,
         Name AS name, ProductFamily AS product_family FROM stock_file
  UNION ALL
  SELECT channel, Sku, {q(K.NORTH)}, NorthIslandStock, unit_volume, is_discontinued, Name, ProductFamily FROM stock_file)"""

IS_EMPTY = "({x} IS NULL OR lower(trim(CAST({x} AS VARCHAR))) IN ('', 'nan', 'nat', 'none', 'null'))"

PO_ROWS = f"""
po_rows AS (
  SELECT channel, Sku AS sku, Region AS region,
         CASE WHEN {IS_EMPTY.format(x='CheckinDate')} AND NOT {IS_EMPTY.format(x='ContainerNumber')}
              THEN QuantityOrdered END AS transit_qty,
         CASE WHEN {IS_EMPTY.format(x='CheckinDate')} AND {IS_EMPTY.format(x='ContainerNumber')}
              THEN QuantityOrdered END AS production_qty
  FROM po_file)"""


def decision_ctes(extra: str = "", settings_cte: str = "settings_eff") -> str:
    parts = [ADAPTER, SALES, extra] + [window_ctes(k) for k in DECISION_VARIANTS] + [key_demand_cte(k) for k in DECISION_VARIANTS]
    parts += [STOCK_LONG, PO_ROWS, f"""
assembled AS (
  SELECT channel, sku, region, MAX(on_hand) AS on_hand, MAX(unit_volume) AS unit_volume,
         MAX(is_discontinued) AS is_discontinued, MAX(name) AS name, MAX(product_family) AS product_family,
         SUM(transit_qty) AS in_transit, SUM(production_qty) AS in_production,
         AVG(d8) AS demand_8_30, AVG(d15) AS demand_15, AVG(d30) AS demand_30
  FROM (
    SELECT channel, sku, region, on_hand, unit_volume, is_discontinued, name, product_family,
           NULL::DOUBLE AS transit_qty, NULL::DOUBLE AS production_qty, NULL::DOUBLE AS d8, NULL::DOUBLE AS d15,
           NULL::DOUBLE AS d30 FROM stock_long
    UNION ALL SELECT channel, sku, region, NULL, NULL, NULL, NULL, NULL, transit_qty, production_qty, NULL, NULL, NULL
      FROM po_rows
    UNION ALL SELECT channel, sku, region, NULL, NULL, NULL, NULL, NULL, NULL, NULL, value, NULL, NULL FROM kd_8_30
    UNION ALL SELECT channel, sku, region, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, value, NULL FROM kd_15
    UNION ALL SELECT channel, sku, region, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, value FROM kd_30)
  GROUP BY channel, sku, region),
filled AS (
  SELECT channel, sku, region, COALESCE(on_hand, 0.0) AS on_hand, COALESCE(in_transit, 0.0) AS in_transit,
         COALESCE(in_production, 0.0) AS in_production, COALESCE(unit_volume, 0.0) AS unit_volume,
         COALESCE(is_discontinued, 0) AS is_discontinued, COALESCE(name, '') AS name,
         COALESCE(product_family, '') AS product_family, COALESCE(demand_8_30, 0.0) AS demand_8_30,
         COALESCE(demand_15, 0.0) AS demand_15, COALESCE(demand_30, 0.0) AS demand_30
  FROM assembled),
needs AS (
  SELECT f.*, COALESCE(s.lead_time, {K.DEFAULT_LEAD_TIME}) AS lead_time,
         COALESCE(s.logistics_time, {K.DEFAULT_LOGISTICS_TIME}) AS logistics_time,
         on_hand + in_transit + in_production AS total_stock,
         greatest(demand_8_30, demand_15, demand_30) AS daily_demand
  FROM filled f LEFT JOIN {settings_cte} s USING (channel) WHERE is_discontinued <> 1),
needs2 AS (
  SELECT *, daily_demand * lead_time AS lead_time_need, daily_demand * logistics_time AS logistics_need,
         CASE WHEN daily_demand = 0 THEN {q(K.SOURCE_NONE)} ELSE concat_ws('/',
              CASE WHEN demand_8_30 = daily_demand THEN {q(K.SOURCE_8_30)} END,
              CASE WHEN demand_15 = daily_demand THEN {q(K.SOURCE_15)} END,
              CASE WHEN demand_30 = daily_demand THEN {q(K.SOURCE_30)} END) END AS demand_source,
         CASE WHEN daily_demand = 0 THEN 'no_sales' WHEN demand_15 = daily_demand THEN 'use_15'
              WHEN demand_8_30 = daily_demand THEN 'use_8_30' ELSE 'use_30' END AS source_tag
  FROM needs),
decided AS (
  SELECT *, CASE WHEN daily_demand = 0 THEN 'no_sales' WHEN total_stock <= lead_time_need THEN 'order'
                 WHEN on_hand + in_transit <= logistics_need AND in_production > 0 THEN 'expedite'
                 ELSE 'hold' END AS decision
  FROM needs2),
decisions AS (
  SELECT *, CASE WHEN decision = 'order' THEN greatest(0.0, lead_time_need - total_stock) ELSE 0.0 END AS order_qty,
         CASE WHEN decision = 'expedite' THEN greatest(0.0, logistics_need - on_hand - in_transit) ELSE 0.0 END
           AS expedite_qty,
         CASE decision WHEN 'order' THEN 0 WHEN 'expedite' THEN 1 WHEN 'hold' THEN 2 ELSE 3 END AS priority
  FROM decided),
decisions_v AS (
  SELECT *, order_qty * unit_volume AS order_volume, expedite_qty * unit_volume AS expedite_volume FROM decisions)"""]
    return with_ctes(*parts)


DECISION_OUT = ("channel, sku, name, product_family, region, on_hand, in_transit, in_production, total_stock, "
                "demand_8_30, demand_15, ROUND(demand_30, 8) AS demand_30, ROUND(daily_demand, 8) AS daily_demand, "
                "demand_source, source_tag, CAST(lead_time AS BIGINT) AS lead_time, "
                "CAST(logistics_time AS BIGINT) AS logistics_time, ROUND(lead_time_need, 8) AS lead_time_need, "
                "ROUND(logistics_need, 8) AS logistics_need, decision, ROUND(order_qty, 8) AS order_qty, unit_volume, "
                "ROUND(order_volume, 8) AS order_volume, ROUND(expedite_qty, 8) AS expedite_qty, "
                "ROUND(expedite_volume, 8) AS expedite_volume, CAST(priority AS BIGINT) AS priority")


def decisions_sql(select: str = f"SELECT {DECISION_OUT} FROM decisions_v") -> str:
    return decision_ctes() + "\n" + select


URL_PARTS = "'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$'"


def image_urls_sql() -> str:
    """Per SKU the image URL of its path, percent-quoted like
    Python's quote(path, safe='/:%') (url_encode quotes like safe='')."""
    raw = "trim(COALESCE(ImagePath, ''))"
    full = (f"CASE WHEN {raw} = '' THEN '' WHEN lower({raw}) LIKE 'http%' THEN {raw} "
            f"ELSE {q(K.IMAGE_BASE)} || regexp_replace(replace({raw}, '\\', '/'), '^/+', '') END")
    quoted = "replace(replace(replace(url_encode(path), '%2F', '/'), '%3A', ':'), '%25', '%')"
    return with_ctes(ADAPTER) + f"""
SELECT channel, sku, image_url FROM (
  SELECT channel, Sku AS sku, CASE WHEN u = '' THEN '' ELSE head || {quoted} || tail END AS image_url
  FROM (SELECT channel, Sku, u, regexp_extract(u, {URL_PARTS}, 1) AS head, regexp_extract(u, {URL_PARTS}, 2) AS path,
               regexp_extract(u, {URL_PARTS}, 3) AS tail
        FROM (SELECT channel, Sku, {full} AS u FROM stock_file)))
WHERE image_url <> ''"""
