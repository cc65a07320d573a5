"""Fixed business values.

FIXED VALUES — these must equal the values used by the application this engine
replaces, so they are stated here verbatim, in their natural order.  Every
function that uses them takes them as an overridable parameter.
"""

# --- Regions -----------------------------------------------------------------
# FIXED VALUES: region labels (north island, south island).
NORTH = "北岛"
SOUTH = "南岛"

# --- Warehouse name -> region (sales) ------------------------------------------
# FIXED VALUES: warehouses whose trimmed name means the south region.
SOUTH_WAREHOUSES = ("CHCH Gerald Connelly", "GC", "treffers", "CHCH Treffers")
# FIXED VALUES: warehouses whose trimmed name means the north region (north is also the default).
NORTH_WAREHOUSES = (
    "Hamilton Te Rapa", "Carbine Rd Warehouse", "Walls", "Westgate Storage",
    "Walls Road", "Walls in Transit", "Hamilton Storage", "Leonard Warehouse",
)
# FIXED VALUES: display / storage / lost warehouses whose sales are ignored.
EXCLUDED_WAREHOUSES = (
    "CHCH Display", "CHCH Display Colombo", "CHCH Shop Storage", "CHCH Colombo Shop Storage",
    "Onehunga Shop-Display", "Onehunga Shop-Storage", "Hamilton Shop Display",
    "Hamilton Old Display (No longer available)", "Westgate display",
    "Presale-AKL", "East Tamaki -Luo(No longer available)", "Missing/To be located",
    "[Action Request]", "123 Jef", "Onehunga warehouse(No longer available)",
)

# --- Port id -> region (container arrivals) ------------------------------------
# FIXED VALUES: port ids; any other port means north.
SOUTH_PORT_ID = "3b9ff26b-4ec0-44c6-92ac-ee9804272426"
NORTH_PORT_ID = "646a2216-87c2-4bc6-8469-fdbd90bb2d84"

# --- Inter-island transfer route ------------------------------------------------
# FIXED VALUES: a completed transfer from this source to this target is a south restock.
TRANSFER_SOURCE = "CHCH in transit"
TRANSFER_TARGET = "CHCH Gerald Connelly"
TRANSFER_DONE = "Completed"
TRANSFER_TYPE_EXCLUDED = "Order"

# --- Stock file columns -> region ------------------------------------------------
# FIXED VALUES: wide stock columns and the region each one holds.
STOCK_COLUMNS = (("SouthIslandStock", SOUTH), ("NorthIslandStock", NORTH))

# --- Defaults ----------------------------------------------------------------
# FIXED VALUES: default lead time (days), logistics time (days), container threshold (m3).
DEFAULT_LEAD_TIME = 90
DEFAULT_LOGISTICS_TIME = 30
CONTAINER_THRESHOLD = 69.0

# FIXED VALUES: sales date window of the exporter (lower, upper) as ISO dates.
SALES_FROM = "2025-01-01"
SALES_TO = "2099-12-31"

# Image host prefixed to relative image paths: deployment configuration, passed
# as ``image_base`` / ``base`` to the readers and operators; this is a neutral default.
IMAGE_BASE = "https://erp-images.example/"

# --- Decisions -----------------------------------------------------------------
# Internal codes are English; labels are the ones shown in reports.
ORDER, EXPEDITE, HOLD, NO_SALES = "order", "expedite", "hold", "no_sales"
# FIXED VALUES: report label of each decision, and its sort priority.
DECISION_LABELS = {ORDER: "下单备货", EXPEDITE: "催促发货", HOLD: "保持现状", NO_SALES: "暂无销售"}
DECISION_LABELS_EN = {ORDER: "Place Order", EXPEDITE: "Expedite", HOLD: "OK", NO_SALES: "No Sales"}
PRIORITY = {ORDER: 0, EXPEDITE: 1, HOLD: 2, NO_SALES: 3}

# FIXED VALUES: demand window names as they appear in the demand-source text.
SOURCE_8_30 = "8-30天"
SOURCE_15 = "15天"
SOURCE_30 = "30天"
SOURCE_NONE = "无销售数据"

# FIXED VALUES: the five per-channel input files.
REQUIRED_FILES = ("stock.csv", "PO.csv", "Sales 8-30.csv", "Sales 15.csv", "Sales 30.csv")
REQUIRED_COLUMNS = {
    "stock.csv": ("Sku", "PriceRadarVolume", "IsDiscontinued", "SouthIslandStock", "NorthIslandStock"),
    "PO.csv": ("Sku", "Region", "QuantityOrdered", "CheckinDate"),
    "Sales 8-30.csv": ("Sku", "Region", "AvgDailyDemand_3Checkins_Avg"),
    "Sales 15.csv": ("Sku", "Region", "AvgDailyDemand_3Checkins_Avg"),
    "Sales 30.csv": ("Sku", "Region", "AvgDailyDemand_3Checkins_Avg"),
}
DEMAND_FILES = (("8-30", "Sales 8-30.csv"), ("15", "Sales 15.csv"), ("30", "Sales 30.csv"))

# FIXED VALUES: cells that a CSV reader of data frames takes for missing.
NULL_MARKERS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# FIXED VALUES: tokens that mean "empty" in a CSV cell (after trim + lower).
EMPTY_TOKENS = ("", "nan", "nat", "none", "null")

# between the column names of a file in the ``_header`` column; no name holds it
HEADER_SEP = "\x1f"

# FIXED VALUES: the "all" choice of a view filter.
ALL_CHOICE = "全部"
