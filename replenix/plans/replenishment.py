"""Composite pipelines.

* P1 ``demand``: ERP tables -> average daily demand per key for each window.
* P2 ``replenishment``: stock + purchase orders + demand + settings -> decisions.
* P3: P2 over all channels at once — the channel is the first key column, so
  there is no per-channel loop: one job covers every channel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import decisions as D
from ..operators import purchase as PU
from ..operators import stock as ST
from ..operators import windows as W
from ..sources.erp import Erp

# Variant key -> the window name used by the decision step.
DECISION_WINDOWS = {"8_30": "8-30", "15": "15", "30": "30"}


def demand(erp: Erp, as_of: str | None, variants: Sequence[str] = ("8_30", "15", "30"), date_from: str = K.SALES_FROM,
           date_to: str | None = K.SALES_TO, channels: Sequence[str] | None = None) -> DataFrame:
    """P1 for the decision step: long rows (channel, sku, region, window, value).

    A key whose restocks are all too young keeps its row with a null value,
    as the exported demand file does."""
    perf = W.demand_windows(erp, as_of, variants, date_from, date_to, channels, with_refs=False)
    kd = W.key_demand(perf, variants)
    wmap = F.create_map(*[x for k, v in DECISION_WINDOWS.items() if k in variants for x in (F.lit(k), F.lit(v))])
    return kd.select("channel", "sku", "region", wmap[F.col("variant")].alias("window"),
                     F.col("avg_main").alias("value"))


def replenishment(stock_wide: DataFrame, po_file: DataFrame, demand_long: DataFrame, settings: DataFrame,
                  image_base: str = K.IMAGE_BASE) -> DataFrame:
    """Decisions for every (channel, sku, region) of any input."""
    stock = ST.stock_long(stock_wide, base=image_base)
    po_rows = PU.po_rows(po_file)
    assembled = D.assemble(stock, po_rows, demand_long)
    return D.decide(assembled, settings).select(*D.DECISION_COLUMNS)


def discontinued_dropped(stock_wide: DataFrame, po_file: DataFrame, demand_long: DataFrame) -> DataFrame:
    """Rows removed by C9 (for the run summary, E12)."""
    stock = ST.stock_long(stock_wide)
    assembled = D.assemble(stock, PU.po_rows(po_file), demand_long)
    return assembled.filter(F.col("is_discontinued") == 1)
