"""Data-quality checks on the channel inputs (J1-J6).  Checks return
DataFrames (status rows and warnings); they never stop the analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar as S
from .stock import ORDER_COL

DIAG_COLUMNS = ("SampleStart", "SampleDays", "SampleQty")


# J1
def file_presence(channels: DataFrame, files: DataFrame, required: Sequence[str] = K.REQUIRED_FILES) -> DataFrame:
    """(channel, file, present) for every channel and required file; each
    channel row is expanded by a generator over the required names."""
    need = channels.select("channel", F.explode(F.array(*[F.lit(f) for f in required])).alias("file"))
    found = files.select("channel", "file").distinct().withColumn("present", F.lit(True))
    return need.join(found, ["channel", "file"], "left").select(
        "channel", "file", F.coalesce("present", F.lit(False)).alias("present"))


def missing_files(channels: DataFrame, files: DataFrame, required: Sequence[str] = K.REQUIRED_FILES) -> DataFrame:
    return file_presence(channels, files, required).filter(~F.col("present")).drop("present")


# J2
def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns absent from a scan (a schema check, no data read)."""
    return [c for c in required if c not in df.columns]


def _has_column(demand: DataFrame, name: str):
    """Whether a row's file has the column; without file headers, all have."""
    return F.array_contains(F.split(F.col("_header"), K.HEADER_SEP), name) if "_header" in demand.columns else F.lit(True)


# J3
def window_type_status(demand: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """Per (channel, window) of the demand files that carry WindowType: the
    number of distinct normalised values and whether it is one single value
    that is neither the expected one nor ''.  A null reads as the text 'nan'."""
    expected = expected or {"8-30": "8-30", "15": "15", "30": "30"}
    if "WindowType" not in demand.columns:
        return demand.sparkSession.createDataFrame(
            [], "channel string, window string, distinct_values bigint, value string, warn boolean")
    norm = F.coalesce(S.norm_window_type("WindowType"), F.lit("nan"))
    exp = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v.lower()))])[F.col("window")]
    # only files whose header carries WindowType are checked
    has_col = _has_column(demand, "WindowType")
    g = (demand.filter(has_col).groupBy("channel", "window")
         .agg(F.count_distinct(norm).alias("distinct_values"), F.max(norm).alias("value")))
    return g.withColumn("warn", (F.col("distinct_values") == 1) & ~F.col("value").isin("") & (F.col("value") != exp))


# J4
def same_demand_status(demand: DataFrame) -> DataFrame:
    """Per channel: keys common to the 8-30 and 30 files and whether their
    demand (rounded to 6) is equal on every one of them (null is unequal).
    ``warn`` needs at least one common key.

    The first row of a key (E16) in either file is a minimum by file order (of a frame
    that knows none, by value), so both come from one pass over the demand."""
    first = F.struct(*([ORDER_COL] if ORDER_COL in demand.columns else []), S.round6("AvgDailyDemand_3Checkins_Avg").alias("v"))
    keys = demand.filter(F.col("window").isin("8-30", "30")).select(F.col("Sku").alias("sku"), F.col("Region").alias("region"), "channel", "window", first.alias("_r"))
    j = keys.groupBy("sku", "region", "channel").agg(*[F.min(F.when(F.col("window") == w, F.col("_r"))).alias(a) for w, a in (("8-30", "_a"), ("30", "_b"))])
    # a join of the two files would not meet on a null key either
    j = j.filter("_a IS NOT NULL AND _b IS NOT NULL AND sku IS NOT NULL AND region IS NOT NULL AND channel IS NOT NULL")
    j = j.select("channel", F.col("_a.v").alias("v8"), F.col("_b.v").alias("v30"))
    g = j.groupBy("channel").agg(F.count(F.lit(1)).alias("common_keys"),
                                 F.count(F.when(F.col("v8") == F.col("v30"), F.lit(1))).alias("equal_keys"))
    return g.withColumn("warn", (F.col("common_keys") > 0) & (F.col("common_keys") == F.col("equal_keys")))


# J5
def same_diagnostics_status(demand: DataFrame, diag: Sequence[str] = DIAG_COLUMNS) -> DataFrame:
    """Per channel: when both files carry the diagnostic columns, whether they
    are equal (null equals null) on every common (SKU, region, check-in)."""
    cols = [c for c in diag if c in demand.columns]
    key = ["channel", "Sku", "Region"] + (["CheckinDate"] if "CheckinDate" in demand.columns else [])
    if not cols:
        return demand.sparkSession.createDataFrame([], "channel string, common_rows bigint, same boolean")
    for c in cols:  # both files must carry the columns
        demand = demand.filter(_has_column(demand, c))
    a = demand.filter(F.col("window") == "8-30").select(*key, *cols).distinct()
    b = demand.filter(F.col("window") == "30").select(*key, *[F.col(c).alias(f"{c}_30") for c in cols]).distinct()
    j = a.join(b, key)
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_30"))
    return j.groupBy("channel").agg(F.count(F.lit(1)).alias("common_rows"), F.bool_and(same).alias("same"))


# J6
def quality_report(demand: DataFrame) -> DataFrame:
    """All warnings as rows (channel, check, message); the analysis goes on."""
    wt = window_type_status(demand).filter("warn").select(
        "channel", F.lit("window_type").alias("check"),
        F.format_string("Sales %s WindowType=%s, expected %s", "window", "value", "window").alias("message"))
    sd = same_demand_status(demand).filter("warn")
    dg = same_diagnostics_status(demand).filter("same")
    sd = sd.join(dg.select("channel", F.lit(True).alias("diag_same")), "channel", "left").select(
        "channel", F.lit("same_demand").alias("check"),
        F.when(F.col("diag_same"), F.lit("8-30 and 30 demand identical (sample columns too)"))
         .otherwise(F.lit("8-30 and 30 demand identical")).alias("message"))
    return wt.unionByName(sd)
