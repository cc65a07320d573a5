"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from ..session import cut_lineage

# A side is broadcast only when the optimizer's size estimate proves it small.  The
# estimate of a scan is its compressed file size, so the limit leaves room for growth.
BROADCAST_LIMIT_BYTES = 16 * 1024 * 1024

# The key in the order that it is dealt and sorted by: a sort compares the first eight
# bytes of its first column at once, and only the SKU tells rows apart there.
DEAL = ("sku", "region", "channel")


def deal(df: DataFrame) -> DataFrame:
    """The rows dealt by key over all shuffle partitions.  The count is named, so that it is
    kept at run time: a task of the stages that follow holds a key's rows in several
    aggregates at once, and parts put together until their shuffle files fill 64 MB are too
    large for them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *DEAL)


def plan_size_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan (file sizes for scans), without running a job."""
    plan = getattr(df, "_jdf", None)  # Spark Connect has none
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only behind a size check; otherwise leave the choice to
    the planner and AQE (which re-checks real sizes at run time)."""
    size = plan_size_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df


def with_places(df: DataFrame, name: str = "place") -> DataFrame:
    """The rows of an ordered frame with their places from 1 on.  Each partition's rows
    are numbered where they lie; only the partitions' row counts meet, one row each."""
    at = cut_lineage(df.withColumn("_i", F.monotonically_increasing_id()))
    part, place = F.shiftright("_i", 33), F.col("_i").bitwiseAND((1 << 33) - 1)
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return at.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place + 1).drop("_part", "_before", "_i")
