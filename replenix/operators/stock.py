"""Stock: the wide stock file melted into (sku, region, on_hand) rows (I1),
coerced (B13), first row per key (E16), and image URLs (B27, B28, E17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar as S

ORDER_COL = "_file_order"


def image_url(df: DataFrame, base: str = K.IMAGE_BASE) -> DataFrame:
    """ImageUrl (trimmed) if the column exists, else normalised ImagePath, else ''."""
    if "ImageUrl" in df.columns:
        return df.withColumn("ImageUrl", F.trim(F.coalesce(F.col("ImageUrl").cast("string"), F.lit(""))))
    if "ImagePath" in df.columns:
        # two projections: the full URL is computed once, then its path quoted
        return (df.withColumn("_full_url", S.image_full_url("ImagePath", base))
                  .withColumn("ImageUrl", S.quote_url_path("_full_url")).drop("_full_url"))
    return df.withColumn("ImageUrl", F.lit(""))


def first_per(df: DataFrame, keys: Sequence[str], order: str = ORDER_COL) -> DataFrame:
    """The first row of each key in file order (``order`` column); of a frame that
    knows no order, the least row, so that reruns agree."""
    if order not in df.columns:
        rest = [c for c in df.columns if c not in keys]
        least = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")) if rest else df.distinct()
        return least.select(*keys, "_r.*").select(*df.columns) if rest else least
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc())
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1).drop("_k")


def stock_long(stock_wide: DataFrame, region_columns=K.STOCK_COLUMNS, base: str = K.IMAGE_BASE) -> DataFrame:
    """I1 + B13 + E16: one row per (channel, sku, region) with on_hand.

    Name, family, volume, flag and image are melt id columns, so both regions
    of a SKU carry the same values."""
    missing = [c for c, _ in region_columns if c not in stock_wide.columns]
    if missing:
        raise ValueError(f"stock input misses {missing}")  # J2
    df = image_url(stock_wide, base)
    for opt in ("Name", "ProductFamily"):
        if opt not in df.columns:
            df = df.withColumn(opt, F.lit(""))
    if "channel" not in df.columns:
        df = df.withColumn("channel", S.channel_of("Sku"))
    # coerce before the melt: each value is parsed once per SKU
    keep = [ORDER_COL] if ORDER_COL in df.columns else []
    wide = df.select(
        "channel", F.col("Sku").cast("string").alias("sku"),
        F.coalesce(F.col("Name").cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col("ProductFamily").cast("string"), F.lit("")).alias("product_family"),
        S.to_number("PriceRadarVolume").alias("unit_volume"), S.to_int_flag("IsDiscontinued").alias("is_discontinued"),
        F.col("ImageUrl").alias("image_url"), *keep,
        *[S.to_number(c).alias(r) for c, r in region_columns])
    ids = ["channel", "sku", "name", "product_family", "unit_volume", "is_discontinued", "image_url", *keep]
    long = wide.unpivot(ids, [r for _, r in region_columns], "region", "on_hand")
    long = long.select("channel", "sku", "region", "on_hand", *ids[2:])
    long = long.filter(F.col("sku").isNotNull())
    return first_per(long, ["channel", "sku", "region"]).drop(ORDER_COL) if ORDER_COL in long.columns else long


def family_facets(stock: DataFrame) -> DataFrame:
    """Distinct non-empty families (before the discontinued filter), sorted."""
    fam = stock.select("channel", F.col("product_family"))
    return (fam.filter(F.col("product_family").isNotNull() & (F.col("product_family") != ""))
            .distinct().orderBy("channel", "product_family"))


def image_lookup(df: DataFrame, base: str = K.IMAGE_BASE) -> DataFrame:
    """SKU -> normalised image URL of its first row, only when non-empty."""
    first = first_per(df, ["channel", "sku"]) if ORDER_COL in df.columns else (
        df.groupBy("channel", "sku").agg(F.min_by("image_url", "region").alias("image_url")))
    full = first.select("channel", "sku", S.image_full_url("image_url", base).alias("_u"))
    return full.select("channel", "sku", S.quote_url_path("_u").alias("image_url")).filter(F.col("image_url") != "")
