"""Settings lookups and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.settings import SETTINGS_FILE
from .util import broadcast_if_small


def _default(settings: DataFrame):
    d = settings.filter(F.col("entry").isNull())
    return (d.select(F.max("lead_time")).scalar(), d.select(F.max("logistics_time")).scalar(),
            d.select(F.max("note")).scalar())


def effective_settings(channels: DataFrame, settings: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """D9 + D10: per channel the entry's values, else the default; optional
    overrides (channel, lead_time, logistics_time) win over both.

    The default is a scalar subquery (one value, evaluated once); the entries
    are a small per-channel table joined by key."""
    d_lead, d_log, _ = _default(settings)
    e = settings.filter(F.col("entry").isNotNull()).select(
        F.col("entry").alias("channel"), F.col("lead_time").alias("_lead"), F.col("logistics_time").alias("_log"))
    df = channels.select("channel").distinct().join(broadcast_if_small(e), "channel", "left")
    lead = F.coalesce("_lead", d_lead)
    log = F.coalesce("_log", d_log)
    src = F.when(F.col("_lead").isNotNull(), F.lit(SETTINGS_FILE)).otherwise(F.lit("default"))
    if overrides is not None:
        o = overrides.select("channel", F.col("lead_time").alias("_olead"), F.col("logistics_time").alias("_olog"))
        df = df.join(broadcast_if_small(o), "channel", "left")
        lead = F.coalesce("_olead", lead)
        log = F.coalesce("_olog", log)
        src = F.when(F.col("_olead").isNotNull() | F.col("_olog").isNotNull(), F.lit("override")).otherwise(src)
    return df.select("channel", lead.cast("int").alias("lead_time"), log.cast("int").alias("logistics_time"),
                     src.alias("settings_source"))


def sync_settings(channels: DataFrame, settings: DataFrame) -> DataFrame:
    """K5: one entry per discovered channel, existing values kept, missing
    ones from the default, vanished channels dropped; the default row stays."""
    d_lead, d_log, d_note = _default(settings)
    e = settings.filter(F.col("entry").isNotNull()).withColumnRenamed("entry", "channel")
    synced = (channels.select("channel").distinct().join(e, "channel", "left")
              .select(F.col("channel").alias("entry"),
                      F.coalesce("lead_time", d_lead).cast("int").alias("lead_time"),
                      F.coalesce("logistics_time", d_log).cast("int").alias("logistics_time"),
                      F.coalesce("note", d_note).alias("note")))
    return settings.filter(F.col("entry").isNull()).unionByName(synced)


def upsert_setting(settings: DataFrame, rows: DataFrame) -> DataFrame:
    """K6: replace the entries of the given channels, keep the others."""
    keep = settings.join(rows.select("entry").distinct(), "entry", "left_anti")
    return keep.unionByName(rows.select(*settings.columns))


def settings_document(settings: DataFrame, note: str = "") -> DataFrame:
    """The settings as one JSON document row (``value``), ready for ``write.text``.
    The document holds one entry per channel, a small bounded set."""
    entry = F.struct(F.col("lead_time").alias("LeadTime"), F.col("logistics_time").alias("LogisticsTime"),
                     F.col("note").alias("备注"))
    chans = settings.filter(F.col("entry").isNotNull()).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entry", entry)))).alias("channels"))
    default_struct = settings.filter(F.col("entry").isNull()).select(F.first(entry)).scalar()
    return chans.select(F.to_json(F.struct(F.lit(note).alias("_说明"), default_struct.alias("default"),
                                           F.col("channels"))).alias("value"))
