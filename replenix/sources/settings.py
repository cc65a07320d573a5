"""Channel settings documents.

A document holds a ``default`` entry and a ``channels`` map of entries, each
with ``LeadTime``, ``LogisticsTime`` and a note.  Numbers are read through
VARIANT so a JSON number 90.7 truncates to 90 and ``true`` is 1, while text
that is not an integer ("x", "90.7") falls back — the same rules as Python's
``int()`` on the parsed value.  Keys starting with ``_`` are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K

NOTE = "备注"
SETTINGS_FILE = "channels_settings.json"
# FIXED VALUES: older file names tried in order when the main file is missing.
LEGACY_FILES = ("channel_settings.template.json", "channels_settings.template.json")

SETTINGS_SCHEMA = "entry string, lead_time int, logistics_time int, note string"


def _int_field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "int")


def _note(v: Column) -> Column:
    return F.try_variant_get(v, f"$['{NOTE}']", "string")


def parse_settings(doc_text: DataFrame, text_col: str = "value",
                   default_lead: int = K.DEFAULT_LEAD_TIME, default_logistics: int = K.DEFAULT_LOGISTICS_TIME
                   ) -> DataFrame:
    """Settings document text (one row per document) -> one row per entry:
    ``entry`` is null for the default, else the channel name."""
    v = F.try_parse_json(F.col(text_col))
    df = doc_text.select(v.alias("doc"))
    chans = F.try_variant_get(F.col("doc"), "$.channels", "map<string, variant>")
    root_default = F.try_variant_get(F.col("doc"), "$.default", "variant")
    is_obj = F.schema_of_variant(root_default).startswith("OBJECT")
    has_root_timing = (F.try_variant_get(F.col("doc"), "$.LeadTime", "variant").isNotNull()
                       | F.try_variant_get(F.col("doc"), "$.LogisticsTime", "variant").isNotNull())
    # the default entry, normalised against the built-in values
    d_lead = F.coalesce(F.when(is_obj, _int_field(root_default, "LeadTime")), F.lit(default_lead))
    d_log = F.coalesce(F.when(is_obj, _int_field(root_default, "LogisticsTime")), F.lit(default_logistics))
    d_note = F.coalesce(F.when(is_obj, _note(root_default)), F.lit(""))
    # With no channels map, root-level timing becomes the default (falling back to the above)
    legacy = chans.isNull() & has_root_timing
    d_lead = F.when(legacy, F.coalesce(_int_field(F.col("doc"), "LeadTime"), d_lead)).otherwise(d_lead)
    d_log = F.when(legacy, F.coalesce(_int_field(F.col("doc"), "LogisticsTime"), d_log)).otherwise(d_log)
    d_note = F.when(legacy, F.coalesce(_note(F.col("doc")), d_note)).otherwise(d_note)
    base = df.select(d_lead.alias("d_lead"), d_log.alias("d_log"), d_note.alias("d_note"), chans.alias("chans"))
    default_row = base.select(F.lit(None).cast("string").alias("entry"), F.col("d_lead").alias("lead_time"),
                              F.col("d_log").alias("logistics_time"), F.col("d_note").alias("note"))
    entries = base.select("d_lead", "d_log", "d_note", F.explode("chans").alias("entry", "e"))
    entries = entries.filter(~F.col("entry").startswith("_")).select(
        "entry",
        F.coalesce(_int_field(F.col("e"), "LeadTime"), F.col("d_lead")).alias("lead_time"),
        F.coalesce(_int_field(F.col("e"), "LogisticsTime"), F.col("d_log")).alias("logistics_time"),
        F.coalesce(_note(F.col("e")), F.col("d_note")).alias("note"))
    return default_row.unionByName(entries)


def read_settings(spark: SparkSession, root: str, fallbacks: Sequence[str] = LEGACY_FILES) -> DataFrame:
    """``root/channels_settings.json``; when it is missing or no
    JSON object, the first legacy file that is one.  No file at all gives only the built-in default."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in (SETTINGS_FILE, *fallbacks):
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        if path.getFileSystem(conf).exists(path):
            text = spark.read.option("wholetext", True).text(path.toString())
            kind = text.select(F.schema_of_variant(F.try_parse_json("value"))).first()
            if kind and (kind[0] or "").startswith("OBJECT"):
                return parse_settings(text)
    return spark.range(1).select(F.lit(None).cast("string").alias("entry"),
                                 F.lit(K.DEFAULT_LEAD_TIME).alias("lead_time"),
                                 F.lit(K.DEFAULT_LOGISTICS_TIME).alias("logistics_time"), F.lit("").alias("note"))


def settings_from_text(spark: SparkSession, text: str) -> DataFrame:
    """A settings document given as text (a one-row relation with size statistics)."""
    return parse_settings(spark.range(1).select(F.lit(text).alias("value")))
