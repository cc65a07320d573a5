"""Continuous scan.

The source application re-ran every channel on a timer.  Here a stream watches the
input folders (``folder_watch``): each micro-batch holds the channels whose files
arrived or were rewritten, and ``foreachBatch`` recomputes the decisions of just those
channels and replaces their rows in the result (``sinks.snapshots``: a batch is seen
whole or not at all, and a replayed one changes nothing).
``trigger(processingTime=...)`` gives the timed scan; ``availableNow`` one catch-up pass.

Two input layouts are supported:

* ``landing``: ``<root>/{stock,po,demand}/channel=<c>/*`` (what Spark writes
  with ``partitionBy("channel")``); the batch re-read prunes partitions by the
  touched channels.
* ``channel_folders``: ``<root>/<channel>/{stock.csv, PO.csv, Sales *.csv}``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalar as S
from ..operators.settings_ops import effective_settings
from ..plans import replenishment as RP
from ..session import cut_lineage
from ..sinks import snapshots as SN
from ..sinks import writers as WR
from ..sources import channel_files as CF
from ..sources.settings import SETTINGS_FILE
from . import folder_watch as FW

LANDING_KINDS = ("stock", "po", "demand")
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def touched_channels(spark: SparkSession, root: str, layout: str = "landing") -> DataFrame:
    """Streaming DataFrame of (channel) for every new input file.  Only file
    paths are read (binaryFile without the content column)."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.csv").load(root).select("path"))
    if layout == "landing":
        ch = F.regexp_extract("path", r"/channel=([^/]+)/", 1)
    else:
        base = root.rstrip("/").split("/")[-1]
        ch = F.regexp_extract("path", "/" + base.replace(".", r"\.") + r"/([^/]+)/", 1)
    files = files.select(ch.alias("raw")).select(F.url_decode(F.replace("raw", F.lit("+"), F.lit("%2B"))).alias("channel"))
    return files.filter((F.col("channel") != "") & ~F.col("channel").rlike(r"^[._]"))


def read_landing(spark: SparkSession, root: str, kind: str, channels: list[str]) -> DataFrame:
    """One landing input, reading only the folders of the given channels; the
    channel is taken from the folder name as text (no type inference)."""
    paths = [f for c in channels for f in newest_files(spark, root, kind, c)]
    reader = spark.read.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    if not paths:
        return reader.csv(f"{root}/{kind}").limit(0).withColumn("channel", F.lit(None).cast("string"))
    df = reader.csv(paths)
    return df.select("*", F.col("_metadata.file_path").alias("_path")).withColumn(
        "channel", CF.folder_name("_path", r"/channel=([^/]+)/")).drop("_path")


def newest_files(spark: SparkSession, root: str, kind: str, channel: str) -> list[str]:
    """The files of the last landing of one input of a channel: those of one write share
    the id in ``part-<n>-<id>``; any other file is a landing of its own.  Earlier
    landings are superseded, not added."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    p = jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}/channel={escape(channel)}")
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    landings: dict[str, list] = {}
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if s.isFile() and not name.startswith((".", "_")):
            m = re.match(r"part-[0-9]+-([0-9a-f-]{36})", name)
            landings.setdefault(m[1] if m else name, []).append((s.getModificationTime(), s.getPath().toString()))
    newest = max(landings.values(), key=max, default=[])
    return sorted(path for _, path in newest)


def complete_channels(spark: SparkSession, root: str, channels: list[str], layout: str) -> list[str]:
    """The channels whose inputs are all there; the others wait for theirs."""
    if layout == "landing":
        return [c for c in channels if all(newest_files(spark, root, k, c) for k in LANDING_KINDS)]
    return CF.gate(spark, root, channels)[0]


def decisions_for(spark: SparkSession, root: str, channels: list[str], settings: DataFrame,
                  layout: str = "landing") -> DataFrame:
    """P2 for the given channels from the current input files."""
    chans = spark.createDataFrame([(c,) for c in channels], "channel string")
    eff = effective_settings(chans, settings)
    if layout == "landing":
        stock = read_landing(spark, root, "stock", channels)
        po = read_landing(spark, root, "po", channels)
        dem = read_landing(spark, root, "demand", channels).select(
            "channel", "sku", "region", "window", S.parse_number("value").alias("value"))
    else:
        # listed and looked into once for all five kinds
        inputs = cut_lineage(CF.channel_inputs(spark, root, channels))
        stock = CF.read_stock(spark, root, channels, inputs)
        po = CF.read_po(spark, root, channels, inputs)
        dem = CF.demand_long(CF.read_demand(spark, root, channels, inputs=inputs))
    return RP.replenishment(stock, po, dem, eff)


def writer_id(spark: SparkSession, checkpoint: str) -> str:
    """The query's own id, which its checkpoint keeps over restarts."""
    return json.loads(SN.Folder(spark, checkpoint).read("metadata"))["id"]


def stream_scan(spark: SparkSession, root: str, out: str, checkpoint: str, settings: DataFrame | Callable[[], DataFrame],
                layout: str = "landing", every_minutes: int | None = 60, available_now: bool = False,
                log_path: str | None = None, archive_path: str | None = None, watch: str = "snapshot",
                shared: tuple[str, ...] = (SETTINGS_FILE,)) -> StreamingQuery:
    """Start the scan; read its result with ``snapshots.read(spark, out)``.

    ``every_minutes`` is clamped to at least 1 (as the source application does).
    ``settings`` may be a function, which every batch calls anew (``lambda:
    read_settings(spark, root)``).  A channel with missing inputs is left out of the
    batch; its rows stay as they are.  ``archive_path`` keeps each batch's result.

    ``watch="snapshot"`` sees rewritten files too, and a change of a ``shared`` file (the
    settings) as one of every channel; ``"files"`` is Spark's file source, for file
    systems that only Hadoop can list: it sees new paths only.

    A batch writes its rows aside, then archive and log (folders of its own, overwritten
    when it is replayed), and publishes the rows last."""

    def process(batch: DataFrame, batch_id: int) -> None:
        # the touched channel names: a bounded list (one per channel folder)
        chans = complete_channels(spark, root, sorted({r.channel for r in batch.select("channel").distinct().collect()}), layout)
        if not chans:
            return
        dec = decisions_for(spark, root, chans, settings() if callable(settings) else settings, layout)
        staged = SN.stage(dec, out, chans, writer_id(spark, checkpoint), batch_id)
        if staged is None:
            return
        done = SN.rows(spark, out, staged)
        if archive_path:
            WR.archive(done, archive_path, f"batch_{batch_id}")
        if log_path:
            WR.append_run_log(done, log_path, f"batch_{batch_id}")
        SN.publish(spark, out, staged)

    touched = FW.changed_channels(spark, root, layout, shared) if watch == "snapshot" else touched_channels(spark, root, layout)
    w = touched.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    else:
        w = w.trigger(processingTime=f"{max(1, int(every_minutes or 60))} minutes")
    return w.start()
