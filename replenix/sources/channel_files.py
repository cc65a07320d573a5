"""Channel folders of CSV files.

``root/<channel>/{stock.csv, PO.csv, Sales 8-30.csv, Sales 15.csv, Sales 30.csv}``.
All channels are read in one scan per file kind; the channel comes from the
file path.  CSV cells are read as text and coerced by the operators, so a SKU
such as ``001`` stays ``001``.  Files of one kind may differ in their optional
columns: files are grouped by header and the groups unioned by name.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar as S
from ..operators.stock import ORDER_COL


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_channels(spark: SparkSession, root: str) -> list[str]:
    """A1: sub-folders not starting with '.' or '_', sorted (a directory listing)."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if not n.startswith((".", "_")))


def channel_inputs(spark: SparkSession, root: str, channels: Sequence[str] | None = None,
                   headers_of: Sequence[str] = K.REQUIRED_FILES) -> DataFrame:
    """(channel, file, header): every file of the channel folders and, for those called
    as in ``headers_of``, the column names in its first record (others: null).

    One job, dealt by channel: a task lists its folders and reads the front of each file,
    up to HEADER_BYTES; the driver lists the root alone.  The header is read by CSV rules
    (quoted names may hold commas, quotes and line breaks; a byte order mark is skipped).
    On a file system that only Hadoop can open, the driver does the same one by one."""
    chans = list_channels(spark, root) if channels is None else list(channels)
    schema = "channel string, file string, header array<string>"
    base, wanted, front = root.rstrip("/"), frozenset(headers_of), HEADER_BYTES

    def look(batches):
        # sent to the workers whole: nothing of this package is used in here
        import csv
        import io

        import pandas as pd
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(base)
        for pdf in batches:
            rows = []
            for c in pdf["channel"]:
                for f in where.get_file_info(fs.FileSelector(f"{top}/{c}", allow_not_found=True)):
                    if f.type != fs.FileType.File:
                        continue
                    names = None
                    if f.base_name in wanted:
                        with where.open_input_stream(f.path) as stream:
                            text = stream.read(front).decode("utf-8-sig", "ignore")
                        names = [n.strip() for n in next(csv.reader(io.StringIO(text, newline="")), [])]
                    rows.append((c, f.base_name, names))
            yield pd.DataFrame(rows, columns=["channel", "file", "header"])

    if not chans:
        return spark.createDataFrame([], schema)
    if not _arrow_opens(base):
        return spark.createDataFrame([(c, n, _header(spark, f"{base}/{c}/{n}") if n in wanted else None) for c in chans for n in _files(spark, f"{base}/{c}")], schema)
    if base.startswith("file:"):
        base = "/" + base[len("file:"):].lstrip("/")
    parts = min(len(chans), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame([(c,) for c in chans], "channel string").repartition(parts, "channel").mapInPandas(look, schema)


#: bytes of a file in which its header must end
HEADER_BYTES = 1 << 16


def _arrow_opens(root: str) -> bool:
    from pyarrow import fs
    try:
        fs.FileSystem.from_uri(root if "://" in root or not root.startswith("file:") else "/" + root[len("file:"):].lstrip("/"))
        return True
    except (ValueError, NotImplementedError, OSError):
        return False


def _files(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isFile()] if fs.exists(p) else []


def _header(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        text = bytes(stream.readNBytes(HEADER_BYTES)).decode("utf-8-sig", "ignore")
    finally:
        stream.close()
    return [n.strip() for n in next(csv.reader(io.StringIO(text, newline="")), [])]


def channel_files(spark: SparkSession, root: str, channels: Sequence[str] | None = None) -> DataFrame:
    """(channel, file) for every file that exists in a channel folder (for J1)."""
    return channel_inputs(spark, root, channels, ()).select("channel", "file")


def read_channel_csv(spark: SparkSession, root: str, file_name: str, channels: Sequence[str] | None = None,
                     inputs: DataFrame | None = None) -> DataFrame:
    """One kind of channel file over all channels, all columns as text, plus
    ``channel`` and a file-order column used for first-row de-duplication.  ``inputs``:
    the rows of ``channel_inputs``, if they are known already."""
    known = channel_inputs(spark, root, channels, (file_name,)) if inputs is None else inputs
    # the distinct headers with their channels' names: a few bytes for each channel
    rows = known.where(F.col("file") == file_name).groupBy("header").agg(F.sort_array(F.collect_set("channel")).alias("channels")).collect()
    if not rows:
        raise FileNotFoundError(f"no {file_name} under {root}")
    out = None
    for header, chans in sorted((tuple(r.header), r.channels) for r in rows):
        names = [f"`{c.replace('`', '``')}`" for c in header]
        df = (spark.read.options(header=True, encoding="UTF-8", quote='"', escape='"', multiLine=True).schema(", ".join(f"{n} string" for n in names))
              .csv([f"{root.rstrip('/')}/{c}/{file_name}" for c in chans]))
        df = (df.select(*[F.when(~F.trim(F.col(n)).isin(*K.NULL_MARKERS), F.col(n)).alias(c) for n, c in zip(names, header, strict=True)], "_metadata")
              .withColumn("_path", F.col("_metadata.file_path"))
              .withColumn("_header", F.lit(K.HEADER_SEP.join(header)))
              .withColumn(ORDER_COL, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                              F.monotonically_increasing_id()))
              .drop("_metadata"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("channel", folder_name("_path")).drop("_path")


def folder_name(path: str, pattern: str = r"([^/]+)/[^/]+$"):
    """The folder of a file path as it is called: paths are percent-encoded."""
    return F.url_decode(F.replace(F.regexp_extract(F.col(path), pattern, 1), F.lit("+"), F.lit("%2B")))


def input_problems(channels: DataFrame, inputs: DataFrame) -> DataFrame:
    """J1 and J2 as rows (channel, file, problem): each required file that a channel lacks,
    and each that lacks required columns, named in their order."""
    required = F.map_from_arrays(F.array(*[F.lit(f) for f in K.REQUIRED_FILES]),
                                 F.array(*[F.array(*[F.lit(c) for c in K.REQUIRED_COLUMNS[f]]) for f in K.REQUIRED_FILES]))
    need = channels.select("channel", F.explode(required).alias("file", "columns"))
    state = need.join(inputs.select("channel", "file", "header", F.lit(True).alias("found")), ["channel", "file"], "left")
    lacks = F.array_join(F.filter("columns", lambda c: ~F.array_contains("header", c)), ", ")
    problem = F.when(F.col("found").isNull(), F.concat("file", F.lit(" is missing"))).when(lacks != "", F.concat("file", F.lit(" lacks "), lacks))
    return state.select("channel", "file", problem.alias("problem")).where("problem is not null")


def gate(spark: SparkSession, root: str, channels: Sequence[str] | None = None, inputs: DataFrame | None = None) -> tuple[list[str], list[tuple[str, str]]]:
    """J1 and J2 before the analysis: the channels that have all five files with all
    required columns, and (channel, problem) rows of the others, which are refused."""
    chans = list_channels(spark, root) if channels is None else list(channels)
    found = channel_inputs(spark, root, chans) if inputs is None else inputs
    rows = input_problems(spark.createDataFrame([(c,) for c in chans], "channel string"), found).collect()
    order = {f: i for i, f in enumerate(K.REQUIRED_FILES)}
    bad = [(r.channel, r.problem) for r in sorted(rows, key=lambda r: (r.channel, order[r.file]))]
    refused = {c for c, _ in bad}
    return [c for c in chans if c not in refused], bad


def read_stock(spark: SparkSession, root: str, channels: Sequence[str] | None = None, inputs: DataFrame | None = None) -> DataFrame:
    """A2: stock.csv (wide)."""
    return read_channel_csv(spark, root, "stock.csv", channels, inputs)


def read_po(spark: SparkSession, root: str, channels: Sequence[str] | None = None, inputs: DataFrame | None = None) -> DataFrame:
    """A3: PO.csv."""
    return read_channel_csv(spark, root, "PO.csv", channels, inputs)


def read_demand(spark: SparkSession, root: str, channels: Sequence[str] | None = None,
                windows: Sequence[tuple[str, str]] = K.DEMAND_FILES, inputs: DataFrame | None = None) -> DataFrame:
    """A4: the three demand files as one long DataFrame with a ``window`` column
    (and the file's own columns, e.g. ``WindowType``, when present)."""
    out = None
    for window, name in windows:
        df = read_channel_csv(spark, root, name, channels, inputs).withColumn("window", F.lit(window))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def demand_long(raw: DataFrame) -> DataFrame:
    """Demand rows for the decision step: numeric value (bad text -> null)."""
    return raw.filter(F.col("Sku").isNotNull() & F.col("Region").isNotNull()).select(
        "channel", F.col("Sku").alias("sku"), F.col("Region").alias("region"), "window",
        S.parse_number("AvgDailyDemand_3Checkins_Avg").alias("value"))
