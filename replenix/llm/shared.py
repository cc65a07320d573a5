"""Helpers that several operators use: tables, scratch tables, connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Hand this package's source to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_replenix_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="replenix-src-"), "replenix_src.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(to)
    sc._replenix_shipped = True


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with the package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    A private temporary folder serves only sessions with a local master (tests);
    a cluster without the setting is an error, as executors could not see it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="replenix-llm-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame, name: str, batch: int | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage
    ends there, so a lost executor costs no recomputation of what came before.
    The folder goes when the session ends.  ``batch``: at most so many rows in an
    Arrow batch meanwhile, for rows that hold lists of texts.  ``by``: the last column,
    by whose values the files lie apart, so a reader of one value opens its own alone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if batch:
            spark.conf.set(key, str(batch))
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(key, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Free the disk of what has been read for the last time: the folders of tables that
    ``cut`` wrote, and, by a collection in the driver, the shuffle files of jobs whose
    results are written, which Spark deletes once nothing refers to them."""
    for made in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(made._scratch)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()


def crc_of(col: str) -> F.Column:
    """crc32 of the decimal text of an id (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long): one row (node, root) for each
    node of an edge, root the smallest node reachable.

    Alternating large-star and small-star steps; each is a minimum per node (combined
    before the shuffle) and a join, so a node with very many links is never gathered
    in one task, and AQE splits its partition of the join. Every step is a table in
    the shared folder. Raises if ``rounds`` do not suffice."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    sign = None
    for _ in range(rounds):
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "cc")
        # small star: every smaller neighbour of u, and u, go to the smallest neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = cut(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                  .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                      F.sum((F.col("a").cast("decimal(38,0)")))).first()
        if tuple(row) == sign:
            break
        sign = tuple(row)
    else:
        raise RuntimeError(f"components: not stable after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
