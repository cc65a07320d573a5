"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, ship

#: sources are configuration: more of them than this is an error
MOST_SOURCES = 100_000


def water_fill(sizes: list[float], weights: list[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; no share exceeds ``most`` times its size, and what
    exceeds is shared anew by weight among the others."""
    target, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while open_ and left > 0:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w >= most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def pivotal(size: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Round fractions ``p`` (0 to 1) so that sum(size * p) stays: the fraction held is
    paired with the next one, and size-weighted mass moves between the two, either way
    with the chance that keeps both expectations, until one is 0 or 1.  All entries of
    the result are 0 or 1 but one at most, which keeps its fraction.  By descending
    size, so that the one left over tends to be small."""
    out, rng, held = p.astype(float).copy(), np.random.Generator(np.random.PCG64(seed)), -1
    for j in np.argsort(-size, kind="stable"):
        if not 1e-9 < out[j] < 1 - 1e-9:
            out[j] = round(out[j])
            continue
        if held < 0:
            held = j
            continue
        a, b = size[held], size[j]
        up = min((1 - out[held]) * a, out[j] * b)  # mass from j to the one held
        down = min(out[held] * a, (1 - out[j]) * b)
        move = up if rng.random() * (up + down) < down else -down
        out[held] += move / a
        out[j] -= move / b
        for i in (held, j):
            if not 1e-9 < out[i] < 1 - 1e-9:
                out[i] = round(out[i])
        held = held if 0 < out[held] < 1 else j if 0 < out[j] < 1 else -1
    return out


def mix(docs: DataFrame, source_col: str = "source", size: str | F.Column = "size", weights: tuple[float, ...] = (1.0, 2.0, 3.0),
        share: float = 1.0, most: float = 3.0, seed: int = 17, group_rows: int = 4096, fan_in: int = 64) -> DataFrame:
    """``docs`` with source_size, target, copies and taken (= copies * size).

    Sources in code point order (null last) weigh ``weights``, repeating, and share
    ``share`` of all sizes by ``water_fill``.  A document is wanted target / source_size
    times: the whole part as often as it says, the fraction by ``pivotal``.  Rows are
    dealt by a hash into groups of about ``group_rows``, so that a source of any size
    is split; each group leaves one fractional row at most, and these are combined by
    ``fan_in`` groups at a time in a reduction tree until one is left in each source,
    which is rounded to the nearer side.  The words taken from a source so miss the
    target by half a document at most.  All chance comes from hashes of the row: reruns agree.

    Rows of size 0 and of a source with target 0 have the whole part alone, rounded.
    Null ids, null sources (one source, last) and repeated rows are rows like others;
    equal rows may round differently.  An empty table gives no rows.  Columns of
    ``docs`` with the names made here are replaced; names beginning with two
    underscores are reserved."""
    made = ["size", "source_size", "target", "copies", "taken"]
    size = F.col(size) if isinstance(size, str) else size
    rows = docs.withColumn("__size", F.coalesce(size.cast("long"), F.lit(0)))
    rows = rows.drop(*[c for c in made if c != source_col])
    totals = rows.groupBy(F.col(source_col).alias("__s")).agg(F.sum("__size").alias("n"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r["__s"] is None, "" if r["__s"] is None else str(r["__s"])))
    sizes = [float(r["n"]) for r in totals]
    target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    spark = docs.sparkSession
    ship(spark)
    groups = [max(1, -(-r["rows"] // group_rows)) for r in totals]
    shares = spark.createDataFrame(
        [(r["__s"], int(r["n"]), t, min(t / r["n"], most) if r["n"] else 0.0, g) for r, t, g in zip(totals, target, groups, strict=True)],
        f"__k {docs.schema[source_col].dataType.simpleString()}, source_size long, target double, __want double, __groups long")
    # at most MOST_SOURCES rows, and large lists are left to the planner
    rows = rows.join(F.broadcast(shares) if len(totals) <= 10_000 else shares, F.col(source_col).eqNullSafe(F.col("__k"))).drop("__k")
    names = [c for c in rows.columns if not c.startswith("__") and c not in made]
    row_hash = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`").cast("string") for c in names if c != "text"], F.col("__size"))
    rows = (rows.withColumn("__hash", row_hash)
            .withColumn("__p", F.when(F.col("__size") > 0, F.col("__want") - F.floor("__want")).otherwise(F.lit(0.0)))
            .withColumn("__group", F.pmod(F.xxhash64("__hash", F.lit(1)), F.col("__groups"))))

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__hash", "__size"], kind="stable").reset_index(drop=True)
        h = pdf["__hash"].to_numpy()
        pdf["__p"] = pivotal(pdf["__size"].to_numpy(float), pdf["__p"].to_numpy(float), int(h[0] & 0x7FFFFFFFFFFFFFFF))
        return pdf

    settled, now, level = [], rows, max(groups, default=1)
    while True:
        done = cut(now.groupBy(source_col, "__group").applyInPandas(rounded, now.schema), "mix")
        part = F.col("__p").between(1e-9, 1 - 1e-9)
        if level <= 1:
            settled.append(done.withColumn("__p", F.round("__p")))  # the last one of a source
            break
        settled.append(done.where(~part).withColumn("__p", F.round("__p")))
        now = done.where(part).withColumn("__group", F.floor(F.col("__group") / fan_in))
        level = -(-level // fan_in)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = (F.floor("__want") + F.col("__p")).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in names], F.col("__size").alias("size"), "source_size", "target",
                      copies.alias("copies"), (copies * F.col("__size")).alias("taken"))
