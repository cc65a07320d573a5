"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import forest, in_blocks
from .shared import components, cut, map_arrow
from .words import span_hash

BITS = 48


def valid_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None if null, zero, empty, or with null or
    non-finite components."""
    out = []
    for v in column.to_pylist():
        x = None if not v or None in v else np.array(v, np.float64)
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def unit(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length, scaled to length 1 (first to a largest component of 1, so
    that squares neither overflow nor vanish)."""
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def planes(number: int, dim: int) -> np.ndarray:
    """The random directions of a pass."""
    return np.random.Generator(np.random.PCG64([97, number, dim])).standard_normal((dim, BITS))


def pass_count(rows: int, block: int, cosine: float, miss: float) -> int:
    """So many passes that a pair at the cosine is missed by all with chance ``miss`` if
    signs split the rows evenly: it shares a hash with chance p, and a block with p to
    the number of hashes that tell the blocks apart.  ``near_edges`` begins with it."""
    p = 1 - math.acos(cosine) / math.pi
    shared = p ** max(1.0, math.log2(max(rows / block, 2)))
    return max(4, math.ceil(math.log(miss) / math.log(1 - shared)))


def classes_of(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, cls (hash of the components, null for vectors that link with nothing) and
    the components as bytes of doubles."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = valid_rows(b.column(1))
            raw = [x.astype("<f8").tobytes() if x is not None else None for x in got]
            joined = np.frombuffer(b"".join(r or b"" for r in raw), np.uint8)
            at = np.concatenate([[0], np.cumsum([len(r or b"") for r in raw])]).astype(np.int64)
            cls = span_hash(joined, at[:-1], at[1:]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, mask=np.array([r is None for r in raw], bool)), pa.array(raw, pa.binary())],
                                             ["vec_id", "cls", "raw"])

    return map_arrow(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")), run, f"vec_id {kind}, cls long, raw binary")


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits, of BITS, that two keys have in common."""
    return BITS - np.frexp((a ^ b).astype(float))[1]


def sorted_passes(classes: DataFrame, cosine: float, passes: int, block: int, window: int, first: int = 0) -> DataFrame:
    """Edges (a, b): in each pass, from number ``first`` on, the classes are ordered by the
    concatenated signs of random projections; each block of ``block`` neighbours and the
    ``window`` next ones is compared, and a spanning forest of its pairs at the cosine is kept.

    Other rows have pass and depth: the bits that class a shares with the one ``window``
    places before or after it (-1: there is none), beyond which all are neighbours."""

    def project(batches):
        for b in batches:
            cls, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            size = np.array([len(r) // 8 for r in raw])
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = unit([raw[i] for i in at])
                for k in range(first, first + passes):
                    bits = (x @ planes(k, int(dim)) > 0).astype(np.int64)
                    key = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(key), pa.array(cls[at]),
                                                      pa.array([raw[i] for i in at], pa.binary())], ["pass", "dim", "key", "cls", "raw"])

    keyed = map_arrow(classes.select("cls", "raw"), project, "pass int, dim int, key long, cls long, raw binary")
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), passes)
    order = ["pass", "dim", "key", "cls"]
    # the place of a row in its partition, and with the rows of the partitions before it (one number each) in the whole order
    ordered = cut(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "passes")
    part = F.shiftright("place", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(F.col("place").bitwiseAND((1 << 33) - 1)).alias("low")).orderBy("part").collect()
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["part"], before - r["low"]))
        before += r["n"]
    if not offsets:
        return classes.sparkSession.createDataFrame([], "a long, b long, pass int, depth int")
    small = classes.sparkSession.createDataFrame(offsets, "part long, add long")  # one row for each of the partitions
    ranked = ordered.withColumn("part", part).join(F.broadcast(small), "part").withColumn("rank", F.col("place").bitwiseAND((1 << 33) - 1) + F.col("add"))
    own = F.floor(F.col("rank") / block)
    blocks = ranked.withColumn("block", F.explode(F.when((F.col("rank") % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))))
    groups = blocks.groupBy("block", "pass", "dim").agg(F.collect_list(F.struct("cls", "raw", "rank", "key")).alias("m"))

    def compare(batches):
        for b in batches:
            for k in range(b.num_rows):
                m = b.column(3).slice(k, 1).flatten()
                m = m.take(pa.array(np.argsort(m.field(2).to_numpy())))
                cls, rank, key, x = m.field(0).to_numpy(), m.field(2).to_numpy(), m.field(3).to_numpy(), unit(m.field(1).to_pylist())
                r, c = forest(x @ x.T >= cosine)
                own, n = int((rank // block == b.column(0)[k].as_py()).sum()), len(cls)
                depth = shared_bits(key[:n - window], key[window:]) if n > window else np.zeros(0, np.int64)
                later = np.full(own, -1)
                later[:min(own, len(depth))] = depth[:own]
                a = np.concatenate([cls[r], cls[:own], cls[window:]])
                bits = np.concatenate([later, depth]).astype(np.int32)
                free = np.arange(len(a)) < len(r)
                yield pa.RecordBatch.from_arrays([
                    pa.array(a), pa.array(np.concatenate([cls[c], np.zeros(len(bits), np.int64)]), mask=~free),
                    pa.array(np.full(len(a), b.column(1)[k].as_py(), np.int32)), pa.array(np.concatenate([np.zeros(len(r), np.int32), bits]), mask=free)],
                    ["a", "b", "pass", "depth"])

    return cut(map_arrow(groups, compare, "a long, b long, pass int, depth int"), "near", batch=16)


def all_pairs(classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """Edges (a, b): spanning forests of all pairs at the cosine, in pairs of blocks."""
    rows = classes.select("cls", "raw", F.length("raw").alias("dim"))
    dealt = in_blocks(rows.join(rows.groupBy("dim").agg(F.count("*").alias("n")), "dim"), "dim", F.ceil(F.col("n") / block), "cls")
    groups = dealt.groupBy("dim", "bi", "bj").agg(F.collect_list(F.struct("cls", "raw")).alias("m"))

    def compare(batches):
        for b in batches:
            for k in range(b.num_rows):
                m = b.column(3).slice(k, 1).flatten()
                cls, x = m.field(0).to_numpy(), unit(m.field(1).to_pylist())
                r, c = forest(x @ x.T >= cosine)
                yield pa.RecordBatch.from_arrays([pa.array(cls[r]), pa.array(cls[c])], ["a", "b"])

    return cut(map_arrow(groups, compare, "a long, b long"), "near", batch=16)


def near_edges(classes: DataFrame, cosine: float, miss: float, block: int, window: int, rounds: int = 4) -> DataFrame:
    """Edges (a, b) that connect the pairs at the cosine, each missed with chance ``miss``
    at most.

    A pair that shares more bits than ``sorted_passes`` measures around one of its ends
    is compared, so a pass misses it with chance 1 - p ** (depth + 1).  Classes for which
    the passes together stay above ``miss`` go into more passes among themselves (a pair
    with a class that is done is done), or, once that writes more rows than it or after
    ``rounds``, into ``all_pairs``."""
    p = 1 - math.acos(cosine) / math.pi
    left, done, n = classes.select("cls", "raw", F.lit(0.0).alias("owed")), 0, classes.count()
    need, edges = pass_count(n, window, cosine, miss), []
    for turn in range(rounds):
        if turn and (not n or turn == rounds - 1 or need * block >= n):
            break
        made = sorted_passes(left, cosine, need, block, window, done)
        edges.append(made.where("depth is null").select("a", "b"))
        depth = made.where("depth is not null").groupBy("a", "pass").agg(F.max("depth").alias("d"))
        chance = F.when(F.col("d") < 0, F.lit(-1e9)).when(F.col("d") >= BITS, F.lit(0.0)).otherwise(F.log(1 - F.pow(F.lit(p), F.col("d") + 1)))
        own = depth.groupBy(F.col("a").alias("cls")).agg(F.sum(chance).alias("got"))
        left = cut(left.join(own, "cls").withColumn("owed", F.col("owed") + F.col("got")).where(F.col("owed") > math.log(miss)), "left")
        more = F.ceil((math.log(miss) - F.col("owed")) * need / F.least("got", F.lit(-1e-9)))
        done += need
        n, need = left.agg(F.count("*"), F.percentile_approx(more, 0.9)).first()
        need = max(int(need or 0), 4)
        left = left.select("cls", "raw", "owed")
    if n:
        edges.append(all_pairs(left, cosine, block))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def link_counts(classes: DataFrame, found: DataFrame, cosine: float, block: int) -> DataFrame:
    """cls, links: the vectors of other classes of its component at the cosine, counted
    exactly, in pairs of blocks."""
    members = found.withColumnRenamed("node", "cls").join(classes, "cls")
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    dealt = in_blocks(members.join(sizes, "root"), "root", F.ceil(F.col("n") / block), "cls")
    groups = dealt.groupBy("root", "bi", "bj").agg(F.collect_list(F.struct("cls", "own", "copies", "raw")).alias("m"))

    def count(batches):
        for b in batches:
            ids, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(b.num_rows):
                m = b.column(3).slice(k, 1).flatten()
                cls, own, copies, x = m.field(0).to_numpy(), m.field(1).to_numpy(), m.field(2).to_numpy(), unit(m.field(3).to_pylist())
                near = x @ x.T >= cosine
                if b.column(1)[k] != b.column(2)[k]:
                    near &= own[:, None] != own[None, :]
                else:
                    np.fill_diagonal(near, False)
                ids.append(cls)
                links.append(near.astype(np.int64) @ copies)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links))], ["cls", "links"])

    return cut(map_arrow(groups, count, "cls long, links long"), "links", batch=16).groupBy("cls").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, block: int = 1024, window: int = 256,
                 miss: float = 1e-4) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors at the cosine or more),
    component_id (smallest vec_id reachable by links) and kept.

    Equal vectors are one class.  Passes over the classes, sorted by concatenated random
    hashes, find the components: neighbours in a bounded window are compared in double
    precision, and the pairs of all passes are united.  A pair at the cosine is missed
    by every pass with chance ``miss`` at most, as measured where its neighbours part
    (``near_edges``): crowded vectors go through more passes or all their pairs; a pair missed matters
    only if nothing else connects its ends, because the links within a component are
    then counted over all its pairs, in pairs of blocks: the window caps no partner.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing: n_links 0, their own component.  Vectors of different length never link.
    Null ids: the component's smallest id that is not null, kept null-safe.  Repeated
    rows are vectors like others.  Empty table: no rows; other columns are ignored."""
    rows = cut(classes_of(vectors, id_col, vec_col), "vectors")
    classes = cut(rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "classes")
    # classes of one direction and rounding meet in the first pass as others do
    found = cut(components(near_edges(classes, cosine, miss, block, window)), "found")
    links = link_counts(classes.select("cls", "copies", "raw"), found, cosine, block)
    named = found.withColumnRenamed("node", "cls").join(classes.select("cls", "least"), "cls")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = cut(classes.select("cls", "least", "copies").join(named.select("cls", "root").join(least, "root").drop("root"), "cls", "left").join(links, "cls", "left")
                .select("cls", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    out = rows.select("vec_id", "cls").join(known, "cls", "left")
    alone = F.col("cls").isNull()
    return out.select("vec_id", F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
                      F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")) \
              .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def sql(cosine: float = 0.95) -> str:
    """DuckDB SQL for ``near_vectors`` over embeddings."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS vec_id, (SELECT count(*) FROM l WHERE l.a = r.a) AS n_links, min(b) AS component_id, a = min(b) AS kept FROM r GROUP BY a"""
