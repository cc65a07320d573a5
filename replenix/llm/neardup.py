"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature has HASHES symbols of 16 bits.  Two sets of Jaccard similarity s differ
in each symbol with chance 1 - s at most, so at 0.85 more than ERRORS of the 48
differ once in 10^5 or so.  The symbols are split into CHUNKS chunks; if ERRORS =
2 * CHUNKS - 1 symbols differ at most, some chunk differs in one symbol at most
(pigeonhole).  Each chunk is therefore written once for each symbol left out, and
every pair within ERRORS meets under some such key: none is missed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, map_arrow
from .words import mix, per_row, shingles, slices, span_hash, split

HASHES, CHUNKS, ERRORS = 48, 10, 19
LONGS = HASHES // 4
WORDS_IN_SHINGLE = 5
_A = mix(np.arange(5001, 5001 + HASHES, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(6001, 6001 + HASHES, dtype=np.uint64))
_PARTS = np.array_split(np.arange(HASHES), CHUNKS)
_KEYS = [(c, left, np.delete(part, left)) for c, part in enumerate(_PARTS) for left in range(len(part))]


def text_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of each row (A-Z lower-cased), where rows start, and which of the
    hashes are the first of their kind in the row."""
    starts, stops, lo = split(data, at)
    s, first = shingles(span_hash(data, starts, stops, fold=True), lo, WORDS_IN_SHINGLE)
    rows = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(first))
    keys = s ^ mix(rows + np.uint64(7))
    order = np.argsort(keys)
    new = np.ones(len(s), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    once = np.zeros(len(s), bool)
    once[order[new]] = True
    return s, first, once


def set_id(s: np.ndarray, first: np.ndarray, once: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set, whatever its order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s + np.uint64(11)) * once)])
    return mix(total[first[1:]] - total[first[:-1]] + per_row(once, first).astype(np.uint64)).view(np.int64)


def signatures(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, HASHES) symbols; rows without shingles have zeros."""
    out = np.zeros((len(first) - 1, HASHES), np.uint16)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        for k in range(HASHES):
            least = np.minimum.reduceat(s * _A[k] + _B[k], first[some])
            out[some, k] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def sketches(docs: DataFrame, text: str) -> DataFrame:
    """rid (long, of the id or, without one, of the text), doc_id, n_shingles, n_bytes,
    cls (the set's hash, null without shingles) and the signature as LONGS longs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = docs.select("doc_id", row_id(text).alias("rid"), F.col(text).cast("string").alias("text"))
    sig = [f"s{i}" for i in range(LONGS)]

    def run(batches):
        for b in batches:
            for i, j, data, at in slices(b.column(2)):
                s, first, once = text_sets(data, at)
                n = per_row(once, first)
                longs = signatures(s, first).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(np.diff(at).astype(np.int64)),
                     pa.array(set_id(s, first, once), mask=n == 0), *[pa.array(np.ascontiguousarray(longs[:, k])) for k in range(LONGS)]],
                    ["doc_id", "rid", "n_shingles", "n_bytes", "cls", *sig])

    return map_arrow(picked, run, f"doc_id {kind}, rid long, n_shingles long, n_bytes long, cls long, " + ", ".join(f"{s} long" for s in sig))


def row_id(text: str) -> F.Column:
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string"))).otherwise(F.xxhash64(F.lit(1), F.col(text)))


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) of a spanning star forest of a symmetric boolean matrix."""
    n = len(near)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        seen = np.zeros(n, bool)
        seen[i] = True
        edge = seen
        while edge.any():
            edge = near[edge].any(0) & ~seen
            seen = seen | edge
        root[seen] = i
    at = np.flatnonzero(root != np.arange(n))
    return root[at], at


def in_blocks(rows: DataFrame, group: str, count: F.Column, member: str) -> DataFrame:
    """Deal the members of each group into ``count`` blocks (column own) and each block to
    its pairs with itself and all others (columns bi, bj): any two members meet."""
    return (rows.withColumn("__nb", F.greatest(count.cast("int"), F.lit(1)))
            .withColumn("own", F.pmod(F.xxhash64(member, F.lit(5)), F.col("__nb")).cast("int"))
            .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
            .withColumn("bi", F.least("own", "__other")).withColumn("bj", F.greatest("own", "__other"))
            .drop("__nb", "__other"))


def signature_clusters(classes: DataFrame, block: int = 1024) -> DataFrame:
    """(node, root) of the components of the graph of all pairs of classes whose
    signatures differ in ERRORS symbols at most."""
    sig = [f"s{i}" for i in range(LONGS)]

    def keyed(batches):
        for b in batches:
            got = np.stack([b.column(1 + k).to_numpy(zero_copy_only=False) for k in range(LONGS)], 1).view(np.uint16).astype(np.uint64)
            keys = []
            for c, left, at in _KEYS:
                h = np.full(len(got), np.uint64(c * 64 + left + 1))
                for k in at:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + got[:, k])
                keys.append(h.view(np.int64))
            cls = np.tile(b.column(0).to_numpy(), len(_KEYS))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(cls)], ["key", "cls"])

    keys = map_arrow(classes.select("cls", *sig), keyed, "key long, cls long")
    # buckets of several members; of those with the same members one is enough
    buckets = (keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
               .where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")))
    rows = keys.join(buckets.select("key", "n"), "key")
    rows = in_blocks(rows, "key", F.ceil(F.col("n") / block), "cls")
    rows = rows.join(classes.select("cls", *sig), "cls")
    packed = rows.groupBy("key", "bi", "bj").agg(F.collect_list(F.struct("cls", *sig)).alias("m"))

    def compare(batches):
        for b in batches:
            m = b.column(3)
            at = m.offsets.to_numpy() - m.offsets[0].as_py()
            flat = m.flatten()
            cls = flat.field(0).to_numpy()
            got = np.stack([flat.field(1 + k).to_numpy() for k in range(LONGS)], 1).view(np.uint16) if len(flat) else np.zeros((0, HASHES), np.uint16)
            a, z = [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                some = got[lo:hi]
                if hi - lo == 2:
                    if (some[0] != some[1]).sum() <= ERRORS:
                        a.append(cls[lo:lo + 1])
                        z.append(cls[lo + 1:hi])
                    continue
                same = np.zeros((hi - lo, hi - lo), np.int16)
                for k in range(HASHES):
                    same += some[:, k][:, None] == some[:, k][None, :]
                r, c = forest(same >= HASHES - ERRORS)
                a.append(cls[lo + r])
                z.append(cls[lo + c])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a) if a else np.zeros(0, np.int64), pa.int64()),
                                              pa.array(np.concatenate(z) if z else np.zeros(0, np.int64), pa.int64())], ["a", "b"])

    return components(cut(map_arrow(packed, compare, "a long, b long"), "near", batch=512))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted sets without repeats."""
    m = len(sets)
    if m <= 8:
        out = np.zeros((m, m), np.int64)
        for i in range(m):
            out[i, i] = len(sets[i])
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    _, what, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    wide = np.flatnonzero(many > 1)
    number = np.full(len(many), -1)
    number[wide] = np.arange(len(wide))
    what = number[what]
    out = np.zeros((m, m), np.float64)
    order = np.argsort(what, kind="stable")
    order = order[np.searchsorted(what[order], 0):]
    cols = what[order]
    for k in range(0, len(wide), 4096):
        lo, hi = np.searchsorted(cols, (k, k + 4096))
        x = np.zeros((m, min(4096, len(wide) - k)), np.float32)
        x[who[order[lo:hi]], cols[lo:hi] - k] = 1
        out += x @ x.T
    out[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return np.rint(out).astype(np.int64)


def confirmed_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, text: str, percent: int, block: int = 512, block_bytes: int = 8 << 20) -> DataFrame:
    """Edges (a, b) between classes of a cluster that span its links: 100 * common >=
    percent * union, on the full sets of one text of each class."""
    members = clusters.withColumnRenamed("node", "cls").join(classes.select("cls", "rid", "n_bytes"), "cls")
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    members = members.join(sizes.where("n > 1"), "root")
    members = cut(in_blocks(members, "root", F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / block_bytes)), "cls")
                  .select("root", "cls", "rid", "bi", "bj"), "members")
    texts = docs.select(row_id(text).alias("rid"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    packed = texts.join(members.hint("merge"), "rid").groupBy("root", "bi", "bj").agg(F.collect_list(F.struct("cls", "text")).alias("m"))

    def compare(batches):
        for b in batches:
            a, z = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(b.num_rows):
                m = b.column(3).slice(k, 1).flatten()
                cls = m.field(0).to_numpy()
                sets, own = [], []
                for _, _, data, at in slices(m.field(1)):
                    s, first, once = text_sets(data, at)
                    own.append(set_id(s, first, once))
                    sets += [np.sort(s[lo:hi][once[lo:hi]]) for lo, hi in zip(first[:-1], first[1:], strict=True)]
                # texts that merely share an id go; of repeated rows one stays
                keep = np.unique(cls, return_index=True)[1] if (ok := np.concatenate(own) == cls).all() else \
                    np.flatnonzero(ok)[np.unique(cls[ok], return_index=True)[1]]
                sets, cls = [sets[i] for i in keep], cls[keep]
                n = np.array([len(s) for s in sets], np.int64)
                common = common_counts(sets)
                r, c = forest(100 * common >= percent * (n[:, None] + n[None, :] - common))
                a.append(cls[r])
                z.append(cls[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(z))], ["a", "b"])

    return cut(map_arrow(packed, compare, "a long, b long"), "links", batch=16)


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = 85) -> DataFrame:
    """Per row of ``docs`` (column doc_id): doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links, itself included) and kept (doc_id = component_id).

    Sets are the distinct five-word shingles of the whole text, A-Z lower-cased, or the
    whole sequence of fewer words; links have 100 * common >= ``percent`` * union.  Equal
    sets are one class from the start.  Classes whose signatures are within ERRORS
    form clusters, found through keys that guarantee every such pair, and within a
    cluster the links are confirmed on full sets, in blocks of bounded size whose output
    is a spanning forest: no pairs of a group are written out.  ``percent`` of at least
    85 is what ERRORS is meant for; lower values lose recall.

    Texts that are null, empty or without words link with nothing.  Null ids: the
    component has the smallest id that is not null, and kept compares null-safely.
    Repeated rows share their component; rows of one id with different texts are
    judged apart.  Empty table: no rows; other columns are ignored."""
    sketch = cut(sketches(docs, text), "sketch")
    sig = [f"s{i}" for i in range(LONGS)]
    classes = cut(sketch.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.min("rid").alias("rid"), F.max("n_bytes").alias("n_bytes"), *[F.max(s).alias(s) for s in sig]), "classes")
    clusters = signature_clusters(classes)
    links = confirmed_links(docs, classes, clusters, text, percent)
    linked = components(links).withColumnRenamed("node", "cls")
    named = linked.join(classes.select("cls", "least"), "cls")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = cut(classes.select("cls", "least").join(named.select("cls", "root").join(least, "root").drop("root"), "cls", "left")
                   .select("cls", F.coalesce("component_id", "least").alias("component_id")), "component")
    return (sketch.select("doc_id", "n_shingles", "cls").join(of_class, "cls", "left")
            .select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def sql(percent: int = 85) -> str:
    """DuckDB SQL for ``near_duplicates`` over documents."""
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w
           FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
