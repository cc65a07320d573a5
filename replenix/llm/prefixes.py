"""The trie of conversations' common beginnings, node by node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc_of, cut, map_arrow, ship

WORDS = r"[^\x20\x09-\x0D]+"
#: bytes of a turn's hash in a sequence's key
WIDTH = 16
#: turns of a block of sorted sequences, and blocks that are merged at a time
BLOCK_TURNS, FAN_IN = 200_000, 64
#: the digest of no ids
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, seq (MD5 of the key), key (an MD5 of 16 bytes for each turn, in order) and
    words (each turn's number of words), for every conversation.

    A conversation begins with the first h turns of conversation c - c % 20 (h = crc32 of
    c mod 4) and goes on with its own after the first h.  Turns go by ``order``, null
    first, ties by hash.  Texts are hashed where they lie and are not shuffled."""
    what = F.concat(F.coalesce(F.col(role).cast("string"), F.lit("")), F.lit("\u0000"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    size = F.char_length(F.coalesce(F.col(role).cast("string"), F.lit(""))).cast("string")
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.struct(F.col(order).alias("o"), F.md5(F.concat_ws(":", size, what)).alias("h"),
                                               F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("n")).alias("turn"))
    whole = cut(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["h"].alias("h"), t["n"].alias("n"))).alias("turns")), "turns")
    first = whole.where("conv_id % 20 = 0").select(F.col("conv_id").alias("from"), F.slice("turns", 1, 3).alias("head"))
    made = whole.withColumns({"from": F.col("conv_id") - F.col("conv_id") % 20, "h": (crc_of("conv_id") % 4).cast("int")}).join(first, "from", "left")
    made = made.select("conv_id", F.expr("concat(slice(coalesce(head, slice(turns, 1, 0)), 1, h), slice(turns, h + 1, size(turns)))").alias("turns"))
    key = F.array_join(F.transform("turns", lambda t: t["h"]), "")
    return made.select("conv_id", F.md5(key).alias("seq"), F.unhex(key).alias("key"), F.transform("turns", lambda t: t["n"]).alias("words"))


def ends(conversations: DataFrame) -> DataFrame:
    """seq, n (conversations of that sequence), conv_id (the smallest), sha (of their
    ids, ascending and comma-joined).  The digest is fed in order as the sorted ids pass,
    so a large group of equal conversations takes time but no memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = digest = least = None
        n, done = 0, []

        def out():
            return pa.RecordBatch.from_pylist([dict(zip(("seq", "n", "conv_id", "sha"), d, strict=True)) for d in done], schema)

        for batch in batches:
            for s, c in zip(batch["seq"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if s != seq:
                    if seq is not None:
                        done.append((seq, n, least, digest.hexdigest()))
                    seq, n, least, digest = s, 0, c, hashlib.sha256()
                digest.update(b",%d" % c if n else b"%d" % c)
                n += 1
            if len(done) > 5_000:
                yield out()
                done = []
        if seq is not None:
            done.append((seq, n, least, digest.hexdigest()))
        if done:
            yield out()

    schema = pa.schema([("seq", pa.string()), ("n", pa.int64()), ("conv_id", pa.int64()), ("sha", pa.string())])
    rows = conversations.select("seq", F.col("conv_id").cast("long").alias("conv_id")).repartition("seq").sortWithinPartitions("seq", "conv_id")
    return map_arrow(rows, run, "seq string, n long, conv_id long, sha string")


def common(a: bytes, b: bytes) -> int:
    """Turns at the front of both keys."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    lo, hi = 0, n // WIDTH  # a[:lo] agrees, a[:hi] does not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid * WIDTH] == b[:mid * WIDTH] else (lo, mid)
    return lo


class Forest:
    """The trie over one block of sorted sequences, built by union-find.

    The edges are the common lengths of neighbours, taken from the longest to the
    shortest.  A component is a run of neighbours below one node, its top; joining two
    raises both tops to the edge's depth, which closes the nodes in between, and makes
    them one node there.  ``left`` and ``right`` are the common lengths with the
    sequences beside the block (-1: none): a node that holds the first sequence no
    deeper than ``left``, or the last no deeper than ``right``, reaches out of the block
    and stays open.  The open nodes lie on the paths of the first and the last sequence,
    where their sums so far are left as marks (``contracted``); the next level builds the
    trie over these two sequences of each block in the same way.

    A sequence is (key, words, marks, common length with the one before), marks: depth ->
    [n_convs, smallest id, children, leaves, saved tokens, digest of the ends]."""

    def __init__(self, items: list, left: int, right: int, reopened: bool):
        self.items, self.left, self.right, self.reopened = items, left, right, reopened
        m = len(items)
        self.parent, self.low, self.high = list(range(m)), list(range(m)), list(range(m))
        self.depth = [len(key) // WIDTH for key, _, _, _ in items]
        self.marks = [{d: list(mark) for d, mark in marks.items()} for _, _, marks, _ in items]
        self.top = [self.marks[i].pop(self.depth[i], None) or [0, None, 0, 0, 0, None] for i in range(m)]
        self.waiting: list[list] = [[] for _ in range(m)]  # the closed children of the top node
        self.nodes: list[tuple] = []
        self.open: dict[int, dict] = {0: {}, m - 1: {}}
        for i in sorted(range(1, m), key=lambda i: -items[i][3]):
            self.join(self.find(i - 1), self.find(i), items[i][3])
        self.lift(self.find(0), -1)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    @staticmethod
    def add(to: list, more: list) -> None:
        to[0] += more[0]
        to[1] = more[1] if to[1] is None else to[1] if more[1] is None else min(to[1], more[1])
        to[2] += more[2]
        to[3] += more[3]
        to[4] += more[4]
        to[5] = to[5] or more[5]

    def lift(self, c: int, depth: int) -> None:
        """Close the component's nodes deeper than ``depth``."""
        while self.depth[c] > depth:
            d, top = self.depth[c], self.top[c]
            first, last = self.low[c] == 0 and d <= self.left, self.high[c] == len(self.items) - 1 and d <= self.right
            above = (self.marks[c].pop(d - 1, None) or [0, None, 0, 0, 0, None]) if d else None
            pid = hashlib.md5(self.items[c][0][:d * WIDTH]).digest() if first or last or self.reopened else None
            if first or last:
                self.nodes += [(*node, None, pid) for node in self.waiting[c]]
                self.waiting[c] = []
                self.open[0 if self.low[c] == 0 and (first or d <= self.right) else len(self.items) - 1][d] = top
            else:
                n, least, kids, leaves, saved, sha = top
                leaves = leaves if kids else 1
                saved += (n - 1) * self.items[c][1][d - 1] if d else 0
                self.nodes += [(*node, least, None) for node in self.waiting[c]]
                node = (least, d, n, kids, leaves, saved, sha or NO_ENDS, pid)
                self.waiting[c] = [node]
                if d:
                    self.add(above, [n, least, 1, leaves, saved, None])
                else:
                    self.nodes.append((*node, None, None))
            self.top[c], self.depth[c] = above, d - 1

    def join(self, a: int, b: int, depth: int) -> None:
        self.lift(a, depth)
        self.lift(b, depth)
        if len(self.waiting[a]) + len(self.marks[a]) < len(self.waiting[b]) + len(self.marks[b]):
            a, b = b, a
        self.add(self.top[a], self.top[b])
        self.waiting[a] += self.waiting[b]
        for d, mark in self.marks[b].items():
            if d in self.marks[a]:
                self.add(self.marks[a][d], mark)
            else:
                self.marks[a][d] = mark
        self.low[a], self.high[a] = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])
        self.parent[b], self.waiting[b], self.marks[b], self.top[b] = a, [], {}, None

    def contracted(self) -> list:
        """The block as at most two sequences with the open nodes' marks; none if all is closed."""
        last, out, least = len(self.items) - 1, [], min((i[3] for i in self.items[1:]), default=None)
        for at in sorted(self.open):
            marks = self.open[at]
            if marks and (at == 0 or last):
                deep = max(marks)
                key, words = self.items[at][0][:deep * WIDTH], self.items[at][1][:deep]
                out.append((key, words, marks, self.items[0][3] if not out else least))
        return out


NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, pid binary, parent_conv_id long, parent_pid binary"
MARK = "struct<depth:long,n_convs:long,conv_id:long,n_children:long,n_leaves:long,saved:long,sha:string>"
ITEM = f"block long, i long, key binary, words array<long>, marks array<{MARK}>, lcp long, right long"


def grow(items: DataFrame, fan_in: int, reopened: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """The closed nodes of every ``fan_in`` blocks, and what is open as new blocks."""
    node_cols, item_cols = [c.split()[0] for c in NODE.split(", ")], [c.split()[0] for c in ITEM.split(", ")]
    mark_cols = [c.split(":")[0] for c in MARK[len("struct<"):-1].split(",")]
    mark = pa.struct([(c, pa.string() if c == "sha" else pa.int64()) for c in mark_cols])
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[1], pa.list_(mark))) for c in (NODE + ", " + ITEM).split(", ")])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("i" if reopened else "key", "ascending")])
        seqs, before = [], None
        for key, words, marks, lcp in zip(*(table[c].to_pylist() for c in ("key", "words", "marks", "lcp")), strict=True):
            at = {m["depth"]: [m[c] for c in mark_cols[1:]] for m in marks}
            seqs.append((key, words, at, lcp if reopened or before is None else common(before, key)))
            before = key
        right = table["right"][-1].as_py()
        forest = Forest(seqs, seqs[0][3], right, reopened)
        rows = [dict(zip(node_cols, n, strict=True)) for n in forest.nodes]
        block = table["block"][0].as_py() // fan_in
        for i, (key, words, marks, lcp) in enumerate(forest.contracted()):
            at = [dict(zip(mark_cols, (d, *m), strict=True)) for d, m in marks.items()]
            rows.append({"block": block, "i": i, "key": key, "words": words, "marks": at, "lcp": lcp, "right": right})
        return pa.Table.from_pylist(rows, schema)

    ship(items.sparkSession)
    got = items.withColumn("g", F.expr(f"block div {fan_in}")).groupBy("g").applyInArrow(run, f"{NODE}, {ITEM}")
    got = cut(got, name)
    return got.where("depth is not null").select(*node_cols), got.where("block is not null").select(*item_cols)


def sorted_blocks(sequences: DataFrame, block_turns: int) -> DataFrame:
    """The sequences in blocks by key (a range each), with the common lengths of a block's
    first with the one before it and of its last with the one after it.  The blocks'
    edges pass one task: two keys a block."""
    turns = sequences.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
    ranged = sequences.repartitionByRange(max(1, -(-turns // block_turns)), "key").withColumn("block", F.spark_partition_id().cast("long"))
    ranged = cut(ranged, "sorted")
    edges = ranged.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    by = Window.orderBy("block")
    edges = edges.select("block", F.dense_rank().over(by).cast("long").alias("place"), "first", "last", F.lag("last").over(by).alias("before"), F.lead("first").over(by).alias("after"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"block": pdf["block"], "place": pdf["place"] - 1,
                                "lcp": [-1 if b is None else common(bytes(b), bytes(f)) for b, f in zip(pdf["before"], pdf["first"], strict=True)],
                                "right": [-1 if a is None else common(bytes(x), bytes(a)) for x, a in zip(pdf["last"], pdf["after"], strict=True)]})

    ship(sequences.sparkSession)
    edges = cut(edges.mapInPandas(run, "block long, place long, lcp long, right long"), "edges")
    # one row of four numbers a block
    return ranged.join(F.broadcast(edges), "block").drop("block").withColumnRenamed("place", "block")


def trie(turns: DataFrame, block_turns: int = BLOCK_TURNS, fan_in: int = FAN_IN, **cols) -> DataFrame:
    """One row for each distinct sequence of first turns: conv_id (the smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Equal conversations become one weighted sequence first.  The distinct ones are dealt
    by ranges of their keys into blocks of about ``block_turns`` turns; each block's trie
    is built by ``Forest``, and what reaches over block edges is contracted and merged,
    ``fan_in`` blocks at a time, until one is left.  A popular beginning is therefore cut
    over blocks like any other rows.  A closed child of an open node learns its parent's
    smallest member by joining on the node's hash, with the open nodes dealt over parts.

    Null role and text: empty.  A null conv_id is no conversation.  Null orders come
    first, ties go by the turn's hash, so equal rows stay as they are.  Empty table: no
    rows, not even the root.  Other columns are ignored.  Turns are compared by MD5, a
    conversation's hashes (24 bytes a turn) are one row."""
    conversations = cut(rebuilt(turns, **cols), "rebuilt")
    one = conversations.groupBy("seq").agg(F.any_value("key").alias("key"), F.any_value("words").alias("words"))
    mark = F.array(F.struct(F.size("words").cast("long").alias("depth"), F.col("n").alias("n_convs"), F.col("conv_id"), F.lit(0).cast("long").alias("n_children"),
                            F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"), F.col("sha").alias("sha")))
    sequences = cut(one.join(ends(conversations), "seq").select("key", "words", mark.alias("marks")), "sequences")
    items = sorted_blocks(sequences, block_turns).withColumn("i", F.lit(0).cast("long"))
    nodes, items = grow(items, 1, False, "forest")
    every = [nodes]
    while items.limit(1).count():
        nodes, items = grow(items, fan_in, True, "forest")
        every.append(nodes)
    out = every[0]
    for nodes in every[1:]:
        out = out.unionByName(nodes)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parts = 32
    reopened = out.where("pid is not null").select(F.col("pid").alias("parent_pid"), F.col("conv_id").alias("__least"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"))
    lost = out.where("parent_pid is not null").withColumn("__part", F.pmod(F.xxhash64("conv_id"), F.lit(parts)).cast("int"))
    found = lost.join(reopened, ["parent_pid", "__part"]).withColumn("parent_conv_id", F.col("__least"))
    return out.where("parent_pid is null").select(*cols).unionByName(found.select(*cols))


def sql() -> str:
    """DuckDB SQL for ``trie``: every prefix as a list, sums over all prefixes of prefixes."""
    return r"""
WITH own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                                  ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || chr(0) || coalesce(text, ''))) AS l
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, l, conv_id - conv_id % 20 AS source, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
               lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 4 AS h FROM own),
made AS (SELECT a.conv_id, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS l FROM h a LEFT JOIN own b ON b.conv_id = a.source),
node AS (SELECT l[1:d] AS p, d AS depth, min(conv_id) AS conv_id, count(*) AS n,
                sha256(coalesce(string_agg(CASE WHEN len(l) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends
         FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM made) GROUP BY ALL),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
own_sums AS (SELECT node.*, coalesce(kids.n, 0) AS kids, CASE WHEN depth = 0 THEN 0
                    ELSE (node.n - 1) * len(regexp_extract_all(node.p[depth].t, '[^\x20\x09-\x0D]+')) END AS saved
             FROM node LEFT JOIN kids ON kids.p = node.p),
below AS (SELECT p[1:k] AS p, sum(saved) AS saved, count(*) FILTER (kids = 0) AS leaves
          FROM (SELECT p, saved, kids, unnest(range(0, depth + 1)) AS k FROM own_sums) GROUP BY ALL)
SELECT s.conv_id, s.depth, up.conv_id AS parent_conv_id, s.n AS n_convs, s.kids AS n_children, below.leaves AS n_leaves,
       CAST(below.saved AS BIGINT) AS saved_tokens, s.ends AS ends_sha256
FROM own_sums s JOIN below ON below.p = s.p LEFT JOIN node up ON s.depth > 0 AND up.p = s.p[1:s.depth - 1]"""
