"""Cost-balanced packing of tokenised documents into sequences."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow
from .tokens import encoder, vocabulary

SCHEMA = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, sequence_length long, cost double{ids}")


def sequence_sizes(tokens: int, size: int) -> list[int]:
    """Full sequences, then powers of two for what is left: no padding at all."""
    rest = tokens % size
    return [size] * (tokens // size) + [1 << b for b in range(size.bit_length(), -1, -1) if rest >> b & 1]


def assign(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> tuple[list[tuple], list[int], np.ndarray]:
    """Pieces (document, start, length, sequence, offset), the sequences' lengths and costs.

    What fills whole sequences is cut off first.  The rests go, by descending cost
    ``linear * n + quadratic * n * n``, to the sequence of lowest cost that has room;
    where none has, the one with most room takes what fits and the rest goes on.  The
    rooms sum to the tokens, so every sequence is full at the end."""
    pieces, sizes, costs = [], [], []
    price = lambda n: linear * n + quadratic * float(n) * n
    for d in np.flatnonzero(lengths >= size):
        for k in range(int(lengths[d]) // size):
            pieces.append((int(d), k * size, size, len(sizes), 0))
            sizes.append(size)
            costs.append(price(size))
    rest = lengths % size
    made = sequence_sizes(int(rest.sum()), size)
    base, room, cost = len(sizes), np.array(made, np.int64), np.zeros(len(made))
    used = np.zeros(len(made), np.int64)

    def put(d, start, n, s):
        pieces.append((d, start, n, base + s, int(used[s])))
        used[s] += n
        room[s] -= n
        cost[s] += price(n)

    order = np.argsort(-rest, kind="stable")
    heap = [(-int(rest[d]), i, int(d), int(lengths[d] - rest[d])) for i, d in enumerate(order) if rest[d] > 0]
    heapq.heapify(heap)  # by descending length, which is descending cost
    while heap:
        n, i, d, start = heapq.heappop(heap)
        n = -n
        fits = room >= n
        if fits.any():
            put(d, start, n, int(np.argmin(np.where(fits, cost, np.inf))))
            continue
        s = int(np.argmax(room))
        part = int(room[s])
        put(d, start, part, s)
        heapq.heappush(heap, (-(n - part), i, d, start + part))
    return pieces, sizes + made, np.concatenate([costs, cost])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = 2048,
         end_id: int = 1, block_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1.0 / 2048,
         keep_ids: bool = False) -> DataFrame:
    """Pack whole texts into sequences of at most ``size`` (a power of two) tokens.

    Each document is its ids and then ``end_id``.  Rows are taken as they come in a
    partition, in blocks of ``block_tokens`` tokens or one larger document; each block
    is packed by ``assign`` on its own, so there is no shuffle, memory is bounded by
    the block and the longest text, and a lost task repeats with the same result.
    One row per piece; every token lies in one piece.  Sequences are full or, at most
    once for each power of two in a block, a smaller power of two long: nothing is
    padded.  sequence_id holds the partition in its upper bits.

    Null text: empty, so ``end_id`` alone.  Null ids and repeated rows are documents
    like others.  An empty table gives no rows; other columns are ignored."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    path = tokenizer or vocabulary()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    arrow = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                       ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()), ("cost", pa.float64())])

    def run(batches):
        enc, closing = encoder(path), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        ids, held, total = [], [], 0

        def flush():
            nonlocal number, ids, held, total
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            pieces, sizes, costs = assign(lengths, size, linear, quadratic)
            doc = np.array([p[0] for p in pieces])
            cut = [held[d][4 * s:4 * (s + n)] for d, s, n, _, _ in pieces]
            seq = np.array([p[3] for p in pieces])
            cols = [[p[1] for p in pieces], [p[2] for p in pieces], [zlib.crc32(c) for c in cut], lengths[doc],
                    seq + number, [p[4] for p in pieces], np.array(sizes)[seq], costs[seq]]
            arrays = [pa.concat_arrays(ids).take(pa.array(doc))] + [pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)]
            names = ["doc_id", *arrow.names]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in cut], pa.list_(pa.int32())))
                names.append("ids")
            number += len(sizes)
            ids, held, total = [], [], 0
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                for i, got in enumerate(enc.encode(part.column(1))):
                    ids.append(part.column(0).slice(i, 1))
                    held.append(got.tobytes() + closing)
                    total += len(held[-1]) // 4
                    if total >= block_tokens:
                        yield flush()
        if held:
            yield flush()

    return map_arrow(picked, run, SCHEMA.format(id=kind, ids=", ids array<int>" if keep_ids else ""))
