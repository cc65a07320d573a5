"""Token counts by section: whole documents encoded once, spans joined to sections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow
from .tokens import encoder, vocabulary
from .words import buffers

RULES = ("start", "majority", "split")


def line_edges(data: np.ndarray) -> np.ndarray:
    """Where lines begin (each keeps its newline), and the end."""
    at = np.flatnonzero(data == 10) + 1
    return np.unique(np.concatenate([[0], at, [len(data)]]))


def allocate(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section [edges[i], edges[i+1]) and how many of them cross an edge.

    The token spans tile the text, so the join is a merge of two sorted lists.  A token
    inside one section is its own.  One that crosses an edge goes, by ``rule``, to the
    section of its first byte ("start"), to the one with most of its bytes, the earlier
    of equals ("majority"), or to each by its share of the bytes ("split")."""
    n = len(edges) - 1
    first = np.searchsorted(edges, starts, side="right") - 1
    last = np.searchsorted(edges, ends - 1, side="right") - 1
    inside = first == last
    got = np.bincount(first[inside], minlength=n).astype(float)
    crossing = np.zeros(n)
    for t in np.flatnonzero(~inside):
        parts = np.arange(first[t], last[t] + 1)
        share = np.minimum(ends[t], edges[parts + 1]) - np.maximum(starts[t], edges[parts])
        crossing[parts] += 1
        if rule == "start":
            got[parts[0]] += 1
        elif rule == "majority":
            got[parts[np.argmax(share)]] += 1
        else:
            got[parts] += share / share.sum()
    return got, crossing


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fields: list[str] | None = None, rule: str = "majority",
          tokenizer: str | None = None) -> DataFrame:
    """One row per section of each text: doc_id, section (from 0), field, start and length
    in code points, n_tokens, n_crossing (tokens that also touch another section).

    ``fields``: the text is these columns one after another with a newline after each
    but the last, and every field is a section (null: empty).  Without it the sections
    are the lines of ``text_col``, each with its newline.  The text is encoded once as
    a whole, so a token may cross an edge; ``rule`` (see ``allocate``) says whose it
    is.  The counts of a document sum to its tokens.

    Null and empty texts have one empty section without tokens; an empty table has no
    rows; null or repeated ids and other columns do not matter.  A row is encoded in
    one task; memory follows the longest text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = fields or [text_col]
    path = tokenizer or vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"f{i}") for i, c in enumerate(names)])
    if fields:
        picked = picked.select("doc_id", F.array_join(F.array(*[f"f{i}" for i in range(len(names))]), "\n").alias("text"),
                               F.array(*[F.octet_length(f"f{i}").cast("long") for i in range(len(names))]).alias("sizes"))
    else:
        picked = picked.select("doc_id", F.col("f0").alias("text"), F.lit(None).cast("array<bigint>").alias("sizes"))

    def run(batches):
        enc = encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                data, at = buffers(part.column(1))
                sizes = part.column(2).to_pylist()
                out = [[] for _ in range(7)]
                for i, ids in enumerate(enc.encode(part.column(1))):
                    raw = data[at[i]:at[i + 1]]
                    ends = np.cumsum(enc.width[ids])
                    if sizes[i] is None:
                        edges = line_edges(raw)
                    else:
                        own = np.cumsum(np.array(sizes[i]) + 1)
                        edges = np.concatenate([[0], own[:-1], [len(raw)]])
                    if len(edges) < 2:
                        edges = np.array([0, 0])
                    keep = np.diff(edges) > 0
                    got, crossing = np.zeros(len(edges) - 1), np.zeros(len(edges) - 1)
                    if keep.any():  # empty fields take no part in the join
                        solid = np.append(edges[:-1][keep], edges[-1])
                        got[keep], crossing[keep] = allocate(ends - enc.width[ids], ends, solid, rule)
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[edges]
                    n = len(got)
                    for to, v in zip(out, (np.full(n, i), np.arange(n), chars[:-1], np.diff(chars), got, crossing), strict=False):
                        to.append(v)
                cols = [np.concatenate(v) for v in out[:6]]
                field = [names[s] if fields else None for s in cols[1].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), pa.array(field, pa.string()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64()), pa.array(cols[5].astype(np.int64))],
                    ["doc_id", "section", "field", "start", "length", "n_tokens", "n_crossing"])

    return map_arrow(picked, run, f"doc_id {kind}, section long, field string, start long, length long, n_tokens double, n_crossing long")
