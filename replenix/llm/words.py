"""Vectorised word work on Arrow text columns.

A word is a run of bytes outside 0x20 and 0x09-0x0D; as no byte of a multi-byte
UTF-8 character lies there, this equals the pattern ``[^\\x20\\x09-\\x0D]+``.  All
functions take slices of bounded size (one text larger than the bound is a slice
of its own), so memory follows the longest text, about 60 bytes for each of its
bytes, and not the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256)
_FOLD[ord("A"):ord("Z") + 1] += 32
_RAW = mix(np.arange(1, 257, dtype=np.uint64))
_LOW = _RAW[_FOLD]
_BASE = 0x9E3779B97F4A7C15
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: multipliers of the words of a shingle
_STEP = mix(np.arange(1001, 1033, dtype=np.uint64)) | _U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = max(n, 2 * SLICE_BYTES)
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _POW[i] = np.cumprod(x)
    return _POW[0], _POW[1]


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each row starts (one more at the end)."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, off, data = arr.buffers()
    at = np.frombuffer(off, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(arr: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row starts) of consecutive rows of at most ``most``
    bytes together, or of one larger row."""
    data, at = buffers(arr)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j, data[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def split(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends (bytes), and the index of each row's first word."""
    gap = space[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    begins = ~gap
    ends = begins.copy()
    if len(data):
        begins[1:] &= gap[:-1] | first[1:-1]
        ends[:-1] &= gap[1:] | first[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: list[np.ndarray], fold: bool = False) -> list[np.ndarray]:
    """64-bit hashes of the spans of bytes from ``starts`` to each of several ``stops``;
    ``fold`` lower-cases A-Z."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOW if fold else _RAW)[data] * up[:len(data)], out=total[1:])
    return [mix((total[e] - total[starts]) * down[starts] + (e - starts).astype(np.uint64)) for e in stops]


def span_hash(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, fold: bool = False) -> np.ndarray:
    return span_hashes(data, starts, [stops], fold)[0]


def shingles(h: np.ndarray, lo: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, and the index of each row's first.
    ``short``: a row with fewer words has one, of its whole sequence; a row without
    words has none."""
    n = np.diff(lo)
    m = np.maximum(n - k + 1, 0)
    whole = len(h) - k + 1
    run = np.zeros(max(whole, 0), np.uint64)
    for j in range(k):
        if whole > 0:
            run += h[j:j + whole] * _STEP[j]
    run = mix(run)
    if short:
        few = np.flatnonzero((n > 0) & (n < k))
        m[few] = 1
    first = np.concatenate([[0], np.cumsum(m)])
    index = np.repeat(lo[:-1] - first[:-1], m) + np.arange(first[-1])
    if not short or not len(few):
        return run[index], first
    out = np.zeros(first[-1], np.uint64)
    ok = np.repeat(n >= k, m)
    out[ok] = run[index[ok]]
    for i in few:
        w = h[lo[i]:lo[i + 1]]
        out[first[i]] = mix((w * _STEP[:len(w)]).sum(dtype=np.uint64, keepdims=True) + _U(len(w)))[0]
    return out, first


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive row starts (empty rows: 0)."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def repeated(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more in its row, the first included."""
    rows = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    keys = keys ^ mix(rows + _U(7))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def distinct(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of different keys of each row."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    mixed = keys ^ mix(rows.astype(np.uint64) + _U(7))
    order = np.argsort(mixed)
    new = np.ones(len(keys), bool)
    new[1:] = mixed[order][1:] != mixed[order][:-1]
    return np.bincount(rows[order[new]], minlength=len(first) - 1)


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_KIND = np.zeros(256, np.int8)  # 1 upper, 2 lower, 3 digit, 4 other ASCII printing, 5 first byte of a longer character
_KIND[ord("A"):ord("Z") + 1], _KIND[ord("a"):ord("z") + 1], _KIND[ord("0"):ord("9") + 1] = 1, 2, 3
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 4
_KIND[0xC0:] = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique",
         "n_upper", "n_lower", "n_digit", "n_punct", "n_wide", "longest", "n_spaces", "n_short")


def text_stats(data: np.ndarray, at: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """Counts of each text of a slice; see STATS."""
    starts, stops, lo = split(data, at)
    h = span_hash(data, starts, stops)
    win, first = shingles(h, lo, window, short=False)
    twice = np.flatnonzero(repeated(win, first))
    rows = np.searchsorted(first, twice, side="right") - 1
    begin = lo[rows] + twice - first[rows]
    cover = np.zeros(len(h) + 1, np.int64)
    cover[begin] += 1
    cover[begin + window] -= 1
    covered = np.cumsum(cover)[:-1] > 0
    # lines: pieces between \n within a row
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    newline = np.flatnonzero(data == 10)
    line_starts = np.union1d(np.flatnonzero(edge[:-1]), newline + 1)
    line_starts = line_starts[line_starts < len(data)]
    nxt = np.append(line_starts[1:], len(data))
    ended = np.zeros(len(data) + 1, bool)
    ended[newline + 1] = True
    line_stops = nxt - (ended[nxt] & (nxt > line_starts))
    has = np.searchsorted(starts, line_stops) > np.searchsorted(starts, line_starts)
    line_starts, line_stops = line_starts[has], line_stops[has]
    line_first = np.searchsorted(line_starts, at)
    lines = np.diff(line_first)
    length = (stops - starts)
    lead = (data & 0xC0) != 0x80  # one for each code point
    gap = SPACE[data]
    kind = _KIND[data]
    longest = np.zeros(len(at) - 1, np.int64)
    some = np.flatnonzero(np.diff(lo) > 0)
    if len(some):
        longest[some] = np.maximum.reduceat(length, lo[some])
    count = lambda mask: per_row(mask, at)
    return {
        "n_words": np.diff(lo), "word_chars": count(lead & ~gap), "n_symbols": count(_SYMBOL[data]),
        "n_dup_lines": lines - distinct(span_hash(data, line_starts, line_stops), line_first),
        "n_repeat_words": per_row(covered, lo), "n_lines": lines, "n_unique": distinct(h, lo),
        "n_upper": count(kind == 1), "n_lower": count(kind == 2), "n_digit": count(kind == 3),
        "n_punct": count(kind == 4), "n_wide": count(kind == 5), "longest": longest, "n_spaces": count(gap),
        "n_short": per_row(length <= 3, lo),
    }


def stats_of(arr: pa.Array) -> dict[str, np.ndarray]:
    """``text_stats`` of a whole Arrow column."""
    parts = [text_stats(data, at) for _, _, data, at in slices(arr)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in STATS}


def with_stats(docs, keep: dict[str, str], text: str = "text"):
    """The columns ``keep`` ({name: expression}) of each row and the STATS of its text."""
    from pyspark.sql import functions as F

    from .shared import map_arrow

    picked = docs.select(*[F.expr(e).alias(k) for k, e in keep.items()], F.col(text).cast("string").alias("__text"))
    names = list(keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]] + [f"{s} long" for s in STATS])

    def run(batches):
        for b in batches:
            got = stats_of(b.column(len(names)))
            cols = [b.column(i) for i in range(len(names))] + [pa.array(got[s].astype(np.int64)) for s in STATS]
            yield pa.RecordBatch.from_arrays(cols, names + list(STATS))

    return map_arrow(picked, run, schema)
