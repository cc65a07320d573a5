"""Quality rules with risk-controlled thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, ship
from .words import with_stats

#: rule -> (statistic, +1: large is bad, -1: small is bad, cutoffs from lenient to strict)
RULES = {
    "symbols": ("100.0 * n_symbols / n_words", 1, tuple(float(c) for c in (300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 25, 20, 15, 10, 5))),
    "dup_lines": ("100.0 * n_dup_lines / n_words", 1, tuple(float(c) for c in (20, 16, 12, 10, 9, 8, 7, 6, 5, 4, 3, 2.5, 2, 1.5, 1, 0.5))),
    "repeats": ("100.0 * n_repeat_words / n_words", 1, tuple(float(c) for c in (20, 19, 18, 17, 16, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5))),
    "long_words": ("1.0 * word_chars / n_words", 1, tuple(float(c) for c in (40, 30, 25, 20, 18, 16, 15, 14, 13, 12, 11.5, 11, 10.5, 10, 9.5, 9))),
}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial; it is at most delta just where the exact (Clopper-Pearson)
    upper bound of the rate at level delta is at most p.

    Below the mean the terms fall from k downwards, each by its ratio to the one above;
    they are added until the rest no longer counts, some standard deviations down, so
    the time grows with the root of n and not with k."""
    if n <= 0 or k >= n * p:
        return 1.0
    k = int(k)
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term, i = 0.0, 1.0, k
    while i >= 0 and term > 1e-18 * total:
        at = np.arange(i, max(i - 4096, -1), -1, dtype=float)
        below = term * np.cumprod(at * (1 - p) / ((n - at + 1) * p))
        total += term + below[:-1].sum()
        term, i = float(below[-1]), i - len(at)
    return min(1.0, math.exp(first + math.log(total)))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact upper confidence bound of a rate after k of n."""
    if n <= 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_tail(k, n, mid) > delta else (lo, mid)
    return hi


def base_failed() -> F.Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "stratum", risk: float = 0.05, confidence: float = 0.95,
            label: str = "quality") -> DataFrame:
    """One row for each stratum with labelled good documents: stratum, n_good, and for
    each rule its cutoff (null: the rule is off), the good rows it rejects and the exact
    upper bound of their rate.

    The holdout is every labelled document that passes the base rules; the grid of
    cutoffs is fixed beforehand.  Each rule may falsely reject ``risk`` / rules of a
    stratum's good documents, so all rules together at most ``risk``.  Within a rule the
    cutoffs are tested from lenient to strict, up to the first whose bound is too high
    (fixed-sequence testing needs no further correction); over rules and strata the
    level (1 - ``confidence``) is divided by their number (Bonferroni).  A stratum with
    too few rows to prove a cutoff has none.  Counts are sums, combined before the
    shuffle, so a hot stratum is no matter; the result has one row a stratum."""
    one = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(label).alias("__good"))
    seen = stats.where(~base_failed()).join(one, "doc_id").where("__good = 1")
    sums = [F.sum(F.when(F.expr(f"{stat} {'>' if sign > 0 else '<'} {c}"), 1).otherwise(0)).alias(f"{name}_{i}")
            for name, (stat, sign, grid) in RULES.items() for i, c in enumerate(grid)]
    counts = seen.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n_good"), *sums)
    counts = cut(counts, "rules")
    strata = counts.count()
    level, each = (1 - confidence) / (len(RULES) * max(strata, 1)), risk / len(RULES)
    ship(stats.sparkSession)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["stratum", "n_good"]].copy()
            for name, (_, _, grid) in RULES.items():
                best = []
                for _, row in pdf.iterrows():
                    got = (None, None, None)
                    for i, c in enumerate(grid):
                        k = int(row[f"{name}_{i}"])
                        if binomial_tail(k, int(row["n_good"]), each) > level:
                            break
                        got = (c, k, upper_bound(k, int(row["n_good"]), level))
                    best.append(got)
                for j, part in enumerate(("cutoff", "rejects", "bound")):
                    out[f"{name}_{part}"] = pd.Series([b[j] for b in best], index=out.index, dtype="float64")
            yield out

    fields = ", ".join(f"{n}_cutoff double, {n}_rejects double, {n}_bound double" for n in RULES)
    return cut(counts.mapInPandas(choose, f"stratum {stats.schema[stratum].dataType.simpleString()}, n_good long, {fields}"), "cutoffs")


def apply(docs: DataFrame, labels: DataFrame, stratum: str | F.Column = "lang", text: str = "text", **how) -> DataFrame:
    """doc_id, stratum, the statistics of each whole text, base_failed, each rule's
    cutoff and kept.

    Base rules: fewer than 10 words, or more than 20 % of the words in five-word windows
    found twice or more.  What passes is kept unless it lies beyond a proven cutoff of
    its stratum (``cutoffs``); in strata without one it is kept.  Null text: no words,
    so base_failed.  A null stratum is a stratum.  Rows with null or repeated ids are
    judged like others; labels of one id are merged (good if any says so).  Empty
    tables: no rows, or no cutoffs."""
    key = F.expr(f"`{stratum}`") if isinstance(stratum, str) else stratum
    stats = cut(with_stats(docs.select("doc_id", text, key.alias("__stratum")), {"doc_id": "doc_id", "stratum": "__stratum"}, text), "stats")
    chosen = cutoffs(stats, labels, **how).withColumnRenamed("stratum", "__k")
    bad = [F.coalesce(F.expr(f"n_words > 0 and {stat} {'>' if sign > 0 else '<'} {name}_cutoff"), F.lit(False)) for name, (stat, sign, _) in RULES.items()]
    fails = bad[0]
    for b in bad[1:]:
        fails = fails | b
    rows = stats.join(chosen, F.col("stratum").eqNullSafe(F.col("__k")), "left")
    return rows.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base_failed().alias("base_failed"), (~base_failed() & ~fails).alias("kept"), *[f"{n}_cutoff" for n in RULES])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql(risk: float = 0.05, confidence: float = 0.95) -> str:
    """DuckDB SQL for ``digest``."""
    each = risk / len(RULES)
    grid = ", ".join(f"('{n}', {i}, CAST({c} AS DOUBLE))" for n, (_, _, cs) in RULES.items() for i, c in enumerate(cs))
    stat = " UNION ALL ".join(f"SELECT doc_id, rid, lang, '{n}' AS rule, {s} AS v FROM st WHERE n_words > 0" for n, (s, _, _) in RULES.items())
    if any(sign < 0 for _, sign, _ in RULES.values()):
        raise NotImplementedError
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '{word}') AS ws FROM d)),
win AS (SELECT rid, i, w || chr(10) || lead(w, 1) OVER p || chr(10) || lead(w, 2) OVER p || chr(10) || lead(w, 3) OVER p || chr(10) || lead(w, 4) OVER p AS g
        FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 5) r(k) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '{word}') GROUP BY rid),
counts AS (SELECT rid, count(*) AS n, sum(length(w)) AS c FROM w GROUP BY rid),
st AS (SELECT d.rid, d.doc_id, d.lang, coalesce(counts.n, 0) AS n_words, CAST(coalesce(counts.c, 0) AS BIGINT) AS word_chars,
              length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
              coalesce(lines.n, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
       FROM d LEFT JOIN counts USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN cover USING (rid)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM st),
v AS ({stat}),
grid(rule, step, c) AS (VALUES {grid}),
good AS (SELECT b.rid, b.lang FROM base b JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON b.doc_id = l.doc_id
         WHERE l.q = 1 AND NOT b.base_failed),
k AS (SELECT good.lang, grid.rule, grid.step, grid.c, count(*) AS n, count(*) FILTER (v.v > grid.c) AS k
      FROM good JOIN v ON v.rid = good.rid JOIN grid ON grid.rule = v.rule GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {each!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
             + i * ln({each!r}) + (n - i) * ln(1 - {each!r})))) END AS tail, (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM good) AS strata FROM k),
f AS (SELECT *, bool_and(tail <= {1 - confidence!r} / ({len(RULES)} * strata)) OVER (PARTITION BY lang, rule ORDER BY step) AS ok FROM p),
chosen AS (SELECT lang, rule, min(c) AS c FROM f WHERE ok GROUP BY lang, rule),
beyond AS (SELECT DISTINCT v.rid FROM v JOIN chosen ON v.rule = chosen.rule AND v.lang IS NOT DISTINCT FROM chosen.lang WHERE v.v > chosen.c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rid IN (SELECT rid FROM beyond), FALSE) AS kept
FROM base"""
