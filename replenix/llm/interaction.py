"""How filters interact: for every order of applying them, what each step keeps and removes."""

from __future__ import annotations

import uuid
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

WORDS = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: letter -> SQL condition over t (the text) and words (its words) under which a document fails
FILTERS = {
    "A": "size(words) < 200",
    "B": "100 * size(array_distinct(words)) < 50 * size(words)",
    "C": f"100 * (char_length(t) - char_length(translate(t, '{UPPER}', ''))) > 3 * char_length(t)",
    "D": "t rlike '[#$%&*|]'",
}
#: the filter that compares a document with the others, last
COPY = "E"


def marks(docs: DataFrame, part: str = "lang", filters: dict[str, str] = FILTERS) -> DataFrame:
    """doc_id, part, digest (SHA-256 of the whole text), mask (bit i: fails the i-th
    filter that looks at one text), n (equal rows).  No text goes further."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("t")) \
               .withColumn("words", F.regexp_extract_all("t", F.lit(WORDS), F.lit(0)))
    mask = F.lit(0)
    for i, condition in enumerate(filters.values()):
        mask = mask + F.when(F.expr(condition), 1 << i).otherwise(0)
    return rows.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask")) \
               .groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, str] = FILTERS) -> DataFrame:
    """part, mask (over all filters, the copy filter's bit on top), n, good, toxic: how many
    documents of a part fail exactly these filters, and how many of them are labelled
    good and toxic.

    Equal rows are counted together before any join, copies of a text before its
    smallest id is sought, so neither is gathered.  Labels of one id are merged (the
    larger).  A null id has no label, is no copy and makes none."""
    own = cut(marks(docs, part, filters), "marks")
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    judged = own.where("doc_id is not null").join(one, "doc_id", "left").withColumns({
        "good": F.when(F.col("quality") == 1, F.col("n")).otherwise(0), "bad": F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)})
    # a text within a part: all its rows, and those of its smallest id
    texts = judged.groupBy("digest", "part", "mask").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min(F.struct("doc_id", "n", "good", "bad")).alias("first"))
    least = cut(texts, "texts")
    least = least.join(least.groupBy("digest").agg(F.min("first.doc_id").alias("least")), "digest")
    bit, is_first = 1 << len(filters), F.col("first.doc_id") == F.col("least")
    split = F.array(
        F.struct(F.col("mask").alias("mask"), *[F.when(is_first, F.col(f"first.{c}")).otherwise(0).alias(c) for c in ("n", "good", "bad")]),
        F.struct((F.col("mask") + bit).alias("mask"), *[(F.col(c) - F.when(is_first, F.col(f"first.{c}")).otherwise(0)).alias(c) for c in ("n", "good", "bad")]))
    rows = least.select("part", F.inline(split)).unionByName(
        own.where("doc_id is null").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad")))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("toxic")).where("n > 0")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, str] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A recursive query extends prefixes of the orders by each filter not yet used.  Its
    rows carry the bits applied so far and meet the cells of their part (at most two to
    the number of filters, in an array); each level emits the step's numbers.  A prefix
    is counted once, however many orders begin with it; a complete order reads its
    steps from its prefixes.

    Null part: the empty string.  Null text: empty, no words, so it fails ``A`` (and is a
    copy of other empty ones).  Null and repeated ids: see ``cells``; rows of one id with
    one text are no copies of each other.  No documents: no rows.  Other columns, also
    ones called like the result's, are ignored."""
    spark = docs.sparkSession
    letters = "".join(filters) + COPY
    steps = len(letters)
    by_part = cut(cells(docs, labels, part, filters).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "cells")
    view = f"cells_{uuid.uuid4().hex}"
    by_part.createOrReplaceTempView(view)

    def over(condition: str, what: str = "n") -> str:
        return f"aggregate(filter(c.cells, x -> {condition}), 0L, (a, x) -> a + x.{what})"

    # the bit is taken here, as the query knows it under its letter's place
    bit = "shiftleft(1, l.at)"
    fails, before = f"x.mask & {bit} != 0", "x.mask & w.applied"
    out = f"{fails} and {before} = 0"
    key = "spark.sql.cteRecursionRowLimit"
    limit = spark.conf.get(key)
    try:
        # its rows are the parts by all prefixes, however many parts there are
        spark.conf.set(key, "-1")
        walked = cut(spark.sql(f"""
            WITH RECURSIVE walk(part, prefix, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
              SELECT part, '', 0, 0, aggregate(cells, 0L, (a, x) -> a + x.n), 0L, 0L, 0L, 0L, 0L FROM {view}
              UNION ALL
              SELECT w.part, concat(w.prefix, l.letter), w.applied | {bit}, w.step + 1,
                     {over(f"x.mask & (w.applied | {bit}) = 0")}, {over(out)}, {over(f"{fails} and {before} != 0")},
                     {over(f"x.mask = {bit}")}, {over(out, "good")}, {over(out, "toxic")}
              FROM walk w JOIN {view} c ON w.part = c.part
                LATERAL VIEW posexplode(split('{letters}', '')) l AS at, letter
              WHERE w.step < {steps} AND w.applied & {bit} = 0)
            SELECT * FROM walk WHERE step > 0"""), "walk")
    finally:
        spark.conf.set(key, limit)
        spark.catalog.dropTempView(view)
    # a prefix of k letters begins (steps - k)! orders
    share = walked.select("part", F.right("prefix", F.lit(1)).alias("letter"),
                          (F.col("removed") * F.element_at(F.array(*[F.lit(factorial(steps - k)) for k in range(1, steps + 1)]), F.col("step"))).alias("r"))
    share = share.groupBy("part", "letter").agg(F.sum("r").alias("shapley"))
    orders = walked.where(F.col("step") == steps).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    rows = orders.withColumn("prefix", F.expr("left(filter_order, step)")).withColumn("letter", F.right("prefix", F.lit(1)))
    return rows.join(walked.drop("step"), ["part", "prefix"]).join(share, ["part", "letter"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def sql() -> str:
    """DuckDB SQL for ``audit`` with the default filters: orders by joining letters, each
    step summed over the masks of single documents."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
least AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT d.part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
             100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 3 * length(d.t) AS c, regexp_matches(d.t, '[#$%&*|]') AS dd,
             coalesce(d.doc_id > least.least, FALSE) AS e, coalesce(l.quality = 1, FALSE) AS good, coalesce(l.toxic = 1, FALSE) AS toxic
      FROM d JOIN least ON least.t = d.t LEFT JOIN l ON l.doc_id = d.doc_id),
f AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
                   || (CASE WHEN dd THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
             count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x(y) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.y || q.y || r.y || s.y || u.y AS filter_order FROM x p JOIN x q ON q.y <> p.y JOIN x r ON r.y NOT IN (p.y, q.y)
      JOIN x s ON s.y NOT IN (p.y, q.y, r.y) JOIN x u ON u.y NOT IN (p.y, q.y, r.y, s.y)),
st AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS y, left(filter_order, k - 1) AS earlier FROM o, range(1, 6) g(k)),
r AS (SELECT f.part, filter_order, step, y,
             sum(CASE WHEN len(list_intersect(string_split(fails, ''), string_split(earlier || y, ''))) = 0 OR fails = '' THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN contains(fails, y) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN contains(fails, y) AND translate(fails, earlier, '') <> fails THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails = y THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN contains(fails, y) AND translate(fails, earlier, '') = fails THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN contains(fails, y) AND translate(fails, earlier, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
      FROM f, st GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, y) AS BIGINT) AS shapley
FROM r"""
