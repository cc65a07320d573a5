"""Toxicity: a convolutional text classifier over hashed words, calibrated by language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nnet import GRID, Cnn, threshold_of, word_ids
from .shared import crc_of, map_arrow
from .words import slices


@dataclass
class Model:
    net: Cnn
    thresholds: dict  # language -> cutoff; others 0.5


def sample_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids, by hash; a repeated id has its largest label.
    The result is local, so its size is bounded."""
    one = (labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id")
           .agg(F.max(F.col(label).cast("int")).alias("y"))
           .orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), "doc_id").limit(most))
    kind = labels.schema["doc_id"].dataType.simpleString()
    return labels.sparkSession.createDataFrame([tuple(r) for r in one.collect()], f"doc_id {kind}, y int")


def fit(docs: DataFrame, labels: DataFrame, usable: F.Column | None = None, label: str = "toxic", most_rows: int = 6000,
        buckets: int = 1 << 16, epochs: int = 3) -> Model | None:
    """Train on at most ``most_rows`` labelled rows (bounded sample by hash of doc_id, of
    those for which ``usable`` over the labels holds), each text whole.

    The driver gets bucket numbers only, 12 bytes for each word of the sample.  Four rows of five train; all labelled documents
    but these set a cutoff for each language (``calibrate``).  None if no labelled row has a
    document.  Null ids and labels are left out; null texts train as empty ones."""
    chosen = sample_labels(labels.where(usable) if usable is not None else labels, label, most_rows)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = (docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang"))
            .join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "lang", "text"))

    def run(batches):
        for b in batches:
            for i, j, data, at in slices(b.column(3)):
                ids, lo = word_ids(data, at, buckets)
                got = [ids[s:e].tobytes() for s, e in zip(lo[:-1], lo[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), b.column(2).slice(i, j - i),
                                                  pa.array(got, pa.binary())], ["doc_id", "y", "lang", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = map_arrow(rows, run, f"doc_id {kind}, y int, lang string, ids binary").collect()
    if not got:
        return None
    got = sorted({(r["doc_id"], bytes(r["ids"])): (r["y"], r["lang"]) for r in got}.items(), key=lambda x: x[0])  # repeated rows train once
    words = [np.frombuffer(ids, np.int32).reshape(-1, 3) for (_, ids), _ in got]
    y = np.array([v[0] for _, v in got])
    check = np.arange(len(got)) % 5 == 4  # left out of training, for the cutoffs
    net = Cnn(buckets)
    train = np.flatnonzero(~check) if (~check).any() else np.arange(len(got))
    own = [words[i] for i in train]
    if y[train].min() != y[train].max():
        net.start_from_counts(own, y[train])
    net.train(own, y[train], epochs=epochs, rate=0.03)
    own_ids = labels.sparkSession.createDataFrame(sorted({(got[i][0][0],) for i in train}), f"doc_id {kind}")
    judged = labels.where(usable) if usable is not None else labels
    return Model(net, calibrate(docs, judged, net, label, own_ids))


def calibrate(docs: DataFrame, labels: DataFrame, net: Cnn, label: str, trained: DataFrame) -> dict:
    """A cutoff for each language from all labelled documents outside ``trained``, scored
    whole; the driver gets counts by language, score bin and label only."""
    judged = (labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
              .join(F.broadcast(trained), "doc_id", "left_anti"))
    scored = score(docs.where("doc_id is not null").withColumn("__of", F.xxhash64(F.col("text").cast("string"))), Model(net, {}), ["doc_id", "__of", *[c for c in docs.columns if c == "lang"]])
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    step = sum((F.col("score") >= F.lit(float(t))).cast("int") for t in GRID)
    one = scored.select("doc_id", "__of", lang.alias("name"), step.alias("bin")).distinct()  # repeated rows count once
    counts = {}
    for r in one.join(judged, "doc_id").groupBy("name", "bin", "y").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["name"], np.zeros((2, len(GRID) + 1), np.int64))[int(r["y"] == 1), r["bin"]] += r["n"]
    return {name: threshold_of(n) for name, n in counts.items()}


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None, score_col: str = "score", flag_col: str = "rejected") -> DataFrame:
    """The columns ``keep`` (all), the score of each whole text (0 to 1) and whether it
    reaches the cutoff of its language.

    The score sees the text alone; lang only picks the cutoff.  Null and empty texts
    score as no words.  Without a model the score is 0 and nothing is flagged.  Rows
    are independent: repeated ones score alike, an empty table gives no rows; columns
    that have the new names are replaced."""
    keep = [c for c in (keep or docs.columns) if c not in (score_col, flag_col)]
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"), lang.alias("__lang"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(score_col, "double").add(flag_col, "boolean")
    if model is None:
        return rows.withColumn(score_col, F.lit(0.0)).withColumn(flag_col, F.lit(False)).drop("__text", "__lang")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets x dimensions

    def run(batches):
        m = shipped.value
        for b in batches:
            parts = [m.net.score(*word_ids(data, at, m.net.buckets)) for _, _, data, at in slices(b.column(len(keep)))]
            got = np.concatenate(parts) if parts else np.zeros(0)
            cut = np.array([m.thresholds.get(x, 0.5) for x in b.column(len(keep) + 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(got, pa.float64()), pa.array(got >= cut, pa.bool_())],
                                             [*keep, score_col, flag_col])

    return map_arrow(rows, run, schema)


def held_out(mod: int, rest: int) -> F.Column:
    return F.pmod(crc_of("doc_id"), F.lit(mod)) == rest


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, rejected (by the language's cutoff); labels are
    learnt only where crc32 of the id mod 5 is not 0."""
    model = fit(docs, labels, ~held_out(5, 0))
    return score(docs, model, ["doc_id"]).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")
