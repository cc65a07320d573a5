"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow
from .toxicity import held_out, sample_labels
from .trees import Trees
from .words import stats_of

FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "line_words", "unique", "upper", "digits",
            "punctuation", "wide", "longest", "spaces", "short")


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios of the counts of ``words.STATS``; a text without words has zeros."""
    s = {k: v.astype(float) for k, v in s.items()}
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        s["n_repeat_words"] / words, s["n_words"] / np.maximum(s["n_lines"], 1), s["n_unique"] / words,
        s["n_upper"] / chars, s["n_digit"] / chars, s["n_punct"] / chars, s["n_wide"] / chars,
        np.log1p(s["longest"]), s["n_spaces"] / words, s["n_short"] / words], 1)


def fit(docs: DataFrame, labels: DataFrame, usable: F.Column | None = None, label: str = "quality", most_rows: int = 20_000, **how) -> Trees | None:
    """Trees over the features of at most ``most_rows`` labelled documents (a bounded
    sample by hash of doc_id); the driver gets their features only.  None if there are
    none.  Null ids and labels are left out, null texts count as empty."""
    chosen = sample_labels(labels.where(usable) if usable is not None else labels, label, most_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def run(batches):
        for b in batches:
            x = features(stats_of(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted((r["doc_id"], list(r["x"]), r["y"]) for r in map_arrow(rows, run, f"doc_id {kind}, y int, x array<double>").collect())
    if not got:
        return None
    return Trees(**how).fit(np.array([r[1] for r in got]), np.array([float(r[2]) for r in got]))


def score(docs: DataFrame, model: Trees | None, keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """The columns ``keep`` (all) and the score of each whole text, higher for likelier
    label 1.  Null and empty texts have the features of no words; without a model the
    score is 0.5.  Rows are independent; a column with the new name is replaced."""
    keep = [c for c in (keep or docs.columns) if c != score_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"))
    if model is None:
        return rows.drop("__text").withColumn(score_col, F.lit(0.5))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(score_col, "double")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = shipped.value.score(features(stats_of(b.column(len(keep)))))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(got, pa.float64())], [*keep, score_col])

    return map_arrow(rows, run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learnt only where crc32 of the id
    mod 3 is not 1."""
    model = fit(docs, labels, ~held_out(3, 1))
    return score(docs, model, ["doc_id"]).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
