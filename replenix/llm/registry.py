"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, formatting, interaction, mixing, neardup, packing, passages, personal, prefixes, quality, rules, toxicity, vectors
from .shared import cut, table

WORDS = r"[^\x20\x09-\x0D]+"


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count("text", F.lit(WORDS)).alias("n_words"))
    return mixing.mix(cut(docs, "sizes"), size="n_words").select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.digest(table(spark, sf_dir, "conversations"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.count(table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(table(spark, sf_dir, "documents"))


def filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules,
        "op2_repeated_passages": repeated_passages,
        "op3_source_mix": source_mix,
        "op4_near_duplicates": near_duplicates,
        "op5_near_vectors": near_vectors,
        "op6_chat_windows": chat_windows,
        "op7_toxicity": toxicity_scores,
        "op8_quality_classifier": quality_scores,
        "op9_section_tokens": section_tokens,
        "op10_packing": packed,
        "op11_prefix_trie": prefix_trie,
        "op12_personal_data": personal_data,
        "op13_filter_interaction": filter_interaction,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": rules.sql(), "op4_near_duplicates": neardup.sql(),
            "op5_near_vectors": vectors.sql(), "op11_prefix_trie": prefixes.sql(), "op13_filter_interaction": interaction.sql()}
