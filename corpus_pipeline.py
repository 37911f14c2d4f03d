"""Corpus pipeline: the operators of tidemark.llm over documents, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact_dedup, language_id, packing, simhash
from tidemark.llm.common import table
from tidemark.storage import discard, materialise, scope

#: Documents whose best language has a lower calibrated probability are rejected; four languages guess at 0.25.
MIN_LANGUAGE_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, null texts too, and those that no learned language fits."""
    return language_id.keep_identified(docs, MIN_LANGUAGE_SCORE)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest doc_id stays; null texts are equal to empty ones, null ids below all others."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8; SimHash, then exact for the rest), the smallest doc_id stays; so do rows with a null id or without words."""
    return simhash.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words or more is benchmark text; null and empty texts stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, neighbours on the curve together; null texts have the end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("decontaminate", decontaminate_stage),
    ("packing", pack),
]

#: The stages hold a trained model and a tokenizer, which SQL cannot express; a test compares run() with plain stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; an empty table gives no rows.

    Tables that a stage's own operators wrote are deleted when the stage is written,
    and so is the stage before it; those of other queries are left alone.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark) as own:
            kept = own.keep(materialise(stage(spark, docs, sf_dir), name))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
