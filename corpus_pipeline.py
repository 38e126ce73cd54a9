"""Corpus preparation: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.llm import bpe, decontaminate, language, line_dedup, near_dedup
from luxtrace.llm.common import cut, drop, read_table


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter or in no learnt language go, null and empty ones too. Profiles come from the rows given, but for the held-out third."""
    return language.keep_identified(docs, language.learned_on_documents(docs))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go but for the first document that holds them; ``n_chars`` follows the text."""
    out = line_dedup.drop_repeated_lines(docs, counted=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays; texts without words are one class."""
    return near_dedup.keep_one(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other numbers and names, go; null and empty texts stay."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the digest of what they decode to; a null text has no ids."""
    return bpe.digest(docs)


STAGES = [("language_id", _language), ("line_dedup", _lines), ("near_dedup", _near), ("decontamination", _benchmark), ("byte_bpe", _tokens)]

#: SQL cannot express the profiles, sketches, alignment or merges; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            drop(before)
    return docs
