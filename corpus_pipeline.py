"""Corpus pipeline: quality rules, language ID, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from caisse.llm.catalog import vocabulary_path
from caisse.llm.common import prepare, shared_folder, table
from caisse.llm.jaccard import keep_first
from caisse.llm.language import drop_unknown
from caisse.llm.packing import pack_documents
from caisse.llm.quality import apply_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines above the limits."""
    prepare(spark)
    return apply_rules(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known leading language."""
    prepare(spark)
    return drop_unknown(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id."""
    prepare(spark)
    return keep_first(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents with its place in a sequence of 1024 tokens."""
    prepare(spark)
    return pack_documents(docs, Path(vocabulary_path("byte_bpe_50k.json")).read_text(encoding="utf-8"))


STAGES = [("quality_rules", quality), ("language_id", language), ("ngram_jaccard_join", near_duplicates), ("best_fit_packing", packing)]

#: SQL cannot express n-gram language models or the packing rule; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each stage's rows are written to the shared folder."""
    prepare(spark)
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
