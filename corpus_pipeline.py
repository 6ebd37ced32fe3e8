"""Corpus pipeline: language ID, near-duplicates, repeated passages, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.llm import langid, membership, packing, simhash, tiling, windows
from sparkscope.session import materialise, table, workers_see_package


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the language model rejects, which are those without a letter or of an uncertain language."""
    model = langid.fit_language_model(docs)
    rest = [c for c in docs.columns if c != "text"]
    judged = langid.predict_languages(docs.select("text", F.struct(*rest).alias("row")), model).where("not rejected")
    return judged.select("text", "row.*").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates."""
    lost = materialise(simhash.near_copies(docs).where("component_id != doc_id").select("doc_id").distinct())
    return membership.without(docs, "doc_id", lost)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a kept document with a smaller id has too."""
    return windows.cut_passages(docs, materialise(windows.repeated_passages(docs)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain most of a benchmark item."""
    leaks = tiling.contaminations(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return membership.without(docs, "doc_id", materialise(leaks))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of all that is left."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Hashing, training and tokenisation have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written and read again."""
    workers_see_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
