"""Corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing to target weights, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.jaccard_join import one_of_each
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality_classifier import quality_scores
from tidemark.llm.store import stage, table

#: Documents scored below this are rejected.
QUALITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from ``labels``."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).where(F.col("__score") >= QUALITY).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay in the first document that holds them; n_chars follows the text.  A document may be left without any text."""
    done = dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id."""
    return one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice; documents without words are not taken."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("source_mix", source_mix), ("best_fit_packing", best_fit_packing)]

#: SQL can express neither the classifier nor the packing: the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
