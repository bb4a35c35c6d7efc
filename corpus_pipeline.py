"""The corpus pipeline: language ID, quality rules, near-duplicates, mixing and packing, each stage on what the last one kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from maskframe.llm import langid, mixing, neardup, packing, quality
from maskframe.llm.common import shared_dir
from maskframe.llm.queries import table, tokenizer_path


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which one known language labels at least half the words; ``und`` ones go."""
    return langid.keep_known(docs)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the rules and the isolation forest pass, fitted on the labels of this input."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return neardup.keep_first(docs, width=5, percent=80)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources meet their target weights."""
    return mixing.apply_mix(docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; one row a piece."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", stage_language), ("quality", stage_quality), ("dedup", stage_dedup), ("mix", stage_mix), ("pack", stage_pack)]

#: Neither models nor packings can be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")  # also lets the workers reach the package
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"  # every run has a folder of its own
    for i, (name, stage) in enumerate(STAGES):
        out = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return docs
