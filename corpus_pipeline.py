"""Corpus pipeline: documents in, a mixed training set out.

Five stages, each a call of one operator, each written as Parquet in the shared folder and read
back as the next one's input:

1. ``quality``: documents that the quality cascade rejects go;
2. ``near_duplicates``: one document of each group of (near) copies stays;
3. ``decontamination``: documents that contain a benchmark item go;
4. ``secrets``: secret spans are masked, every document stays;
5. ``mix``: documents are drawn to the sources' target weights (repeated per epoch; adds
   ``epoch`` and ``taken_words``).

The first four return the columns they were given. SQL does not express the banded join or the edit-distance
windows, so ``ORACLE_SQL`` is None and ``tests/llm`` holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reasonloop.llm import decontam, jaccard, mixing, quality, secret_scan
from reasonloop.session import materialize

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.cascade(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
