"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on what the one before it kept. All but the last return the columns of
documents: the rules cut frequent lines and drop rejected documents, one document of each group of near copies stays,
personal data is replaced by its kind, and the mix repeats or cuts documents to meet the sources' targets (a repeated
document is a repeated row). The last returns the places of the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamloom.llm import jaccard, line_quality, mixing, packing, pii
from streamloom.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.report(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("pack", pack),
]

#: Estimation, splitting tree and packing are not SQL: each stage is tested against a brute-force version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
