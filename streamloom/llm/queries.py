"""The registered queries of the corpus operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from streamloom.llm import (
    balanced_shards,
    fim,
    hash_search,
    hyperlang,
    jaccard,
    line_dedup,
    line_quality,
    mixing,
    packing,
    pii,
    repair,
    runs,
    suffix_dedup,
)
from streamloom.llm.common import table
from streamloom.llm.sql import ORACLES as _SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality.report(table(spark, folder, "documents"))


@register
def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


@register
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(table(spark, folder, "documents"))


@register
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(table(spark, folder, "documents"))


@register
def op10_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.report(table(spark, folder, "documents"))


@register
def op3_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.report(table(spark, folder, "documents"))


@register
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.report(table(spark, folder, "documents"))


@register
def op9_hyperlang(spark: SparkSession, folder: str) -> DataFrame:
    return hyperlang.report(table(spark, folder, "documents"))


@register
def op4_hash_search(spark: SparkSession, folder: str) -> DataFrame:
    return hash_search.report(table(spark, folder, "embeddings"))


@register
def op6_balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    return balanced_shards.report(table(spark, folder, "documents"))


@register
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(table(spark, folder, "documents"))


@register
def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.report(table(spark, folder, "documents"))


@register
def op13_fim(spark: SparkSession, folder: str) -> DataFrame:
    return fim.report(table(spark, folder, "documents"))


ORACLES = {name: sql for name, sql in _SQL.items() if name in QUERIES}
