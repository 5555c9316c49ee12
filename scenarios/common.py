"""Registry of the queries on the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions.values import epoch_seconds

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as measurement rows: `t` is the time in seconds."""
    return table(spark, folder, "events").withColumn("t", epoch_seconds(F.col("ts")))


E = "(SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"


def rounded(value: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def reason_text(annotations: Column) -> Column:
    """Annotations as one string, null when there are none."""
    parts = F.transform(annotations, lambda a: F.concat(a["column"], F.lit(":"), a["reason"]))
    return F.array_join(parts, ";")


def gappy(df: DataFrame) -> DataFrame:
    """Some nulls and NaNs in `value`."""
    v = F.when(F.col("event_id") % 17 == 0, F.lit(None)).when(
        F.col("event_id") % 19 == 0, F.lit(float("nan"))
    )
    return df.withColumn("value", v.otherwise(F.col("value")).cast("double"))


GAPPY = f"""(SELECT * REPLACE (CASE WHEN event_id % 17 = 0 THEN NULL
    WHEN event_id % 19 = 0 THEN 'nan'::DOUBLE ELSE value END AS value) FROM {E})"""


def stream_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (data set, cell, cycle, protocol) with its row count, from the events."""
    kind = F.col("event_type")
    protocol = (
        F.when(kind.isin("click", "signup"), "cycling")
        .when(kind == "view", "HPPC")
        .when(kind == "purchase", "RPT")
        .otherwise("EIS")
    )
    keys = table(spark, folder, "events").select(
        F.when(kind == "signup", "b").otherwise("a").alias("dataset id"),
        F.concat(F.lit("cell-"), (F.col("user_id") % 20).cast("string")).alias("cell id"),
        F.col("user_id").alias("cycle index"),
        protocol.alias("protocol"),
        "value",
    )
    return keys.groupBy("dataset id", "cell id", "cycle index", "protocol").agg(
        F.count(F.lit(1)).alias("row count"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )


INDEX = """(SELECT CASE WHEN event_type = 'signup' THEN 'b' ELSE 'a' END AS "dataset id",
    'cell-' || (user_id % 20) AS "cell id", user_id AS "cycle index",
    CASE WHEN event_type IN ('click', 'signup') THEN 'cycling' WHEN event_type = 'view' THEN 'HPPC'
         WHEN event_type = 'purchase' THEN 'RPT' ELSE 'EIS' END AS protocol,
    count(*) AS "row count", min(value) AS low, max(value) AS high
  FROM events GROUP BY ALL)"""
