"""Helpers shared by the corpus operators: storage of intermediate tables, ranks and text units."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from streamloom.session import checkpoint_dir

#: Java patterns: a run of characters other than blank and U+0009 to U+000D, and a run of those.
WORD = r"[^ \t-\r]+"
BLANK = r"[ \t-\r]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str | None) -> Iterator[None]:
    """Jobs that run inside have the setting; None changes nothing."""
    before = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batches(spark: SparkSession, rows: int | None):
    """Jobs that run inside hand at most so many rows to Python at once."""
    return _setting(spark, _BATCH, str(rows) if rows else None)


def stored(df: DataFrame, name: str, batch_rows: int | None = None, release: bool = False) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back: lineage ends here, on storage that outlives executors.
    `batch_rows` bounds the rows that go to Python at once, where whole texts do; `release` removes the shuffle files as
    soon as the table is written."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with batches(spark, batch_rows), _setting(spark, _CLEANUP, "true" if release else None):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete tables of `stored` that nothing reads any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled_order(*parts: Column) -> Column:
    """60 bits that order rows at random but alike in every run; the same in SQL as
    ('0x' || substr(md5(text), 1, 15))::BIGINT."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


ROWS_PER_BUCKET = 8_192


def ranked(
    df: DataFrame,
    keys: list[str],
    order: str,
    ties: list[str],
    rank: str = "rank",
    size: str | None = None,
    before: str = "before",
    rows: int | None = None,
) -> DataFrame:
    """Row number from 0 within `keys` by (`order`, `ties`) and, if `size` is given, the sum of the sizes before the row.

    `order` is a column of `shuffled_order`. Its leading bits cut every key into buckets of about
    `ROWS_PER_BUCKET` rows, so a key that holds most rows is still dealt over many tasks; one row per
    (key, bucket) carries the counts before it.
    """
    rows = df.count() if rows is None else rows
    bits = max(0, math.ceil(math.log2(max(1, rows) / ROWS_PER_BUCKET)))
    df = df.withColumn("__bucket", F.shiftright(F.col(order), 60 - bits) if bits else F.lit(0).cast("long"))
    # Null keys form a key of their own.
    names = [f"__key{i}" for i in range(len(keys))]
    df = df.withColumns({n: F.struct(F.col(k)) for n, k in zip(names, keys, strict=True)})
    amount = F.sum(size) if size else F.sum(F.lit(0))
    totals = df.groupBy(*names, "__bucket").agg(F.count(F.lit(1)).alias("__n"), amount.alias("__s"))
    earlier = Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *names,
        "__bucket",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s0"),
    )
    own = Window.partitionBy(*names, "__bucket").orderBy(order, *ties)
    out = df.join(starts, [*names, "__bucket"]).withColumn(rank, (F.row_number().over(own) - 1 + F.col("__n0")).cast("long"))
    if size:
        past = own.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(before, (F.coalesce(F.sum(size).over(past), F.lit(0)) + F.col("__s0")).cast("long"))
    return out.drop(*names, "__bucket", "__n0", "__s0")
