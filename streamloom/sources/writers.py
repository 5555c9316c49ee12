"""Stage output: protocol shards clustered by stream, manifests and their discovery."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.columns import SEGMENT, col
from streamloom.operators.select import CANONICAL_MANIFEST
from streamloom.sources.files import list_files
from streamloom.sources.tables import FILE, ROW_INDEX, with_row_source

_PIECE = "__piece"
#: Rows of a stream that are shuffled, sorted and written on end.
PIECE_ROWS = 250_000


def write_shards(
    df: DataFrame,
    path: str,
    key: Sequence[str],
    mode: str = "overwrite",
    max_records_per_file: int = 20_000_000,
    row_group_bytes: int = 128 * 1024 * 1024,
    piece_rows: int = PIECE_ROWS,
    rows: int | None = None,
) -> None:
    """Write rows (with `row position`) partitioned by protocol and clustered by stream.

    Streams are cut into pieces of `piece_rows`, and pieces are what the shuffle distributes:
    a long stream spreads over many files, a short one stays in one. There are as many tasks as shuffle partitions, or as pieces
    where the caller knows the number of `rows`, so what a task sorts does not grow with the table. Spark itself would put
    tasks together by their compressed bytes, a small part of what rows take when sorted.
    """
    position = col(C.ROW_POSITION.name)
    pieces = df.withColumn(_PIECE, F.floor(position / piece_rows))
    order = [C.PROTOCOL.name, *key]
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((rows or 0) / piece_rows))
    clustered = pieces.repartition(tasks, *[col(c) for c in order], _PIECE).sortWithinPartitions(
        *[col(c) for c in order], _PIECE, position
    )
    (
        clustered.drop(_PIECE)
        .write.mode(mode)
        .partitionBy(C.PROTOCOL.name)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", max_records_per_file)
        .option("parquet.block.size", row_group_bytes)
        .parquet(path)
    )


def written_segments(
    spark: SparkSession,
    root: str,
    path: str,
    key: Sequence[str],
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Segments of a table written by `write_shards`: per stream, file and piece one row range."""
    data = with_row_source(spark.read.parquet(path), root)
    group = [C.PROTOCOL.name, *key]
    position = col(C.ROW_POSITION.name)
    ranges = data.groupBy(
        *[col(c) for c in group], FILE, F.floor(position / piece_rows).alias(_PIECE)
    ).agg(
        F.min(ROW_INDEX).alias("__start"),
        F.count(F.lit(1)).alias(C.ROW_COUNT.name),
        F.min(position).alias(C.ROW_POSITION.name),
    )
    segment = F.struct(
        F.col(FILE).alias("file path"),
        F.col("__start").alias("row start"),
        col(C.ROW_COUNT.name).alias("row count"),
    ).cast(SEGMENT)
    return ranges.select(
        *[col(c) for c in group],
        F.array(segment).alias("segments"),
        col(C.ROW_COUNT.name),
        col(C.ROW_POSITION.name),
    )


def write_table_once(df: DataFrame, path: str) -> None:
    """A single table is never overwritten."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_manifest(manifest: DataFrame, folder: str, kind: str) -> str | None:
    """Write `manifest.parquet` or `err_manifest.parquet`; `none` writes nothing."""
    if kind == "none":
        return None
    if kind not in ("manifest", "err_manifest"):
        raise ValueError(f"kind must be manifest, err_manifest or none, got {kind!r}")
    path = f"{folder.rstrip('/')}/{kind}.parquet"
    manifest.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def available_manifests(spark: SparkSession, root: str) -> list[str]:
    """Canonical normalized manifests below a store root, sorted."""
    files = list_files(spark, root, include=("*/manifest.parquet/*.parquet", "*/manifest.parquet"))
    folder = F.regexp_replace("path", r"(/manifest\.parquet)/.*$", "$1")
    rows = files.select(folder.alias("path")).filter(F.col("path").rlike(CANONICAL_MANIFEST))
    return [r[0] for r in rows.distinct().orderBy("path").collect()]


def load_manifest(spark: SparkSession, root: str, relative: str) -> DataFrame:
    """A manifest with its path; `type`, `dataset` and `source` come from the folder names."""
    base = spark.read.parquet(f"{root.rstrip('/')}/{relative}")
    parts = dict(p.split("=", 1) for p in relative.split("/") if "=" in p)
    return base.withColumns(
        {**{k: F.lit(v) for k, v in parts.items()}, C.MANIFEST_PATH.name: F.lit(relative)}
    )
