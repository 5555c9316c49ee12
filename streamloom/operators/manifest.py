"""Manifests: one row per stream with its segments, row count, statistics and provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.columns import COLUMN_STAT, ColumnSpec, col
from streamloom.functions.values import is_numeric, task_id
from streamloom.protocols import MetadataLayout, ProtocolSpec


def ordered_list(value: Column, order: Column) -> Column:
    """Aggregate: values of a group as an array in the given order."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def build_manifest(
    segment_rows: DataFrame,
    layout: MetadataLayout,
    segments: ColumnSpec,
    order: Sequence[str],
) -> DataFrame:
    """Group segment rows that agree on all other manifest columns.

    Row counts are summed and segments appended in `order`. Raw paths take part in the grouping
    as they are. Segment rows describe files, not data rows, so lists stay small.
    """
    names = [c.name for c in layout.columns]
    group = [n for n in names if n not in (segments.name, C.ROW_COUNT.name)]
    position = F.struct(*[col(o) for o in order])
    grouped = segment_rows.groupBy(*[col(g) for g in group]).agg(
        F.sum(col(C.ROW_COUNT.name)).alias(C.ROW_COUNT.name),
        F.flatten(ordered_list(col(segments.name), position)).alias(segments.name),
    )
    if C.RAW_PATHS.name in group:
        grouped = grouped.withColumn(C.RAW_PATHS.name, F.array_distinct(col(C.RAW_PATHS.name)))
    return grouped.select(*[col(c.name).cast(c.dtype).alias(c.name) for c in layout.columns])


def merge_tasks(
    manifest: DataFrame, protocol: ProtocolSpec, segments: ColumnSpec, order: Sequence[str]
) -> DataFrame:
    """One row per (protocol, task key): distinct segments and paths in order, summed rows."""
    keys = [C.PROTOCOL.name, *protocol.key_names]
    position = F.struct(*[col(o) for o in order])
    rows = manifest.filter(col(C.PROTOCOL.name) == protocol.name)
    aggs = [
        F.sum(col(C.ROW_COUNT.name)).alias(C.ROW_COUNT.name),
        F.array_distinct(F.flatten(ordered_list(col(segments.name), position))).alias(segments.name),
    ]
    if C.RAW_PATHS.name in manifest.columns:
        paths = F.flatten(ordered_list(col(C.RAW_PATHS.name), position))
        aggs.append(F.array_distinct(paths).alias(C.RAW_PATHS.name))
    tasks = rows.groupBy(*[col(k) for k in keys]).agg(*aggs)
    return tasks.withColumn("task id", task_id(col(C.PROTOCOL.name), protocol.key_names))


def merged_entries(manifest: DataFrame, keys: Sequence[str], segments: str, order: Sequence[str]) -> DataFrame:
    """Display entries: segments appended in order (duplicates stay), rows summed."""
    position = F.struct(*[col(o) for o in order])
    return manifest.groupBy(*[col(k) for k in keys]).agg(
        F.sum(F.coalesce(col(C.ROW_COUNT.name), F.lit(0))).alias(C.ROW_COUNT.name),
        F.flatten(ordered_list(col(segments), position)).alias(segments),
    )


def grouped_manifest(manifest: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every other column as an ordered list per group (nulls stay in place)."""
    position = F.struct(*[col(o) for o in order])
    rest = [c for c in manifest.columns if c not in keys]
    return manifest.groupBy(*[col(k) for k in keys]).agg(
        *[ordered_list(col(c), position).alias(c) for c in rest]
    )


def column_ranges(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Wide min/max of numeric columns per stream, NaN ignored; combined before the shuffle."""
    names = columns or [
        f.name for f in df.schema if f.name not in key and is_numeric(f.dataType)
    ]
    aggs = []
    for n in names:
        value = col(n).cast("double")
        clean = F.when(~F.isnan(value), value)
        aggs += [F.min(clean).alias(f"{n}|min"), F.max(clean).alias(f"{n}|max")]
    return df.groupBy(*[col(k) for k in key]).agg(F.count(F.lit(1)).alias(C.ROW_COUNT.name), *aggs)


def stream_stats(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and `normalized stats` (column, min, max sorted by column) per stream."""
    wide = column_ranges(df, key, columns)
    names = sorted(c.removesuffix("|min") for c in wide.columns if c.endswith("|min"))
    items = [
        F.when(
            col(f"{n}|min").isNotNull(),
            F.struct(
                F.lit(n).alias("column"), col(f"{n}|min").alias("min"), col(f"{n}|max").alias("max")
            ),
        )
        for n in names
    ]
    stats = F.array_compact(F.array(*items)) if items else F.array()
    return wide.select(
        *[col(k) for k in key],
        col(C.ROW_COUNT.name),
        stats.cast(f"array<{COLUMN_STAT.simpleString()}>").alias(C.NORMALIZED_STATS.name),
    )


def stats_rows(manifest: DataFrame, key: Sequence[str]) -> DataFrame:
    """`normalized stats` as (key, column, min, max) rows."""
    items = manifest.select(*[col(k) for k in key], F.explode(col(C.NORMALIZED_STATS.name)).alias("s"))
    return items.select(*[col(k) for k in key], "s.column", "s.min", "s.max")


def protocols_per_dataset(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy(col(C.DATASET_ID.name)).agg(
        F.array_sort(F.collect_set(col(C.PROTOCOL.name))).alias(C.PROTOCOLS.name)
    )


def run_statistics(tasks: DataFrame) -> DataFrame:
    """Counts over a task table with `status`, `row count`, `chunks` and `warnings`."""
    rows = col(C.ROW_COUNT.name)
    ok = F.col("status") == "succeeded"
    return tasks.agg(
        F.count_if(ok).alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"),
        F.coalesce(F.sum(F.when(ok, F.col("chunks"))), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum(F.when(ok, rows)), F.lit(0)).alias("rows"),
    )


def common_columns(file_columns: DataFrame) -> DataFrame:
    """Columns present in every file of a protocol, from (protocol, file path, column) rows."""
    files = file_columns.groupBy(col(C.PROTOCOL.name)).agg(
        F.countDistinct("`file path`").alias("files")
    )
    per_column = file_columns.groupBy(col(C.PROTOCOL.name), "column").agg(
        F.countDistinct("`file path`").alias("present")
    )
    everywhere = per_column.join(files, C.PROTOCOL.name).filter(F.col("present") == F.col("files"))
    return everywhere.select(col(C.PROTOCOL.name), "column")


def resolve_provenance(
    df: DataFrame, layout: MetadataLayout, runtime: Mapping[str, object]
) -> DataFrame:
    """Provenance columns: row's own value, else runtime value, else layout default, else null.

    A required column that stays null fails the job.
    """
    out = {}
    for spec in layout.columns:
        choices = []
        if spec.name in df.columns:
            choices.append(col(spec.name).cast(spec.dtype))
        if runtime.get(spec.name) is not None:
            choices.append(F.lit(runtime[spec.name]).cast(spec.dtype))
        if spec in layout.required and not choices:
            raise ValueError(f"Provenance is missing required values: {spec.name!r}")
        default = layout.optional.get(spec)
        if default is not None:
            choices.append(F.lit(default).cast(spec.dtype))
        if spec in layout.required:
            choices.append(F.raise_error(F.lit(f"missing required provenance {spec.name}")).cast(spec.dtype))
        out[spec.name] = F.coalesce(*choices) if choices else spec.null()
    return df.withColumns(out)


def encoded_provenance(df: DataFrame, layout: MetadataLayout) -> DataFrame:
    """Provenance as text: null as `null`, booleans in lower case, nested values as JSON."""

    def text(spec: ColumnSpec) -> Column:
        kind = spec.dtype.typeName()
        value = F.to_json(col(spec.name)) if kind in ("array", "map", "struct") else col(spec.name).cast("string")
        return F.coalesce(value, F.lit("null")).alias(spec.name)

    return df.select(*[text(c) for c in layout.columns])


def manifest_kind(tasks: DataFrame) -> str:
    """`manifest`, `err_manifest` when any task failed, or `none` when nothing ran."""
    row = tasks.agg(
        F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("n")
    ).first()
    if row["n"] == 0:
        return "none"
    return "err_manifest" if row["failed"] else "manifest"
