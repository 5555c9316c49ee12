"""Normalize: ordered, checked and resampled streams per task, with manifest and statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.columns import col
from streamloom.operators.align import (
    check_required_inputs,
    select_canonical,
    with_constants,
    with_resolved_columns,
)
from streamloom.operators.checks import FINDINGS, run_checks
from streamloom.operators.joins import key_join, spread_join
from streamloom.operators.manifest import (
    manifest_kind,
    ordered_list,
    resolve_provenance,
    stream_stats,
)
from streamloom.operators.ordered import OrderedFrame, position
from streamloom.operators.resample import (
    GridResampling,
    MinMaxLTTB,
    compensated,
    compensation_signal,
    longest_stream,
    no_resampling_metadata,
)
from streamloom.operators.select import selection_condition
from streamloom.plans.datasets import DatasetSpec, NormalizeSpec
from streamloom.protocols import NORMALIZE_MANIFEST, PROVENANCE
from streamloom.session import written
from streamloom.sources.writers import write_manifest, write_shards, written_segments


@dataclass(frozen=True)
class Normalized:
    """`rows` is the stage output, `violations` the distinct (key, column, reason) found, `failures` the (key, reason) of
    streams that could not be resampled (None if there can be none); they are not among the rows."""

    rows: DataFrame
    violations: DataFrame
    failures: DataFrame | None = None


def normalize_rows(
    ingested: DataFrame,
    spec: NormalizeSpec,
    annotate: bool = False,
    resample: bool = True,
    compensate: bool = False,
    longest: int | None = None,
    store: bool = False,
) -> Normalized:
    """One protocol's streams: derive, check, resample, number.

    With `store` the checked rows are written once, and what follows reads that table instead of running the checks again. A
    stream that cannot be resampled is a failure of its own and leaves the others alone.

    Without `annotate` a task with any violation is left out. `longest` is an upper limit of
    rows per task, known from the manifest, and saves counting them.
    """
    key = spec.protocol.key_names
    if longest is None:
        longest = longest_stream(ingested, key)
    specs = {c.name: c for c in spec.output_columns}
    required = [specs.get(n) or _canonical(n) for n in spec.required_inputs]
    check_required_inputs(ingested.columns, required, spec.protocol)
    ties = [C.INGEST_ORDER.name] if C.INGEST_ORDER.name in ingested.columns else []
    rows = with_resolved_columns(ingested, [*required, *spec.output_columns])
    rows = with_constants(rows, dict(spec.constants))
    for transform in spec.transforms:
        rows = transform(rows)
    rows = with_resolved_columns(rows, spec.output_columns)
    names = dict.fromkeys([*key, *ties, *spec.required_inputs, *[c.name for c in spec.output_columns]])
    rows = rows.select(*[col(n) for n in names if n in rows.columns])
    axis = spec.order[0].name
    frame = OrderedFrame.of(rows, key, axis, ties, longest=longest)
    checked = run_checks(frame, spec.checks)
    if store:
        keep = checked.frame.map(lambda df: written(df, "normalize-checked"))
        checked = replace(checked, frame=keep, dropped=_stored_findings(checked.dropped))
    kept = checked.annotated() if annotate else checked.strict()
    extra = [C.ANNOTATIONS.name] if annotate else []
    selected = select_canonical(kept, spec.output_columns, [*key, *ties, *extra])
    failures = None
    if resample and isinstance(spec.resampling, GridResampling):
        failures = spec.resampling.failures(selected, key)
        if failures is not None:
            failures = written(failures, "normalize-failures") if store else failures
            selected = spread_join(selected, failures.drop("reason"), key, col(axis), "left_anti")
    if resample and spec.resampling is not None:
        signal = compensation_signal(selected.columns)
        can_compensate = C.TIME_DIFF.name in selected.columns and signal is not None
        if compensate and can_compensate and isinstance(spec.resampling, MinMaxLTTB):
            selected = _compensated(selected, spec.resampling, key, ties, signal, longest)
        else:
            selected = spec.resampling.apply(selected, key, ties, longest=longest)
        longest = spec.resampling.most_rows(longest)
    left = [t for t in ties if t in selected.columns]
    numbered = OrderedFrame.of(selected, key, axis, left, longest=longest).scan(
        {C.ROW_POSITION.name: position()}
    )
    output = numbered.result.drop(*left).withColumn(C.PROTOCOL.name, F.lit(spec.protocol.name))
    return Normalized(output, checked.violations(), failures)


def _stored_findings(dropped: tuple[DataFrame, ...]) -> tuple[DataFrame, ...]:
    """Findings of rows that checks removed: only those with any are written."""
    return tuple(written(d.filter(F.size(FINDINGS) > 0), "normalize-dropped") for d in dropped)


def _canonical(name: str) -> C.ColumnSpec:
    known = {v.name: v for v in vars(C).values() if isinstance(v, C.ColumnSpec)}
    return known[name]


def _compensated(
    rows: DataFrame,
    spec: MinMaxLTTB,
    key: list[str],
    ties: list[str],
    signal: str,
    longest: int | None,
) -> DataFrame:
    """Downsample, then let each kept row stand for its interval."""
    order = [spec.x, *ties]
    kept = spec.apply(rows.select(*[col(c) for c in dict.fromkeys([*key, *order, spec.y])]), key, ties, longest)
    flag = kept.select(*[col(c) for c in [*key, *order]]).withColumn("__kept", F.lit(True))
    full = key_join(rows, flag, [*key, *order], "left")
    frame = OrderedFrame.of(full, key, spec.x, ties, longest=longest)
    chosen = F.coalesce(F.col("__kept"), F.lit(False))
    # The rebuilt axis replaces the one that orders the rows, so keep the latter aside.
    ordered = frame.with_columns(__axis=col(spec.x))
    ordered = OrderedFrame(ordered.df, ordered.key, "__axis", ordered.ties, ordered.split)
    out = compensated(ordered, chosen, C.TIME_DIFF.name, C.TIME.name, signal)
    return out.select(*[col(c) for c in rows.columns])


def dry_run(ingested: DataFrame, spec: NormalizeSpec, longest: int | None = None) -> DataFrame:
    """Violations only; nothing is written."""
    return normalize_rows(ingested, spec, resample=False, longest=longest).violations


def resample_again(rows: DataFrame, manifest: DataFrame, spec: NormalizeSpec) -> DataFrame:
    """Resample an unresampled normalized result; an already resampled one is refused."""
    if not manifest.filter(col(C.RESAMPLING_METHOD.name) != "none").isEmpty():
        raise ValueError("the source is already resampled")
    missing = [c.name for c in spec.output_columns if c.name not in rows.columns]
    if missing:
        raise ValueError(f"the source lacks columns of this spec: {missing}")
    if spec.resampling is None:
        return rows
    key = spec.protocol.key_names
    longest = longest_stream(rows, key)
    data = rows.drop(C.ROW_POSITION.name, C.PROTOCOL.name)
    out = spec.resampling.apply(data, key, longest=longest)
    frame = OrderedFrame.of(
        out, key, spec.order[0].name, longest=spec.resampling.most_rows(longest)
    )
    numbered = frame.scan({C.ROW_POSITION.name: position()})
    return numbered.result.withColumn(C.PROTOCOL.name, F.lit(spec.protocol.name))


def stream_manifest(
    spark: SparkSession, root: str, path: str, spec: NormalizeSpec, resampled: bool = True
) -> DataFrame:
    """Segments, row count, statistics and resampling of every stream of a written table."""
    key = spec.protocol.key_names
    rows = spark.read.parquet(path)
    segments = written_segments(spark, root, path, key)
    merged = segments.groupBy(C.PROTOCOL.name, *[col(k) for k in key]).agg(
        F.flatten(ordered_list(F.col("segments"), col(C.ROW_POSITION.name))).alias(
            C.NORMALIZED_SEGMENTS.name
        )
    )
    stats = stream_stats(rows, key, [c.name for c in spec.output_columns])
    method, params = (
        spec.resampling.metadata() if resampled and spec.resampling else no_resampling_metadata()
    )
    return key_join(merged, stats, key).withColumns(
        {C.RESAMPLING_METHOD.name: F.lit(method), C.RESAMPLING_PARAMS.name: F.lit(params)}
    )


def task_states(
    planned: DataFrame, counts: DataFrame, done: Normalized, key: Sequence[str], annotate: bool
) -> DataFrame:
    """Per planned task: row count, chunks, `status`, `reason` of a failure and `warnings`.

    A task fails where it could not be resampled, or where it has violations that are not annotated. Warnings are the
    distinct violations that an annotated task keeps, and one for a task that succeeds without any row.
    """
    keys = [col(k) for k in key]
    found = F.array_sort(F.collect_set(F.concat_ws(":", "column", "reason")))
    table = key_join(planned, counts, key, "left")
    table = key_join(table, done.violations.groupBy(*keys).agg(found.alias("__found")), key, "left")
    reason = F.lit(None).cast("string") if annotate else F.array_join("__found", ";")
    if done.failures is not None:
        table = key_join(table, done.failures.withColumnRenamed("reason", "__failed"), key, "left")
        reason = F.coalesce(F.col("__failed"), reason)
    table = table.withColumn("reason", reason)
    status = F.when(F.col("reason").isNotNull(), "failed").otherwise("succeeded")
    kept = F.coalesce(F.size("__found"), F.lit(0)) if annotate else F.lit(0)
    empty = (col(C.ROW_COUNT.name).isNull() & F.col("reason").isNull()).cast("int")
    warnings = F.when(F.col("reason").isNull(), F.greatest(kept, F.lit(0)) + empty).otherwise(F.lit(0)).cast("long")
    return table.withColumns({"status": status, "warnings": warnings}).drop("__found", "__failed")


def run_normalize(
    spark: SparkSession,
    dataset: DatasetSpec,
    inputs: Mapping[str, DataFrame],
    output_root: str,
    provenance: Mapping[str, object],
    annotate: bool = False,
    resample: bool = True,
    compensate: bool = False,
    specs: Sequence[NormalizeSpec] | None = None,
    stage: str = "normalized",
    protocols: object = None,
    group_values: object = None,
) -> DataFrame:
    """Normalize every protocol's rows, write shards and the manifest, return the task table.

    The task table has `status`, `reason`, `row count`, `chunks` and `warnings`; any failed task turns
    the manifest into an error manifest, and the rest is written all the same. A selection limits the tasks that run.
    """
    folder = f"{output_root.rstrip('/')}/{dataset.stage_root(stage)}"
    manifests, tasks = [], []
    for spec in specs or dataset.normalize:
        name = spec.protocol.name
        if name not in inputs:
            continue
        rows = inputs[name]
        if protocols is not None or group_values is not None:
            named = rows if C.PROTOCOL.name in rows.columns else rows.withColumn(C.PROTOCOL.name, F.lit(name))
            rows = named.filter(
                selection_condition([C.PROTOCOL.name, *spec.protocol.key_names], protocols, group_values)
            )
        key = spec.protocol.key_names
        # One count of the input gives the tasks and the longest of them.
        planned = written(rows.groupBy(*[col(k) for k in key]).agg(F.count(F.lit(1)).alias("__rows")), "normalize-tasks")
        longest = planned.agg(F.max("__rows")).first()[0] or 0
        done = normalize_rows(rows, spec, annotate, resample, compensate, longest, store=True)
        path = f"{folder}/data/{name.casefold()}"
        write_shards(done.rows, path, key)
        manifest = stream_manifest(spark, output_root, path, spec, resample)
        manifests.append(manifest)
        counts = manifest.select(
            *[col(k) for k in key],
            col(C.ROW_COUNT.name),
            F.size(col(C.NORMALIZED_SEGMENTS.name)).cast("long").alias("chunks"),
        )
        tasks.append(task_states(planned.drop("__rows"), counts, done, key, annotate).withColumn(C.PROTOCOL.name, F.lit(name)))
    if not manifests:
        raise ValueError("No declared protocol among the inputs")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]), True)
    layout = NORMALIZE_MANIFEST.with_protocols([s.protocol for s in dataset.normalize])
    manifest = union(manifests)
    for column in layout.columns:
        if column.name not in manifest.columns:
            manifest = manifest.withColumn(column.name, column.null())
    task_table = union(tasks)
    runtime = {
        C.DATASET_ID.name: dataset.dataset_id,
        C.PROCESSING_STAGE.name: stage,
        C.MANIFEST_PATH.name: f"{dataset.stage_root(stage)}/manifest.parquet",
        **provenance,
    }
    resolved = resolve_provenance(manifest, PROVENANCE, runtime)
    write_manifest(resolved, folder, manifest_kind(task_table))
    return task_table
