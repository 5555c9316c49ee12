"""From normalized data to training windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.columns import col
from streamloom.functions.scaling import Scale, scale
from streamloom.operators.index import scaling_violations
from streamloom.operators.select import (
    check_model_columns,
    filter_split,
    require_columns,
    require_no_rows,
)
from streamloom.operators.windows import (
    WindowSpec,
    batch_counts,
    window_lanes,
    with_rank,
    with_sequential_plan,
    with_sequential_plan_index,
)

STREAM_KEY = (C.DATASET_ID.name, C.CELL_ID.name, C.CYCLE_INDEX.name, C.PROTOCOL.name)


def training_windows(
    index: DataFrame,
    rows: DataFrame,
    split: str,
    inputs: Sequence[str],
    targets: Sequence[str],
    spec: WindowSpec,
    rules: Sequence[Scale] = (),
    feedback: Sequence[str] = (),
    world_size: int = 1,
    workers: int = 1,
    stream_key: Sequence[str] = STREAM_KEY,
    order: Sequence[str] | None = None,
    check_bounds: bool = True,
) -> DataFrame:
    """Scaled sequential windows of one split, one row per window and lane, with rank and worker.

    `rows` are normalized rows with the stream key and `row position`.
    """
    if rules:
        check_model_columns(inputs, targets, feedback, [r.column for r in rules])
    require_columns(rows.columns, [*stream_key, C.ROW_POSITION.name, *inputs, *targets], "Rows")
    streams = filter_split(index, split).filter(col(C.ROW_COUNT.name) > 1)
    if rules and check_bounds:
        require_no_rows(scaling_violations(streams, rules).select("column", "problem"), "Scaling bounds")
    planned = with_sequential_plan(streams, spec)
    numbered = with_sequential_plan_index(planned, order or stream_key)
    lanes = window_lanes(
        scale(rows, rules),
        numbered,
        stream_key,
        C.ROW_POSITION.name,
        inputs,
        targets,
        spec,
        carry=["plan start"],
    )
    placed = lanes.withColumn(
        "plan index", F.col("`plan start`") + F.col("`window number`")
    )
    total = batch_counts(planned).first()[0] if world_size > 1 else None
    return with_rank(placed.drop("plan start"), world_size, workers, total)


def write_windows(windows: DataFrame, path: str) -> None:
    """One folder per split and rank, so a reader opens only its own files."""
    windows.write.mode("overwrite").partitionBy(C.SPLIT.name, "rank").option(
        "compression", "zstd"
    ).parquet(path)
