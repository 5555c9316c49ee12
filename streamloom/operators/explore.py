"""Exploration: viewport samples, traces, overlays and paged row inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.columns import ColumnSpec, col
from streamloom.operators.align import coalesced
from streamloom.operators.checks import TimeCheck
from streamloom.operators.joins import key_join
from streamloom.operators.ordered import OrderedFrame, position
from streamloom.operators.ranking import total_order_offset
from streamloom.operators.resample import GridResampling, MinMaxLTTB
from streamloom.operators.select import viewport_condition


def trace_budget(per_trace: int, per_figure: int, visible: Column) -> Column:
    """Points each visible trace may show: at least one."""
    return F.greatest(F.lit(1), F.least(F.lit(per_trace), F.floor(F.lit(per_figure) / visible)))


def viewport_sample(
    traces: DataFrame,
    key: Sequence[str],
    x: str,
    y: str,
    budget: int,
    ties: Sequence[str] = (),
    x_range: tuple[float, float] | None = None,
    y_range: tuple[float, float] | None = None,
    custom: Sequence[str] = (),
    resampling: MinMaxLTTB | GridResampling | None = None,
) -> DataFrame:
    """Visible points of every trace after range filter and downsampling to the budget."""
    if budget < 1:
        raise ValueError(f"budget must be >= 1, got {budget}")
    inside = traces.filter(viewport_condition(x, y, x_range, y_range))
    names = list(dict.fromkeys([*key, x, y, *custom, *ties]))
    spec = (resampling or MinMaxLTTB(x, y, points=budget, min_points=1)).with_budget(budget)
    return spec.apply(inside.select(*[col(n) for n in names]), key, ties)


def viewport_counts(
    traces: DataFrame,
    sample: DataFrame,
    key: Sequence[str],
    x: str,
    y: str,
    x_range: tuple[float, float] | None = None,
    y_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Rows in range, points shown and whether the trace was downsampled."""
    keys = [col(k) for k in key]
    inside = traces.filter(viewport_condition(x, y, x_range, y_range))
    rows = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows in range"))
    shown = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("shown points"))
    both = key_join(rows, shown, list(key), "left")
    return both.withColumn("downsampled", F.col("`rows in range`") > F.col("`shown points`"))


def with_data_index(frame: OrderedFrame) -> OrderedFrame:
    """`data index`: 0-based row number inside a trace."""
    return frame.scan({"data index": position()})


def selected_page(
    indexed: DataFrame, traces: Sequence[str], offset: int = 0, limit: int = 100_000
) -> DataFrame:
    """Rows offset..offset+limit of several traces one after the other.

    `indexed` has a `trace` label and `data index`. Row numbers come from trace sizes, so
    nothing is sorted or numbered in one task.
    """
    if offset < 0 or limit < 1:
        raise ValueError("offset must be >= 0 and limit >= 1")
    place = F.array_position(F.array(*[F.lit(t) for t in traces]), F.col("trace"))
    wanted = indexed.withColumn("trace order", place).filter(F.col("trace order") > 0)
    sizes = wanted.groupBy("trace order").agg(F.count(F.lit(1)).alias("__n"))
    starts = total_order_offset(
        sizes, ["trace order"], "__start", "__n", longest=len(traces)
    ).drop("__n")
    numbered = wanted.join(starts, "trace order").withColumn(
        "row number", F.col("__start") + F.col("`data index`")
    )
    number = F.col("`row number`")
    return numbered.filter((number >= offset) & (number < offset + limit)).drop("__start", "trace order")


def selection_total(indexed: DataFrame, traces: Sequence[str]) -> DataFrame:
    return indexed.filter(F.col("trace").isin(*traces)).agg(F.count(F.lit(1)).alias("rows"))


def matching_overlays(
    entries: DataFrame, overlays: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Pairs of displayed streams and overlay streams with equal protocol and task key."""
    return key_join(entries, overlays, [C.PROTOCOL.name, *keys])


def overlay_trace(
    ingested: DataFrame,
    key: Sequence[str],
    x: ColumnSpec,
    y: ColumnSpec,
    source_y: ColumnSpec | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Ingested signal by alias; a time axis is rebuilt as in the time check, without annotations."""
    signal = coalesced(source_y or y, ingested.columns).alias(y.name)
    axis = coalesced(x, ingested.columns).alias(x.name)
    rows = ingested.select(*[col(k) for k in key], axis, signal, *[col(t) for t in ties])
    if x.name != C.TIME.name:
        return rows.select(*[col(k) for k in key], col(x.name), col(y.name))
    check = TimeCheck(x.name, C.TIME_DIFF.name, max_dt_s=None)
    frame = check.prepare(OrderedFrame.of(rows, key, x.name, ties))
    kept = check.finish(frame.filter(check.keep(frame)))
    return kept.result.select(*[col(k) for k in key], col(x.name), col(y.name))


def window_overlay(
    stream: DataFrame,
    position_col: str,
    offset: int,
    rows: int,
    columns: Sequence[str],
    role: str,
) -> DataFrame:
    """Rows of one window of a stream: inputs at the offset, targets one row later."""
    if role not in ("input", "target"):
        raise ValueError(f"role must be input or target, got {role!r}")
    start = max(0, offset + (1 if role == "target" else 0))
    at = col(position_col)
    inside = stream.filter((at >= start) & (at < start + rows))
    return inside.select(F.lit(role).alias("role"), at, *[col(c) for c in columns])


def clamp_index(index: int, count: int) -> int:
    """Index forced into 0..count-1."""
    return 0 if count <= 0 else min(max(0, int(index)), count - 1)


def preview_metadata(windows: DataFrame, fields: Sequence[str], scope: str) -> DataFrame:
    """Selected fields of window rows in long form (scope, field, value)."""
    text = windows.select(*[col(f).cast("string").alias(f) for f in fields])
    long = text.unpivot([], [F.col("`" + f + "`") for f in fields], "field", "value")
    return long.select(F.lit(scope).alias("scope"), "field", "value")
