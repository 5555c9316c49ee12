"""Structured Streaming forms of the axis checks: one small state per task key.

Rows of a key must arrive in order across micro-batches. Within a micro-batch they are sorted
by (axis, ties) unless `late="reference"`, which keeps arrival order. Late rows are put out with a reason.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from streamloom import columns as C
from streamloom.columns import col
from streamloom.operators.checks import (
    FINDINGS,
    KEEP,
    AxisCheck,
    BoundsCheck,
    MissingCheck,
    TimeCheck,
    final_annotations,
    run_checks,
)
from streamloom.functions.values import or_false
from streamloom.operators.ordered import OrderedFrame

DUPLICATE, BIG, LATE = "__duplicate", "__big_dt", "__late"
#: Values of LATE: why a row is put out without a step.
REASON_LATE, REASON_NO_TIME = "late row", "missing time"


PENDING_STATE = "pending binary, elapsed double, duplicate boolean, late long"


def rebuild_rows(
    rows: pd.DataFrame,
    pending: pd.DataFrame | None,
    pending_duplicate: bool,
    elapsed: float,
    time: str,
    dt: str,
    max_dt_s: float | None,
    late: str,
) -> tuple[pd.DataFrame, pd.DataFrame, bool, float, int]:
    """One step of the chunked time check.

    Returns (emitted rows, new pending row, its duplicate flag, elapsed time, dropped late rows).
    All but the newest row are emitted; the newest waits for its successor.
    """
    dropped = 0
    if pending is not None and late == "drop":
        keep = ~(rows[time].to_numpy(dtype=float) < float(pending[time].iloc[0]))
        dropped = int((~keep).sum())
        rows = rows[keep]
    if len(rows) == 0 and pending is not None:
        return rows, pending, pending_duplicate, elapsed, dropped
    data = rows if pending is None else pd.concat([pending, rows], ignore_index=True)
    t = data[time].to_numpy(dtype=float)
    step = np.append(np.diff(t), np.nan)
    same = np.zeros(len(t), dtype=bool)
    if late == "drop":
        # Sorted input: equal times are neighbours. The pending row keeps its own flag.
        equal = np.append(t[1:] == t[:-1], False)
        same = equal | np.insert(equal[:-1], 0, False)
    else:
        same = pd.Series(t).duplicated(keep=False).to_numpy()
    if pending is not None:
        same[0] = same[0] or pending_duplicate
    out = data.assign(**{dt: step, DUPLICATE: same})
    emit = out.iloc[:-1]
    emit = emit[emit[dt].to_numpy() > 0]
    steps = emit[dt].to_numpy(dtype=float)
    rebuilt = elapsed + np.cumsum(steps) - steps
    big = np.zeros(len(emit), dtype=bool) if max_dt_s is None else steps > max_dt_s
    emit = emit.assign(**{time: rebuilt, BIG: big})
    return emit, data.iloc[[-1]], bool(same[-1]), elapsed + float(steps.sum()), dropped


def stream_time_check(
    stream: DataFrame,
    key: Sequence[str],
    check: TimeCheck | None = None,
    ties: Sequence[str] = (),
    late: str = "report",
    watermark: tuple[str, str] | None = None,
) -> DataFrame:
    """Time steps, rebuilt axis and duplicate / large-step flags of a stream of task rows.

    Emission lags one row per key, as the newest row has no step yet. Rows without time, and
    rows older than the pending one, are put out at once with their own time, no step and a reason in
    `__late`. `late="drop"` discards both; `late="reference"` keeps arrival order, so the row before
    a late one is the one that loses its step, and puts out rows without time. `watermark` is (event-time column, delay).
    """
    if late not in ("report", "drop", "reference"):
        raise ValueError(f"late must be 'report', 'drop' or 'reference', got {late!r}")
    check = check or TimeCheck()
    if watermark is not None:
        stream = stream.withWatermark(*watermark)
    # Grouped pandas functions cannot take column names with dots, so plain names are used.
    given = stream.drop(check.dt)
    plain = {c: f"c{i}" for i, c in enumerate(given.columns)}
    renamed = given.toDF(*plain.values())
    safe = TimeCheck(plain[check.time], "dt", check.max_dt_s)
    out = _stream_time_check(
        renamed, [plain[k] for k in key], safe, [plain[t] for t in ties], late
    )
    return out.toDF(*given.columns, check.dt, DUPLICATE, BIG, LATE)


def _stream_time_check(
    stream: DataFrame, key: list[str], check: TimeCheck, ties: list[str], late: str
) -> DataFrame:
    time, dt, limit = check.time, check.dt, check.max_dt_s
    names = list(stream.columns)
    flags = [
        T.StructField(dt, T.DoubleType()),
        T.StructField(DUPLICATE, T.BooleanType()),
        T.StructField(BIG, T.BooleanType()),
        T.StructField(LATE, T.StringType()),
    ]
    fields = [
        T.StructField(time, T.DoubleType()) if f.name == time else f
        for f in stream.schema
    ]
    output = T.StructType([*fields, *flags])
    order = [time, *ties]

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, elapsed, duplicate, late_rows = None, 0.0, False, 0
        if state.exists:
            blob, elapsed, duplicate, late_rows = state.get
            pending = _from_bytes(blob)
        # One micro-batch of one key; its size is set by the source's rate limit.
        rows = pd.concat(list(batches), ignore_index=True)[names]
        rows[time] = rows[time].astype(float)
        reason = np.where(rows[time].isna(), REASON_NO_TIME, None)
        if late == "report" and pending is not None:
            reason[rows[time].to_numpy() < float(pending[time].iloc[0])] = REASON_LATE
        aside = pd.notna(reason)
        if late != "drop" and aside.any():
            flags_off = {dt: np.nan, DUPLICATE: False, BIG: False, LATE: reason[aside]}
            yield rows[aside].assign(**flags_off)[[f.name for f in output]]
        late_rows += int((reason == REASON_LATE).sum())
        rows = rows[~aside]
        if late != "reference":
            rows = rows.sort_values(order, kind="stable")
        if len(rows) == 0:
            if pending is not None:
                state.update((_to_bytes(pending), elapsed, duplicate, late_rows))
            return
        emit, tail, duplicate, elapsed, dropped = rebuild_rows(
            rows, pending, duplicate, elapsed, time, dt, limit, "reference" if late == "reference" else "drop"
        )
        state.update((_to_bytes(tail), elapsed, duplicate, late_rows + dropped))
        if len(emit):
            yield emit.assign(**{LATE: None})[[f.name for f in output]]

    return stream.groupBy(*[col(k) for k in key]).applyInPandasWithState(
        step, output, PENDING_STATE, "append", GroupStateTimeout.NoTimeout
    )


def _to_bytes(row: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(row, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.BufferReader(blob)).read_all().to_pandas()


def stream_axis_check(
    stream: DataFrame, key: Sequence[str], check: AxisCheck, ties: Sequence[str] = ()
) -> DataFrame:
    """Flags axis values against the last non-null value seen before; adds `__invalid_axis`."""
    plain = {c: f"c{i}" for i, c in enumerate(stream.columns)}
    renamed = stream.toDF(*plain.values())
    safe = replace(check, axis=plain[check.axis])
    out = _stream_axis_check(renamed, [plain[k] for k in key], safe, [plain[t] for t in ties])
    return out.toDF(*stream.columns, "__invalid_axis")


def _stream_axis_check(
    stream: DataFrame, key: list[str], check: AxisCheck, ties: list[str]
) -> DataFrame:
    axis = check.axis
    output = T.StructType([*stream.schema.fields, T.StructField("__invalid_axis", T.BooleanType())])
    state_schema = T.StructType([T.StructField("previous", T.DoubleType())])

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous = state.get[0] if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True)
        if ties:
            rows = rows.sort_values(list(ties), kind="stable")
        values, bad, previous = axis_flags(rows[axis].to_numpy(dtype=float), previous, check)
        if previous is not None:
            state.update((previous,))
        yield rows.assign(**{axis: values, "__invalid_axis": bad})[[f.name for f in output]]

    return stream.groupBy(*[col(k) for k in key]).applyInPandasWithState(
        step, output, state_schema, "append", GroupStateTimeout.NoTimeout
    )


def axis_flags(
    values: np.ndarray, previous: float | None, check: AxisCheck
) -> tuple[np.ndarray, np.ndarray, float | None]:
    """(values after zero replacement, invalid flags, last non-null value)."""
    v = values.copy()
    if check.zero_replacement is not None:
        v[v == 0] = check.zero_replacement
    before = np.append(np.nan if previous is None else previous, v[:-1])
    bad = np.isnan(v) | (v - before <= 0)
    if check.enforce_positive:
        bad |= v <= 0
    seen = v[~np.isnan(v)]
    return v, bad, float(seen[-1]) if len(seen) else previous


def stream_row_checks(stream: DataFrame, checks: Sequence[MissingCheck | BoundsCheck]) -> DataFrame:
    """Stateless checks on a stream: adds `annotations` in check order."""
    frame = OrderedFrame(stream, (), "", (), split=False)
    return run_checks(frame, checks).frame.df.withColumn(
        C.ANNOTATIONS.name, final_annotations(F.col(FINDINGS))
    ).drop(FINDINGS, KEEP)


def annotated_time_check(checked: DataFrame, check: TimeCheck) -> DataFrame:
    """Turn the flags of `stream_time_check` into `annotations`."""
    def flag(condition: str, column: str, reason: str):
        pair = F.struct(F.lit(column).alias("column"), F.lit(reason).alias("reason"))
        return F.when(or_false(F.col(condition)), pair)

    found = F.array_compact(
        F.array(
            flag(DUPLICATE, check.time, C.REASON_DUPLICATE_TIME),
            flag(BIG, check.dt, C.REASON_BIG_DT),
            F.when(F.col(LATE).isNotNull(), F.struct(F.lit(check.time).alias("column"), F.col(LATE).alias("reason"))),
        )
    )
    return checked.withColumn(C.ANNOTATIONS.name, final_annotations(found)).drop(DUPLICATE, BIG, LATE)


def stream_overlay_time(
    stream: DataFrame, key: Sequence[str], time: str = C.TIME.name, ties: Sequence[str] = ()
) -> DataFrame:
    """Rebuilt time of an overlay trace: the chunked time check without flags but `__late`."""
    check = TimeCheck(time, C.TIME_DIFF.name, max_dt_s=None)
    return stream_time_check(stream, key, check, ties).drop(DUPLICATE, BIG, check.dt)
