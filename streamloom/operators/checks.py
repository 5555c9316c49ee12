"""Quality checks on ordered streams: annotate rows, report violations or reject tasks.

Each check may derive helper columns, add findings (column, reason, condition) and drop rows.
Checks run in the given order and a later check sees only the rows its predecessors kept; a
row that a check drops still counts for the findings evaluated before the drop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.columns import ANNOTATION, col
from streamloom.functions.derive import ImpedanceComponents, replace_zero
from streamloom.functions.values import is_missing, is_numeric, or_false
from streamloom.operators.joins import spread_join
from streamloom.operators.ordered import OrderedFrame, first_valid, lag, lead

FINDINGS = "__findings"
KEEP = "__keep"
DEFAULT_MAX_DT_S = 86_400.0  # Fixed value: default limit of the time step, one day.


class Finding(NamedTuple):
    column: str
    reason: str
    condition: Column


class Check(Protocol):
    """Extension point: implement these three to add a check."""

    ordered: bool

    def prepare(self, frame: OrderedFrame) -> OrderedFrame: ...

    def findings(self, frame: OrderedFrame) -> tuple[list[Finding], list[Finding]]:
        """Findings evaluated before and after this check's own row filter."""

    def keep(self, frame: OrderedFrame) -> Column | None: ...

    def finish(self, frame: OrderedFrame) -> OrderedFrame: ...


class _RowCheck:
    ordered = False

    def prepare(self, frame: OrderedFrame) -> OrderedFrame:
        return frame

    def keep(self, frame: OrderedFrame) -> Column | None:
        return None

    def finish(self, frame: OrderedFrame) -> OrderedFrame:
        return frame


@dataclass(frozen=True)
class MissingCheck(_RowCheck):
    """Null or NaN numeric values; all numeric columns when none are named."""

    columns: tuple[str, ...] | None = None
    produced: tuple[str, ...] = ()

    @property
    def inputs(self) -> tuple[str, ...]:
        return self.columns or ()

    def findings(self, frame: OrderedFrame) -> tuple[list[Finding], list[Finding]]:
        types = {f.name: f.dataType for f in frame.df.schema if not f.name.startswith("__")}
        names = self.columns if self.columns is not None else tuple(types)
        found = [
            Finding(n, C.REASON_MISSING, is_missing(col(n), types[n]))
            for n in names
            if n in types and is_numeric(types[n])
        ]
        return found, []


@dataclass(frozen=True)
class BoundsCheck(_RowCheck):
    """Values strictly outside inclusive (lower, upper) bounds; never clips."""

    bounds: tuple[tuple[str, float | None, float | None], ...]
    produced: tuple[str, ...] = ()

    @classmethod
    def of(cls, bounds: dict[str, tuple[float | None, float | None]]) -> BoundsCheck:
        return cls(tuple((str(n), lo, hi) for n, (lo, hi) in bounds.items()))

    @property
    def inputs(self) -> tuple[str, ...]:
        return tuple(n for n, _, _ in self.bounds)

    def findings(self, frame: OrderedFrame) -> tuple[list[Finding], list[Finding]]:
        found = []
        for name, lower, upper in self.bounds:
            if name not in frame.df.columns:
                continue
            valid = col(name).isNotNull() & ~F.isnan(col(name).cast("double"))
            if lower is not None:
                found.append(Finding(name, C.REASON_BELOW, valid & (col(name) < float(lower))))
            if upper is not None:
                found.append(Finding(name, C.REASON_ABOVE, valid & (col(name) > float(upper))))
        return found, []


@dataclass(frozen=True)
class ImpedanceCheck(_RowCheck):
    """Derives the missing impedance representation; reports nothing."""

    components: ImpedanceComponents = ImpedanceComponents()

    @property
    def inputs(self) -> tuple[str, ...]:
        return self.components.inputs

    @property
    def produced(self) -> tuple[str, ...]:
        return self.components.produced

    def prepare(self, frame: OrderedFrame) -> OrderedFrame:
        return frame.map(self.components)

    def findings(self, frame: OrderedFrame) -> tuple[list[Finding], list[Finding]]:
        return [], []


@dataclass(frozen=True)
class AxisCheck:
    """Axis values that are null, NaN, not strictly increasing or (optionally) not positive."""

    axis: str
    zero_replacement: float | None = None
    enforce_positive: bool = False
    ordered: bool = True
    produced: tuple[str, ...] = ()

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.axis,)

    def prepare(self, frame: OrderedFrame) -> OrderedFrame:
        if self.axis not in frame.df.columns:
            raise ValueError(f"Domain axis column {self.axis!r} is missing")
        # The order of the rows is that of the values before replacement.
        ordered = frame
        if self.zero_replacement is not None and self.axis == frame.axis:
            ordered = frame.with_columns(__axis_order=col(frame.axis))
            ordered = replace(ordered, axis="__axis_order")
        if self.zero_replacement is not None:
            ordered = ordered.map(lambda d: replace_zero(d, self.axis, self.zero_replacement))
        return ordered.scan({"__axis_before": lag(col(self.axis))})

    def findings(self, frame: OrderedFrame) -> tuple[list[Finding], list[Finding]]:
        value = col(self.axis)
        bad = value.isNull() | F.isnan(value) | or_false(value - F.col("__axis_before") <= 0)
        if self.enforce_positive:
            bad = bad | or_false(value <= 0)
        return [Finding(self.axis, C.REASON_INVALID_AXIS, bad)], []

    def keep(self, frame: OrderedFrame) -> Column | None:
        return None

    def finish(self, frame: OrderedFrame) -> OrderedFrame:
        restored = replace(frame, axis=self.axis) if frame.axis == "__axis_order" else frame
        return restored.map(lambda d: d.drop("__axis_before", "__axis_order"))


@dataclass(frozen=True)
class TimeCheck:
    """Forward time step, duplicate and large-step findings, and a rebuilt axis from zero.

    Rows without a positive step are dropped: the last row of a stream and all but the last of
    equal times. Surviving steps add up to the distance from the first time, so the rebuilt
    axis needs no running sum.
    """

    time: str = C.TIME.name
    dt: str = C.TIME_DIFF.name
    max_dt_s: float | None = DEFAULT_MAX_DT_S
    ordered: bool = True

    def __post_init__(self) -> None:
        if self.max_dt_s is not None and self.max_dt_s <= 0.0:
            raise ValueError(f"max_dt_s must be > 0, got {self.max_dt_s}")

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.time,)

    @property
    def produced(self) -> tuple[str, ...]:
        return (self.dt,)

    def prepare(self, frame: OrderedFrame) -> OrderedFrame:
        if self.time not in frame.df.columns:
            raise ValueError(f"No time column found. Expected {self.time!r}")
        here = F.struct(col(self.time).cast("double").alias("t"))
        time = col(self.time).cast("double")
        valid = F.when(~F.isnan(time), time)
        scanned = frame.scan(
            {"__prev": lag(here), "__next": lead(here), "__start": first_valid(valid)}
        )
        same_before = F.col("__prev").isNotNull() & F.col("__prev.t").eqNullSafe(time)
        same_after = F.col("__next").isNotNull() & F.col("__next.t").eqNullSafe(time)
        return scanned.with_columns(
            **{self.dt: F.col("__next.t") - time, "__duplicate": same_before | same_after}
        )

    def findings(self, frame: OrderedFrame) -> tuple[list[Finding], list[Finding]]:
        before = [Finding(self.time, C.REASON_DUPLICATE_TIME, F.col("__duplicate"))]
        if self.max_dt_s is None:
            return before, []
        return before, [Finding(self.dt, C.REASON_BIG_DT, col(self.dt) > self.max_dt_s)]

    def keep(self, frame: OrderedFrame) -> Column | None:
        return or_false(~F.isnan(col(self.dt)) & (col(self.dt) > 0))

    def finish(self, frame: OrderedFrame) -> OrderedFrame:
        # Order by the original time keeps working: the rebuilt axis only shifts it.
        shifted = frame.with_columns(**{self.time: col(self.time).cast("double") - F.col("__start")})
        return shifted.map(lambda d: d.drop("__prev", "__next", "__start", "__duplicate"))


@dataclass(frozen=True)
class CheckedStreams:
    """Rows with their findings; `dropped` holds findings of rows removed along the way."""

    frame: OrderedFrame
    dropped: tuple[DataFrame, ...] = ()

    @property
    def _live(self) -> DataFrame:
        return self.frame.result.filter(F.col(KEEP))

    def annotated(self) -> DataFrame:
        """Kept rows with the `annotations` column."""
        return self._live.withColumn(C.ANNOTATIONS.name, final_annotations(F.col(FINDINGS))).drop(
            FINDINGS, KEEP
        )

    def violations(self) -> DataFrame:
        """Distinct (key, column, reason) over all rows each check saw."""
        key = [col(k) for k in self.frame.key]
        parts = [self.frame.result.select(*key, FINDINGS), *self.dropped]
        rows = reduce(DataFrame.unionByName, parts).select(*key, F.explode(FINDINGS).alias("f"))
        return rows.select(*key, "f.column", "f.reason").distinct()

    def strict(self) -> DataFrame:
        """Kept rows of the tasks without any violation."""
        keys = list(self.frame.key)
        if self.frame.split or self.dropped:
            bad = self.violations().select(*[col(k) for k in keys]).distinct()
            at = col(self.frame.axis)
            return spread_join(self._live, bad, keys, at, "left_anti").drop(FINDINGS, KEEP)
        # Streams are below the chunk bound here, so a whole-stream frame fits a task.
        whole = Window.partitionBy(*[col(k) for k in keys])
        flagged = self.frame.result.withColumn("__bad", F.max(F.size(FINDINGS) > 0).over(whole))
        return flagged.filter(F.col(KEEP) & ~F.col("__bad")).drop(FINDINGS, KEEP, "__bad")


def run_checks(frame: OrderedFrame, checks: Sequence[Check]) -> CheckedStreams:
    frame = frame.with_columns(**{FINDINGS: _no_findings(), KEEP: F.lit(True)})
    dropped: list[DataFrame] = []
    may_drop = False
    for check in checks:
        if may_drop and check.ordered:
            dropped.append(
                frame.result.filter(~F.col(KEEP)).select(*[col(k) for k in frame.key], FINDINGS)
            )
            frame = frame.filter(F.col(KEEP))
            may_drop = False
        frame = check.prepare(frame)
        before, after = check.findings(frame)
        frame = _record(frame, before)
        keep = check.keep(frame)
        if keep is not None:
            frame = frame.with_columns(**{KEEP: F.col(KEEP) & keep})
            may_drop = True
        frame = check.finish(_record(frame, after))
    return CheckedStreams(frame, tuple(dropped))


def _record(frame: OrderedFrame, found: list[Finding]) -> OrderedFrame:
    if not found:
        return frame
    # Arrays of zero or one element instead of a filter lambda: these stay in generated code.
    flags = [
        F.when(
            F.col(KEEP) & or_false(f.condition),
            F.array(F.struct(F.lit(f.column).alias("column"), F.lit(f.reason).alias("reason"))),
        ).otherwise(_no_findings())
        for f in found
    ]
    return frame.with_columns(**{FINDINGS: F.concat(F.col(FINDINGS), *flags)})


def _no_findings() -> Column:
    return F.array().cast(f"array<{ANNOTATION.simpleString()}>")


def final_annotations(findings: Column, most: int | None = None) -> Column:
    """The findings (the first `most` of them, if given), or null when there are none."""
    return F.when(F.size(findings) > 0, findings if most is None else F.slice(findings, 1, most))


def has_annotation(columns: Sequence[str], reason: str, annotations: Column | None = None) -> Column:
    """Row carries `reason` on any of `columns`."""
    anns = col(C.ANNOTATIONS.name) if annotations is None else annotations
    return or_false(
        F.exists(anns, lambda a: a["column"].isin(*columns) & (a["reason"] == F.lit(reason)))
    )


def annotation_catalogue(df: DataFrame, annotations: str = C.ANNOTATIONS.name) -> DataFrame:
    """Distinct non-null (column, reason) pairs, sorted."""
    items = df.select(F.explode(col(annotations)).alias("a")).select("a.column", "a.reason")
    return items.dropna().distinct().orderBy("column", "reason")


def annotated_aliases(catalogue: DataFrame, spec: C.ColumnSpec) -> DataFrame:
    """Per reason, the annotated columns that are aliases of one canonical column."""
    wanted = catalogue.filter(F.col("column").isin(*spec.candidates))
    return wanted.groupBy("reason").agg(
        F.array_sort(F.collect_set("column")).alias("columns")
    )


def annotation_boundaries(
    frame: OrderedFrame, x: str, y: str, columns: Sequence[str], reason: str
) -> DataFrame:
    """First and last row of every annotated run, where y is not null."""
    flagged = frame.with_columns(__mask=has_annotation(columns, reason)).scan(
        {"__before": lag(F.col("__mask")), "__after": lead(F.col("__mask"))}
    )
    edge = F.col("__mask") & (~or_false(F.col("__before")) | ~or_false(F.col("__after")))
    return flagged.result.filter(edge & col(y).isNotNull()).select(
        *[col(k) for k in frame.key], col(x), col(y)
    )
