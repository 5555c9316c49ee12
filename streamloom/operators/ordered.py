"""Ordered per-stream computation that stays balanced when one stream is huge.

A plain `Window.partitionBy(key)` puts a whole stream into one task. Here a first pass counts
rows per key. While every key is under the bound, plain windows are planned. Otherwise the
order of each long key is cut into chunks of about the bound, windows run per (key, chunk),
and what a chunk needs from its neighbours (previous/next row, sums, counts) comes from one
small aggregate row per chunk. Results are the same either way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamloom.columns import col
from streamloom.functions.values import epoch_micros
from streamloom.session import checkpoint_dir, max_chunk_rows

CHUNK = "__chunk"
PART = "__part"  # hash of the key: with the chunk number it is what the shuffle distributes
_SAMPLES_PER_CHUNK = 64
_MAX_CUTS = 1_000_000
_LOWEST = float(np.finfo(np.float64).min)


@dataclass(frozen=True)
class Scan:
    """One ordered output column; `kind` names the window function, `value` its argument."""

    kind: str
    value: Column | None = None


def position() -> Scan:
    """0-based row position inside the stream."""
    return Scan("position")


def lag(value: Column) -> Scan:
    return Scan("lag", value)


def lead(value: Column) -> Scan:
    return Scan("lead", value)


def running_sum(value: Column) -> Scan:
    """Inclusive running sum; nulls count as zero. Sums of doubles do not depend on where a stream is cut (`_Parts`)."""
    return Scan("running_sum", value)


def largest(value: Column) -> Scan:
    """Largest value of the stream."""
    return Scan("largest", value)


_PART_BITS = 31
_PARTS = 4
_LEAST_EXPONENT = -960


class _Parts:
    """A running sum of doubles as running sums of integers, which add up alike in any order.

    Every value is cut into four integers of 31 bits below a power of two above the stream's largest value. Their sums are exact,
    so the one rounding when they are put together gives the same bits whether a stream was summed whole or in
    chunks. What a value has beyond 124 bits below the largest is cut off. Infinite and NaN values are summed on their own and decide.
    """

    def __init__(self, name: str, value: Column):
        self.name, self.value = name, value.cast("double")
        odd = F.isnan(self.value) | (F.abs(self.value) == float("inf"))
        self.plain = F.when(self.value.isNull() | odd, F.lit(0.0)).otherwise(self.value)
        self.odd = F.when(odd, self.value)

    def _exponent(self) -> Column:
        top = F.col(f"__top_{self.name}")
        fitting = F.when(top > 0, F.floor(F.log2(top)) + 2).otherwise(F.lit(_LEAST_EXPONENT))
        return F.greatest(fitting, F.lit(_LEAST_EXPONENT)).cast("double")

    def top(self) -> dict[str, Scan]:
        return {f"__top_{self.name}": largest(F.abs(self.plain))}

    def columns(self) -> dict[str, Column]:
        """The value as a fraction of the power of two, then each part of what the part before left."""
        out, share, step = {}, self.plain * F.pow(F.lit(2.0), -self._exponent()), float(1 << _PART_BITS)
        before = F.lit(0.0)
        for i in range(_PARTS):
            # Scaling by powers of two, remainders of one and the difference of whole numbers are exact.
            raised = share * F.lit(step ** (i + 1))
            whole = raised - raised % F.lit(1.0)
            out[f"__part{i}_{self.name}"] = (whole - before * F.lit(step)).cast("long")
            before = whole
        return out

    def scans(self) -> dict[str, Scan]:
        parts = {f"__part{i}_{self.name}": F.col(f"__part{i}_{self.name}") for i in range(_PARTS)}
        return {f"__sum_{n}": running_sum(v) for n, v in parts.items()} | {f"__odd_{self.name}": Scan("running_sum", self.odd)}

    def result(self) -> Column:
        total, step = F.lit(0.0), F.lit(float(1 << _PART_BITS))
        for i in reversed(range(_PARTS)):
            total = (total + F.col(f"__sum___part{i}_{self.name}").cast("double")) / step
        half = F.floor(self._exponent() / 2).cast("double")
        scaled = total * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), self._exponent() - half)
        odd = F.col(f"__odd_{self.name}")
        return F.when(F.isnan(odd) | (odd != 0), odd).otherwise(scaled)


def last_valid(value: Column) -> Scan:
    """Latest non-null value up to and including the current row."""
    return Scan("last_valid", value)


def next_valid(value: Column) -> Scan:
    """Nearest non-null value from the current row onwards."""
    return Scan("next_valid", value)


def first_valid(value: Column) -> Scan:
    """First non-null value of the stream, null on rows before it."""
    return Scan("first_valid", value)


def total() -> Scan:
    """Number of rows of the stream."""
    return Scan("total")


@dataclass(frozen=True)
class OrderedFrame:
    """A DataFrame with a stream key and a total order (numeric axis, then tie-breakers)."""

    df: DataFrame
    key: tuple[str, ...]
    axis: str
    ties: tuple[str, ...]
    split: bool

    @classmethod
    def of(
        cls,
        df: DataFrame,
        key: Sequence[str],
        axis: str,
        ties: Sequence[str] = (),
        max_rows: int | None = None,
        longest: int | None = None,
    ) -> OrderedFrame:
        """Prepare `df`; runs one key-count job to decide whether chunks are needed.

        A caller that knows an upper limit of rows per key (e.g. from a manifest) passes it as
        `longest`; the job is skipped when that is within the bound.

        Give a unique integral first tie-breaker (e.g. the ingest row number) so that even a
        single axis value repeated very often can be cut.
        """
        bound = max_rows or max_chunk_rows(df.sparkSession)
        base = cls(df, tuple(key), axis, tuple(ties), split=False)
        cuts = None if longest is not None and longest <= bound else _find_cuts(base, bound)
        if cuts is None:
            return base
        placed = df.withColumns({CHUNK: _chunk_column(base, cuts), PART: _cut_inputs(base)[0]})
        # Rows are dealt and sorted once and kept so: every scan reads them several times, and what is written here
        # need not be scanned, numbered, exchanged and sorted again for each window and carry.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = replace(base, df=placed.repartition(parts, PART, CHUNK), split=True)
        sorted_rows = dealt.df.sortWithinPartitions(*[col(g) for g in dealt._group], *dealt._order)
        return replace(dealt, df=_kept_in_place(sorted_rows))

    @property
    def _order(self) -> list[Column]:
        return [col(self.axis), *(col(t) for t in self.ties)]

    @property
    def _group(self) -> list[str]:
        return [PART, CHUNK, *self.key] if self.split else list(self.key)

    @property
    def window(self):
        return Window.partitionBy(*[col(g) for g in self._group]).orderBy(*self._order)

    @property
    def result(self) -> DataFrame:
        return self.df.drop(CHUNK, PART) if self.split else self.df

    def with_columns(self, **outputs: Column) -> OrderedFrame:
        return replace(self, df=self.df.withColumns(outputs))

    def map(self, transform) -> OrderedFrame:
        """Apply a row-preserving or row-dropping transformation that keeps key and order."""
        return replace(self, df=transform(self.df))

    def filter(self, condition: Column) -> OrderedFrame:
        return replace(self, df=self.df.filter(condition))

    def scan(self, scans: dict[str, Scan]) -> OrderedFrame:
        sums = [_Parts(n, s.value) for n, s in scans.items() if s.kind == "running_sum" and self._floating(s.value)]
        if not sums:
            return self._scan(scans)
        names = {p.name for p in sums}
        measured = self._scan({n: s for p in sums for n, s in p.top().items()})
        cut = measured.with_columns(**{n: c for p in sums for n, c in p.columns().items()})
        inner = {n: s for p in sums for n, s in p.scans().items()}
        summed = cut._scan({n: s for n, s in scans.items() if n not in names} | inner)
        done = summed.with_columns(**{p.name: p.result() for p in sums})
        helpers = [f"__top_{p.name}" for p in sums] + [n for p in sums for n in p.columns()] + list(inner)
        outputs = [c for c in done.df.columns if c not in {*helpers, *scans}]
        return done.map(lambda df: df.select(*[col(c) for c in [*outputs, *scans]]))

    def _floating(self, value: Column) -> bool:
        return isinstance(self.df.select(value).schema[0].dataType, (T.DoubleType, T.FloatType))

    def _scan(self, scans: dict[str, Scan]) -> OrderedFrame:
        local = {name: _local(s, self.window) for name, s in scans.items()}
        if not self.split:
            return replace(self, df=self.df.withColumns(local))
        return replace(self, df=self._scan_chunks(scans, local))

    def _scan_chunks(self, scans: dict[str, Scan], local: dict[str, Column]) -> DataFrame:
        order = F.struct(*self._order)
        carried = {n: _carry_aggregate(s, order).alias(f"__c_{n}") for n, s in scans.items()}
        edges = self.df.groupBy(*[col(g) for g in self._group]).agg(*carried.values())
        across = Window.partitionBy(*[col(k) for k in self.key]).orderBy(CHUNK)
        carry = edges.select(
            *[col(g) for g in self._group],
            *[
                _carry_across(s, F.col(f"__c_{n}"), across).alias(f"__c_{n}")
                for n, s in scans.items()
            ],
        ).filter(F.greatest(*[F.col(f"__c_{n}").isNotNull() for n in scans], F.lit(False)))
        # One small row per chunk. Cutting its lineage keeps stacked scans from doubling the plan.
        checkpoint_dir(carry.sparkSession)
        carry = carry.checkpoint()
        edge_row = {
            "__first": F.row_number().over(self.window) == 1,
            "__last": F.lead(F.lit(1)).over(self.window).isNull(),
        }
        left = self.df.withColumns({**local, **edge_row})
        joined = left.join(self._packed(carry, list(scans)), [PART, CHUNK], "left")
        mine = F.get(F.filter("__carry", self._same_key), F.lit(0))
        joined = joined.withColumn("__mine", mine).withColumns(
            {f"__c_{n}": F.col(f"__mine.__c_{n}") for n in scans}
        )
        merged = {n: _merge(s, F.col(n), F.col(f"__c_{n}")) for n, s in scans.items()}
        helpers = ["__first", "__last", "__carry", "__mine", *[f"__c_{n}" for n in scans]]
        return joined.withColumns(merged).drop(*helpers)

    def _packed(self, carry: DataFrame, names: list[str]) -> DataFrame:
        """Carries per (key hash, chunk): one entry, or a few if two keys share a hash.

        Joining on exactly the columns the rows are distributed by costs no second exchange.
        """
        keys = [col(k).alias(f"k{i}") for i, k in enumerate(self.key)]
        entry = F.struct(*keys, *[F.col(f"__c_{n}") for n in names])
        return carry.groupBy(PART, CHUNK).agg(F.collect_list(entry).alias("__carry"))

    def _same_key(self, entry: Column) -> Column:
        same = F.lit(True)
        for i, k in enumerate(self.key):
            same = same & entry[f"k{i}"].eqNullSafe(col(k))
        return same


def _kept_in_place(df: DataFrame) -> DataFrame:
    """Checkpoint that still counts as dealt and sorted; of a plan that adapts while it runs, Spark forgets both."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _local(scan: Scan, w) -> Column:
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    match scan.kind:
        case "position":
            return (F.row_number().over(w) - 1).cast("long")
        case "total":
            everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            return F.count(F.lit(1)).over(everything)
        case "largest":
            everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            return F.max(scan.value).over(everything)
        case "lag":
            return F.lag(scan.value).over(w)
        case "lead":
            return F.lead(scan.value).over(w)
        case "running_sum":
            return F.sum(F.coalesce(scan.value, F.lit(0))).over(so_far)
        case "last_valid":
            return F.last(scan.value, ignorenulls=True).over(so_far)
        case "first_valid":
            return F.first(scan.value, ignorenulls=True).over(so_far)
        case "next_valid":
            ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
            return F.first(scan.value, ignorenulls=True).over(ahead)
    raise ValueError(f"unknown scan {scan.kind!r}")


def _carry_aggregate(scan: Scan, order: Column) -> Column:
    """What one chunk hands to its neighbours."""
    wrapped = None if scan.value is None else F.struct(scan.value.alias("v"))
    valid = None if scan.value is None else F.when(scan.value.isNotNull(), order)
    match scan.kind:
        case "position" | "total":
            return F.count(F.lit(1))
        case "running_sum":
            return F.sum(F.coalesce(scan.value, F.lit(0)))
        case "largest":
            return F.max(scan.value)
        case "lag":
            return F.max_by(wrapped, order)
        case "lead":
            return F.min_by(wrapped, order)
        case "last_valid":
            return F.max_by(scan.value, valid)
        case _:
            return F.min_by(scan.value, valid)


def _carry_across(scan: Scan, edge: Column, across) -> Column:
    """What a chunk receives: from the chunks before it, or after it when looking ahead."""
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    match scan.kind:
        case "position" | "running_sum":
            return F.sum(edge).over(before)
        case "total":
            return F.sum(edge).over(
                across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            )
        case "largest":
            return F.max(edge).over(
                across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            )
        case "lag":
            return F.lag(edge).over(across)
        case "lead":
            return F.lead(edge).over(across)
        case "last_valid":
            return F.last(edge, ignorenulls=True).over(before)
        case "first_valid":
            return F.first(edge, ignorenulls=True).over(before)
        case _:
            return F.first(edge, ignorenulls=True).over(after)


def _merge(scan: Scan, here: Column, carried: Column) -> Column:
    match scan.kind:
        case "position" | "running_sum":
            return here + F.coalesce(carried, F.lit(0))
        case "total" | "largest":
            return carried
        case "lag":
            return F.when(F.col("__first"), carried["v"]).otherwise(here)
        case "lead":
            return F.when(F.col("__last"), carried["v"]).otherwise(here)
        case "first_valid":
            return F.coalesce(carried, here)
        case _:
            return F.coalesce(here, carried)


def _tie_column(frame: OrderedFrame) -> str | None:
    integral = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    if frame.ties and isinstance(frame.df.schema[frame.ties[0]].dataType, integral):
        return frame.ties[0]
    return None


def _plain_axis(axis: Column, kind: T.DataType) -> tuple[Column, bool]:
    """The axis as a number that never decreases along it, null before everything; whether it keeps all of its digits."""
    lowest = F.lit(-(2**63)).cast("long")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(axis.cast("long"), lowest), True
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return F.coalesce((axis * F.lit(10**kind.scale)).cast("decimal(38,0)").cast("long"), lowest), True
    if isinstance(kind, T.TimestampType):
        return F.coalesce(F.unix_micros(axis), lowest), True
    if isinstance(kind, T.TimestampNTZType):
        return F.coalesce(epoch_micros(axis), lowest), True
    if isinstance(kind, T.DateType):
        return F.coalesce(F.unix_date(axis).cast("long"), lowest), True
    number = axis.cast("double")
    floored = F.when(number < F.lit(_LOWEST), F.lit(_LOWEST)).otherwise(number)
    exact = isinstance(kind, (T.DoubleType, T.FloatType))
    return F.when(axis.isNull(), F.lit(float("-inf"))).otherwise(floored), exact


def _cut_inputs(frame: OrderedFrame) -> tuple[Column, Column, Column]:
    """(key hash, axis, tie) as plain numbers that follow the order; null sorts before everything.

    Cuts may look at the tie only between rows of one axis value, so not where the axis lost digits.
    """
    key_hash = F.xxhash64(*[col(k) for k in frame.key]) if frame.key else F.lit(0).cast("long")
    axis, exact = _plain_axis(col(frame.axis), frame.df.schema[frame.axis].dataType)
    tie = _tie_column(frame) if exact else None
    lowest = F.lit(-(2**63)).cast("long")
    return key_hash, axis, F.coalesce(col(tie).cast("long"), lowest) if tie else F.lit(0).cast("long")


@dataclass(frozen=True)
class Cuts:
    """Cut points of all long keys, flat: those of `keys[i]` are at `starts[i]` to `starts[i + 1]`, in their order."""

    keys: np.ndarray
    starts: np.ndarray
    axis: np.ndarray
    tie: np.ndarray

    @classmethod
    def of(cls, points: pd.DataFrame) -> Cuts:
        ordered = points.sort_values(["h", "a", "t"])
        keys, first = np.unique(ordered["h"].to_numpy(), return_index=True)
        return cls(keys, np.append(first, len(ordered)), ordered["a"].to_numpy(), ordered["t"].to_numpy())


def _find_cuts(frame: OrderedFrame, bound: int) -> Cuts | None:
    """Cut points of every key with more than `bound` rows; none when there is no such key.

    The driver receives only key counts above the bound and at most about `_MAX_CUTS` cuts, as arrays.
    """
    spark = frame.df.sparkSession
    key_hash, axis, tie = _cut_inputs(frame)
    points = frame.df.select(key_hash.alias("h"), axis.alias("a"), tie.alias("t"))
    long_keys = points.groupBy("h").count().filter(F.col("count") > bound).toPandas()
    if long_keys.empty:
        return None
    rows = max(bound, int(long_keys["count"].sum()) // _MAX_CUTS)
    one_in = max(1, rows // _SAMPLES_PER_CHUNK)
    every = max(1, rows // one_in)
    wanted = F.broadcast(spark.createDataFrame(long_keys[["h"]], "h long"))
    # A hash of the row's own order values picks the sample, so retries pick the same rows.
    # Repeated order values count once: they fall on one side of a cut anyway.
    sample = (
        points.join(wanted, "h", "left_semi")
        .filter(F.pmod(F.xxhash64("h", "a", "t"), F.lit(one_in)) == 0)
        .distinct()
    )
    rank = F.row_number().over(Window.partitionBy("h").orderBy("a", "t"))
    picked = sample.withColumn("r", rank).filter(F.col("r") % every == 0)
    return Cuts.of(picked.select("h", "a", "t").toPandas())


def _chunk_column(frame: OrderedFrame, cuts: Cuts) -> Column:
    """Number of cuts at or before the row: non-decreasing along the order of any key."""
    shared = frame.df.sparkSession.sparkContext.broadcast((cuts.keys, cuts.starts, cuts.axis, cuts.tie))
    key_hash, axis, tie = _cut_inputs(frame)

    @F.pandas_udf("int")
    def chunk_of(h: pd.Series, a: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(chunk_numbers(h.to_numpy(), a.to_numpy(), t.to_numpy(), *shared.value))

    return chunk_of(key_hash, axis, tie)


def chunk_numbers(
    h: np.ndarray, a: np.ndarray, t: np.ndarray, keys: np.ndarray, starts: np.ndarray, axis: np.ndarray, tie: np.ndarray
) -> np.ndarray:
    """For every row the cuts of its key at or before (axis, tie), by one binary search for all rows; NaN is the largest axis."""
    if not len(keys):
        return np.zeros(len(h), dtype=np.int32)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    first = starts[at]
    low, high = first.copy(), np.where(keys[at] == h, starts[at + 1], first)
    while (searching := np.flatnonzero(low < high)).size:
        mid = (low[searching] + high[searching]) // 2
        cut, row = axis[mid], a[searching]
        odd_cut, odd_row = cut != cut, row != row
        same = (cut == row) | (odd_cut & odd_row)
        passed = (cut < row) | (odd_row & ~odd_cut) | (same & (tie[mid] <= t[searching]))
        low[searching[passed]] = mid[passed] + 1
        high[searching[~passed]] = mid[~passed]
    return (low - first).astype(np.int32)
