"""Resampling: shape-preserving MinMaxLTTB, interpolation on a grid, interval compensation.

MinMaxLTTB follows the published algorithms (largest triangle three buckets, with a min/max
preselection). The preselection is one aggregate with map-side combining. The triangle pass
looks at one bucket after another, so it is a fold; a long stream's fold is cut into blocks of
buckets. Each block first maps every possible entry point to its exit point, the small maps
are chained, and then all blocks pick their points in parallel from the known entry. The
result equals the single fold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamloom import columns as C
from streamloom.columns import col
from streamloom.functions.values import is_finite, is_numeric, json_params
from streamloom.operators.joins import key_join, spread_join
from streamloom.operators.ordered import (
    OrderedFrame,
    lead,
    position,
    running_sum,
    first_valid,
    total,
)
from streamloom.session import checkpoint_dir, max_chunk_rows

PRESELECT_RATIO = 4
BLOCK_BUCKETS = 65_536


def no_resampling_metadata() -> tuple[str, str]:
    return "none", "{}"


@dataclass(frozen=True)
class MinMaxLTTB:
    """Keep about `points` (or `points_ratio` of n) rows per stream that preserve y's shape."""

    x: str
    y: str
    points: int | None = None
    points_ratio: float | None = None
    min_points: int = 3
    block_buckets: int = BLOCK_BUCKETS

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.x, self.y)

    def metadata(self) -> tuple[str, str]:
        return "min_max_lttb", json_params(
            {
                "x_col": self.x,
                "y_col": self.y,
                "points": self.points,
                "points_ratio": self.points_ratio,
                "min_points": self.min_points,
            }
        )

    def with_budget(self, points: int) -> MinMaxLTTB:
        return replace(self, points=points, points_ratio=None)

    def budget(self, rows: Column) -> Column:
        """Output rows per stream: the larger of target and `min_points`, at most `rows`."""
        if self.min_points < 1:
            raise ValueError(f"min_points must be >= 1, got {self.min_points}")
        if self.points is not None:
            if self.points < 1:
                raise ValueError(f"points must be >= 1, got {self.points}")
            wanted = F.lit(self.points)
        elif self.points_ratio is not None:
            if self.points_ratio <= 0.0:
                raise ValueError(f"points_ratio must be > 0, got {self.points_ratio}")
            wanted = F.ceil(rows * F.lit(float(self.points_ratio)))
        else:
            raise ValueError("MinMaxLTTB needs points or points_ratio")
        return F.least(rows, F.greatest(F.lit(self.min_points), wanted)).cast("long")

    def most_rows(self, longest: int) -> int:
        """Upper limit of output rows for streams of at most `longest` rows."""
        if self.points is not None:
            return min(longest, max(self.min_points, self.points))
        return min(longest, max(self.min_points, math.ceil(longest * self.points_ratio)))

    def apply(
        self,
        df: DataFrame,
        key: Sequence[str],
        ties: Sequence[str] = (),
        longest: int | None = None,
    ) -> DataFrame:
        """Kept rows with all their columns. (x, ties) must order each stream uniquely."""
        longest = longest_stream(df, key) if longest is None else longest
        # Grouped Arrow functions cannot take column names with dots, so plain names are used.
        plain = {c: f"c{i}" for i, c in enumerate(df.columns)}
        spec = replace(self, x=plain[self.x], y=plain[self.y])
        rows = df.toDF(*plain.values())
        kept = spec._kept(rows, [plain[k] for k in key], [plain[t] for t in ties], longest)
        return kept.toDF(*df.columns)

    def _kept(self, df: DataFrame, key: list[str], ties: list[str], longest: int) -> DataFrame:
        candidates = self.candidates(df, key, ties)
        if longest > min(self.block_buckets, max_chunk_rows(df.sparkSession)):
            # Splitting reads the candidates several times; they are few compared with the rows.
            checkpoint_dir(df.sparkSession)
            candidates = candidates.checkpoint()
        frame = OrderedFrame.of(candidates, key, self.x, ties, longest=longest)
        ranked = frame.scan({"__ci": position(), "__m": total()}).result
        rows = self._with_roles(ranked)
        if longest > self.block_buckets:
            rows = self._resolve_entries(rows, key)
        schema = T.StructType([f for f in ranked.schema if not f.name.startswith("__")])
        x, y = self.x, self.y

        def pick(table: pa.Table) -> pa.Table:
            kept = table.take(pa.array(picked_rows(table, x, y)))
            return kept.select([f.name for f in schema])

        return rows.groupBy(*[col(k) for k in key], "__block").applyInArrow(pick, schema)

    def candidates(self, df: DataFrame, key: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
        """Rows that can be picked: all rows of short streams, bin extremes of long ones.

        Adds `__mode` (keep: the row is in the result; fold: the triangle pass decides) and
        `__budget`. One aggregate over (key, bin) does the work, combined before the shuffle.
        """
        order = [self.x, *ties]
        finite = is_finite(col(self.x)) & is_finite(col(self.y))
        point = F.struct(*[col(c) for c in order])
        stats = (
            df.groupBy(*[col(k) for k in key])
            .agg(
                F.count(F.lit(1)).alias("__n"),
                F.sum(finite.cast("long")).alias("__nf"),
                F.min(point).alias("__head"),
                F.max(point).alias("__tail"),
                F.min(F.when(finite, point)).alias("__first"),
                F.max(F.when(finite, point)).alias("__final"),
            )
            .withColumn("__budget", self.budget(F.col("__n")))
        )
        n, nf, budget = F.col("__n"), F.col("__nf"), F.col("__budget")
        mode = (
            F.when(n <= budget, "keep")
            .when(budget <= 2, "ends")
            .when(nf <= budget, "finite")
            .when(F.floor(nf / budget) > PRESELECT_RATIO, "bins")
            .otherwise("fold")
        )
        tagged = spread_join(df, stats.withColumn("__mode", mode), key, point)
        is_end = (point == F.col("__head")) | ((budget == 2) & (point == F.col("__tail")))
        wanted = (
            F.when(F.col("__mode") == "keep", F.lit(True))
            .when(F.col("__mode") == "ends", is_end)
            .otherwise(finite)
        )
        bins = F.floor(budget * PRESELECT_RATIO / 2)
        low, high = F.col("__first")[self.x].cast("double"), F.col("__final")[self.x].cast("double")
        width = F.when(high > low, (high - low) / bins).otherwise(F.lit(1.0))
        inner = F.least(bins - 1, F.floor((col(self.x).cast("double") - low) / width))
        # Each stream's first and last point keep a bin of their own.
        bin_no = (
            F.when(point == F.col("__first"), F.lit(-1).cast("long"))
            .when(point == F.col("__final"), bins)
            .otherwise(inner)
        )
        single = F.col("__mode") != "bins"
        row = F.struct(*[col(c) for c in df.columns])
        y = col(self.y).cast("double")
        grouped = (
            tagged.filter(wanted)
            .withColumn("__bin", F.when(~single, bin_no))
            .withColumn("__one", F.when(single, point))
            .withColumn("__same", F.when(single, F.xxhash64(*[col(c) for c in df.columns])))
            .groupBy(*[col(k) for k in key], "__mode", "__budget", "__bin", "__one", "__same")
            .agg(
                F.count(F.lit(1)).alias("__copies"),
                F.min(F.struct(y.alias("v"), point.alias("p"), row.alias("r"))).alias("lo"),
                F.min(F.struct((-y).alias("v"), point.alias("p"), row.alias("r"))).alias("hi"),
            )
        )
        # Rows that are not binned stay as often as they occur, even without a tie-breaker.
        both = (
            F.when(F.col("__one").isNotNull(), F.array_repeat("lo.r", F.col("__copies").cast("int")))
            .when(F.col("lo.p") == F.col("hi.p"), F.array("lo.r"))
            .otherwise(F.array("lo.r", "hi.r"))
        )
        folded = F.when(F.col("__mode").isin("bins", "fold"), "fold").otherwise("keep")
        return grouped.select(
            folded.alias("__mode"), "__budget", F.explode(both).alias("__row")
        ).select("__row.*", "__mode", "__budget")

    def _with_roles(self, ranked: DataFrame) -> DataFrame:
        """Bucket and block of every candidate; block edges are also sent to the neighbour."""
        ci, m, budget = F.col("__ci"), F.col("__m"), F.col("__budget")
        size = self.block_buckets
        fold = (F.col("__mode") == "fold") & (m > budget)
        every = (m - 2) / (budget - 2)
        guess = F.ceil(ci / every) - 1
        inner = (
            F.when(every * guess >= ci, guess - 1)
            .when(every * (guess + 1) < ci, guess + 1)
            .otherwise(guess)
        )
        bucket = (
            F.when(~fold, F.lit(0))
            .when(ci == 0, F.lit(-1))
            .when(ci == m - 1, budget - 2)
            .otherwise(F.least(F.greatest(inner, F.lit(0)), budget - 3))
            .cast("long")
        )
        b = F.col("__bucket")
        last_block = F.floor((budget - 3) / size)
        here = F.least(F.greatest(F.floor(b / size), F.lit(0)), last_block)

        def seat(block: Column, role: str) -> Column:
            return F.struct(block.cast("long").alias("block"), F.lit(role).alias("role"))

        none = F.lit(None)
        is_edge_row = (b < 0) | (b == budget - 2)
        seats = F.when(
            F.col("__fold"),
            F.array(
                F.when(~is_edge_row, seat(here, "own")).otherwise(none),
                F.when(b == -1, seat(F.lit(0), "entry")).otherwise(none),
                F.when(b == budget - 2, seat(last_block, "end")).otherwise(none),
                F.when(
                    ~is_edge_row & (F.pmod(b + 1, F.lit(size)) == 0) & (here < last_block),
                    seat(here + 1, "entry"),
                ).otherwise(none),
                F.when(
                    ~is_edge_row & (F.pmod(b, F.lit(size)) == 0) & (b > 0), seat(here - 1, "next")
                ).otherwise(none),
            ),
        ).otherwise(F.array(seat(F.floor(ci / (4 * size)), "keep")))
        return (
            ranked.withColumn("__fold", fold)
            .withColumn("__bucket", bucket)
            .withColumn("__seat", F.explode(F.array_compact(seats)))
            .withColumn("__block", F.col("__seat.block"))
            .withColumn("__role", F.col("__seat.role"))
            .drop("__seat", "__fold", "__mode")
        )

    def _resolve_entries(self, rows: DataFrame, key: Sequence[str]) -> DataFrame:
        """Keep, per block, only the entry candidate that the fold really arrives with."""
        x, y = self.x, self.y
        keys = [col(k) for k in key]
        long_streams = rows.filter(
            (F.col("__role") != "keep") & (F.col("__budget") - 2 > self.block_buckets)
        )
        key_fields = [rows.schema[k] for k in key]
        longs = [T.StructField(c, T.LongType()) for c in ("__block", "__entry", "__exit")]
        map_schema = T.StructType([*key_fields, *longs])

        def block_map(table: pa.Table) -> pa.Table:
            entry, leave = entry_exit_map(table, x, y)
            head = table.slice(0, 1).select([*key, "__block"])
            out = head.take(pa.array(np.zeros(len(entry), dtype=np.int64)))
            out = out.append_column("__entry", pa.array(entry, pa.int64()))
            return out.append_column("__exit", pa.array(leave, pa.int64()))

        small = [*keys, "__block", "__role", "__bucket", "__ci", col(x), col(y)]
        maps = (
            long_streams.select(*small).groupBy(*keys, "__block").applyInArrow(block_map, map_schema)
        )
        chain_schema = T.StructType([*key_fields, longs[0], longs[1]])

        def chain(pdf: pd.DataFrame) -> pd.DataFrame:
            resolved = chained_entries(pdf)
            head = {k: [pdf[k].iloc[0]] * len(resolved) for k in key}
            return pd.DataFrame({**head, "__block": resolved.index, "__entry": resolved.to_numpy()})

        # One row per block and entry candidate: the stream itself is not gathered here.
        entries = maps.groupBy(*keys).applyInPandas(chain, chain_schema)
        # Small: cut here so that the rows are only read once more, for the final pick.
        checkpoint_dir(entries.sparkSession)
        entries = entries.checkpoint()
        later_entry = (F.col("__role") == "entry") & (F.col("__block") > 0)
        known = key_join(rows, entries, [*key, "__block"], "left")
        arrived = F.col("__ci") == F.col("__entry")
        return known.filter(~later_entry | F.coalesce(arrived, F.lit(False))).drop("__entry")


def longest_stream(df: DataFrame, key: Sequence[str]) -> int:
    """Rows of the longest stream; a scan of the key columns only."""
    counts = df.groupBy(*[col(k) for k in key]).count()
    return counts.agg(F.max("count")).first()[0] or 0


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class _Block:
    """One block's candidates in stream order, with the mean point of each following bucket."""

    starts: np.ndarray
    x: np.ndarray
    y: np.ndarray
    rows: np.ndarray
    next_x: np.ndarray
    next_y: np.ndarray
    entry: np.ndarray
    entry_x: np.ndarray
    entry_y: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, x_name: str, y_name: str) -> _Block:
        order = np.argsort(_column(table, "__ci"), kind="stable")
        role = _column(table, "__role")[order]
        bucket = _column(table, "__bucket")[order]
        x = _column(table, x_name).astype(np.float64)[order]
        y = _column(table, y_name).astype(np.float64)[order]
        own = role == "own"
        after = own | (role == "next") | (role == "end")
        heads = np.flatnonzero(np.diff(bucket[after], prepend=bucket[after][0] - 1))
        sizes = np.diff(np.append(heads, after.sum()))
        mean_x = np.add.reduceat(x[after], heads) / sizes
        mean_y = np.add.reduceat(y[after], heads) / sizes
        buckets = len(np.unique(bucket[own]))
        entry = role == "entry"
        return cls(
            starts=np.append(heads[:buckets], own.sum()),
            x=x[own],
            y=y[own],
            rows=order[own],
            next_x=mean_x[1 : buckets + 1],
            next_y=mean_y[1 : buckets + 1],
            entry=order[entry],
            entry_x=x[entry],
            entry_y=y[entry],
        )

    def fold(self) -> np.ndarray:
        """Picked candidate per (bucket, entry): the largest triangle, first on ties."""
        px, py = self.entry_x.copy(), self.entry_y.copy()
        picks = np.empty((len(self.starts) - 1, len(px)), dtype=np.int64)
        for i in range(len(picks)):
            lo, hi = self.starts[i], self.starts[i + 1]
            cx, cy = self.x[lo:hi], self.y[lo:hi]
            dx, dy = px - self.next_x[i], self.next_y[i] - py
            area = np.abs(dx[:, None] * (cy - py[:, None]) - (px[:, None] - cx) * dy[:, None])
            best = area.argmax(axis=1)
            picks[i] = lo + best
            px, py = cx[best], cy[best]
        return picks


def picked_rows(table: pa.Table, x: str, y: str) -> np.ndarray:
    """Rows of one block that stay: rows already decided, the stream's ends and the fold's picks."""
    role = _column(table, "__role")
    kept = np.flatnonzero((role == "keep") | (role == "end") | (_column(table, "__bucket") == -1))
    if not (role == "own").any():
        return kept
    block = _Block.of(table, x, y)
    return np.sort(np.append(kept, block.rows[block.fold()[:, 0]]))


def entry_exit_map(table: pa.Table, x: str, y: str) -> tuple[np.ndarray, np.ndarray]:
    """For every entry candidate of a block, the candidate of its last bucket it leads to."""
    block = _Block.of(table, x, y)
    ci = _column(table, "__ci")
    return ci[block.entry], ci[block.rows[block.fold()[-1]]]


def chained_entries(maps: pd.DataFrame) -> pd.Series:
    """Entry of every block, following the maps from block 0."""
    per_block = {b: g for b, g in maps.groupby("__block")}
    resolved = {}
    arrived = None
    for block in sorted(per_block):
        g = per_block[block]
        entry = g["__entry"].iloc[0] if arrived is None else arrived
        resolved[block] = entry
        arrived = g.loc[g["__entry"] == entry, "__exit"].iloc[0]
    return pd.Series(resolved, dtype="int64")


def lttb_positions(x: np.ndarray, y: np.ndarray, points: int) -> np.ndarray:
    """Plain single-stream triangle selection; the yardstick for tests."""
    n = len(x)
    if points >= n:
        return np.arange(n)
    every = (n - 2) / (points - 2)
    edges = [math.floor(every * i) + 1 for i in range(points - 1)] + [n]
    picks = [0]
    for i in range(points - 2):
        lo, hi, end = edges[i], edges[i + 1], edges[i + 2]
        ax, ay = x[hi:end].mean(), y[hi:end].mean()
        px, py = x[picks[-1]], y[picks[-1]]
        area = np.abs((px - ax) * (y[lo:hi] - py) - (px - x[lo:hi]) * (ay - py))
        picks.append(lo + int(area.argmax()))
    return np.array([*picks, n - 1])


# ---------------------------------------------------------------- interval compensation


def with_interval_prefix(frame: OrderedFrame, dt: str, signal: str) -> OrderedFrame:
    """Running sums before each row, so any later row selection can form interval sums."""
    step = col(dt).cast("double")
    bad_step = step.isNull() | F.isnan(step)
    product = col(signal).cast("double") * step
    bad = product.isNull() | F.isnan(product)
    clean_step, clean = F.when(~bad_step, step), F.when(~bad, product)
    scanned = frame.scan(
        {
            "__dt_to": running_sum(clean_step),
            "__sig_to": running_sum(clean),
            "__bad_to": running_sum(bad.cast("long")),
        }
    )
    zero = F.lit(0.0)
    return scanned.with_columns(
        __dt_before=F.col("__dt_to") - F.coalesce(clean_step, zero),
        __sig_before=F.col("__sig_to") - F.coalesce(clean, zero),
        __bad_before=F.col("__bad_to") - bad.cast("long"),
    )


def compensated(
    all_rows: OrderedFrame, kept: Column, dt: str, time: str, signal: str
) -> DataFrame:
    """Kept rows standing for their whole interval up to the next kept row.

    `dt` becomes the interval's total step, `time` is rebuilt from zero and `signal` is the
    step-weighted mean (zero when the total step is zero). Rows before the first kept row
    belong to no interval.
    """
    full = with_interval_prefix(all_rows, dt, signal)
    # The interval of the last kept row runs to the end of the stream.
    ends = full.result.groupBy(*[col(k) for k in full.key]).agg(
        F.max("__dt_to").alias("__dt_end"),
        F.max_by("__sig_to", F.struct(*[col(c) for c in (full.axis, *full.ties)])).alias("__sig_end"),
        F.max("__bad_to").alias("__bad_end"),
    )
    chosen = full.filter(kept).scan(
        {
            "__dt_next": lead(F.col("__dt_before")),
            "__sig_next": lead(F.col("__sig_before")),
            "__bad_next": lead(F.col("__bad_before")),
            "__dt_zero": first_valid(F.col("__dt_before")),
        }
    )
    at = F.struct(*[col(c) for c in (full.axis, *full.ties)])
    rows = spread_join(chosen.result, ends, list(full.key), at, "left")
    span = F.coalesce("__dt_next", "__dt_end") - F.col("__dt_before")
    weighted = F.coalesce("__sig_next", "__sig_end") - F.col("__sig_before")
    broken = F.coalesce("__bad_next", "__bad_end") > F.col("__bad_before")
    mean = F.when(broken, F.lit(float("nan"))).when(span > 0, weighted / span).otherwise(F.lit(0.0))
    out = rows.withColumns(
        {dt: span, time: F.col("__dt_before") - F.col("__dt_zero"), signal: mean}
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def compensation_signal(columns: Sequence[str]) -> str | None:
    """C-rate when present, else current."""
    for spec in (C.C_RATE, C.CURRENT):
        if spec.name in columns:
            return spec.name
    return None


# ---------------------------------------------------------------- interpolation on a grid


NO_LOG_RANGE = "log scale needs a positive axis range"


@dataclass(frozen=True)
class GridResampling:
    """Interpolate every stream onto `points` linear or logarithmic grid positions."""

    x: str
    points: int
    scale: str = "linear"
    value_range: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        if self.points < 1:
            raise ValueError(f"points must be >= 1, got {self.points}")
        if self.scale not in ("linear", "log"):
            raise ValueError(f"scale must be 'linear' or 'log', got {self.scale!r}")
        if self.value_range is not None:
            low, high = self.value_range
            if low > high:
                raise ValueError(f"value_range must satisfy min <= max, got {self.value_range}")
            if self.scale == "log" and low <= 0:
                raise ValueError(f"log scale needs a positive range, got {self.value_range}")

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.x,)

    def metadata(self) -> tuple[str, str]:
        return "linear", json_params(
            {
                "x_col": self.x,
                "points": self.points,
                "scale": self.scale,
                "value_range": self.value_range,
            }
        )

    def with_budget(self, points: int) -> GridResampling:
        return replace(self, points=points)

    def most_rows(self, longest: int) -> int:
        return self.points

    def failures(self, df: DataFrame, key: Sequence[str]) -> DataFrame | None:
        """(key, reason) of the streams that cannot be put on the grid, from one small aggregate; None if there can be none."""
        if self.scale != "log" or self.value_range is not None:
            return None
        x = F.when(is_finite(col(self.x)), col(self.x).cast("double"))
        low = df.groupBy(*[col(k) for k in key]).agg(F.min(x).alias("__low")).filter(F.col("__low") <= 0)
        return low.select(*[col(k) for k in key], F.lit(NO_LOG_RANGE).alias("reason"))

    def _grid(self, low: Column, high: Column, i: Column) -> Column:
        """Grid value number `i`; the ends are exactly low and high."""
        last = self.points - 1
        if last == 0:
            return low
        share = i / F.lit(float(last))
        if self.scale == "log":
            a, b = F.log10(low), F.log10(high)
            inner = F.pow(F.lit(10.0), a + share * (b - a))
        else:
            inner = low + i * ((high - low) / F.lit(float(last)))
        return F.when(i <= 0, low).when(i >= last, high).otherwise(inner)

    def _interval(self, low: Column, high: Column, x: Column) -> Column:
        """Largest grid number at or below x, -1 when x lies before the grid."""
        last = self.points - 1
        if last == 0:
            return F.when(x >= low, F.lit(0)).otherwise(F.lit(-1)).cast("long")
        if self.scale == "log":
            share = (F.log10(x) - F.log10(low)) / (F.log10(high) - F.log10(low))
        else:
            share = (x - low) / (high - low)
        guess = F.floor(share * last)
        # The guess may be off by one in floating point; compare with the grid itself.
        exact = (
            F.when(self._grid(low, high, guess) > x, guess - 1)
            .when(self._grid(low, high, guess + 1) <= x, guess + 1)
            .otherwise(guess)
        )
        return F.when(x >= high, F.lit(last)).when(x < low, F.lit(-1)).otherwise(exact).cast("long")

    def apply(
        self,
        df: DataFrame,
        key: Sequence[str],
        ties: Sequence[str] = (),
        longest: int | None = None,
    ) -> DataFrame:
        """Numeric columns interpolated (edge pairs extrapolate), others from the nearest row.

        Source rows are reduced to at most two points per grid interval before any ordering, so
        neither long nor repeated streams meet in one task.
        """
        keys = [col(k) for k in key]
        values = [f for f in df.schema if f.name not in {*key, self.x} and f.name not in ties]
        numeric = [f.name for f in values if is_numeric(f.dataType)]
        other = [f.name for f in values if not is_numeric(f.dataType)]
        rows = last_per_axis_value(df, key, self.x, ties)
        x = F.col("__x")

        def valid(name: str) -> Column:
            return is_finite(col(name))

        ends = rows.groupBy(*keys).agg(
            F.min(x).alias("__low"),
            F.max(x).alias("__high"),
            *[F.min(F.when(valid(n), x)).alias(f"__fx_{i}") for i, n in enumerate(numeric)],
            *[F.max(F.when(valid(n), x)).alias(f"__lx_{i}") for i, n in enumerate(numeric)],
        )
        if self.value_range is not None:
            low, high = (F.lit(float(v)) for v in self.value_range)
            ends = ends.withColumns({"__low": low, "__high": high})
        elif self.scale == "log":
            positive = F.when(F.col("__low") > 0, F.col("__low")).otherwise(
                F.raise_error(F.lit(NO_LOG_RANGE))
            )
            ends = ends.withColumn("__low", positive)
        placed = spread_join(rows, ends, key, x).withColumn(
            "__j", self._interval(F.col("__low"), F.col("__high"), x)
        )
        aggs: list[Column] = []
        for i, name in enumerate(numeric):
            pair = F.struct(x.alias("x"), col(name).cast("double").alias("y"))
            inner = F.when(valid(name), pair)
            aggs += [
                F.min(inner).alias(f"__a_{i}"),
                F.max(inner).alias(f"__b_{i}"),
                F.min(F.when(x > F.col(f"__fx_{i}"), inner)).alias(f"__a2_{i}"),
                F.max(F.when(x < F.col(f"__lx_{i}"), inner)).alias(f"__b2_{i}"),
            ]
        if other:
            near = F.struct(x.alias("x"), F.struct(*[col(n) for n in other]).alias("row"))
            aggs += [F.min_by(near, x).alias("__na"), F.max_by(near, x).alias("__nb")]
        marker = F.count(F.lit(1)).alias("__rows")
        summary = placed.groupBy(*keys, "__j").agg(marker, *aggs)
        numbers = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(self.points - 1).cast("long")))
        grid = ends.select(*keys, "__low", "__high", numbers.alias("__j"))
        joined = key_join(grid, summary, [*key, "__j"], "left")
        return self._interpolate(joined, df, key, ties, numeric, other)

    def _interpolate(
        self,
        joined: DataFrame,
        df: DataFrame,
        key: Sequence[str],
        ties: Sequence[str],
        numeric: list[str],
        other: list[str],
    ) -> DataFrame:
        w = Window.partitionBy(*[col(k) for k in key]).orderBy("__j")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        ahead = w.rowsBetween(0, Window.unboundedFollowing)
        everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cols: dict[str, Column] = {}
        for i in range(len(numeric)):
            cols[f"__l_{i}"] = F.last(F.col(f"__b_{i}"), ignorenulls=True).over(before)
            cols[f"__r_{i}"] = F.first(F.col(f"__a_{i}"), ignorenulls=True).over(ahead)
            cols[f"__f1_{i}"] = F.min(F.col(f"__a_{i}")).over(everything)
            cols[f"__f2_{i}"] = F.min(F.col(f"__a2_{i}")).over(everything)
            cols[f"__e1_{i}"] = F.max(F.col(f"__b_{i}")).over(everything)
            cols[f"__e2_{i}"] = F.max(F.col(f"__b2_{i}")).over(everything)
        if other:
            cols["__nl"] = F.last(F.col("__nb"), ignorenulls=True).over(before)
            cols["__nr"] = F.first(F.col("__na"), ignorenulls=True).over(ahead)
        g = self._grid(F.col("__low"), F.col("__high"), F.col("__j"))
        out = joined.withColumns(cols).filter(F.col("__j") >= 0).withColumn("__g", g)
        g = F.col("__g")
        chosen: dict[str, Column] = {self.x: g}
        for i, name in enumerate(numeric):
            left, right = F.col(f"__l_{i}"), F.col(f"__r_{i}")
            first, last = F.col(f"__f1_{i}"), F.col(f"__e1_{i}")
            chosen[name] = (
                F.when(first.isNull(), F.lit(float("nan")))
                .when(first["x"] == last["x"], first["y"])
                .when(right["x"] == g, right["y"])
                .when(left.isNull(), _on_line(first, F.col(f"__f2_{i}"), first, g))
                .when(right.isNull(), _on_line(F.col(f"__e2_{i}"), last, last, g))
                .otherwise(_on_line(left, right, left, g))
            )
        if other:
            left, right = F.col("__nl"), F.col("__nr")
            take_left = right.isNull() | (
                left.isNotNull() & (right["x"] != g) & (g - left["x"] <= right["x"] - g)
            )
            near = F.when(take_left, left["row"]).otherwise(right["row"])
            chosen.update({n: near[n] for n in other})
        names = [c for c in df.columns if c not in ties]
        return out.select(*[(chosen[n] if n in chosen else col(n)).alias(n) for n in names])


def _on_line(a: Column, b: Column, base: Column, at: Column) -> Column:
    """Value at `at` on the line through points a and b, measured from `base`."""
    return base["y"] + (b["y"] - a["y"]) / (b["x"] - a["x"]) * (at - base["x"])


def last_per_axis_value(
    df: DataFrame, key: Sequence[str], x: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Rows with a finite axis; of equal axis values the last in tie order. Adds `__x`."""
    clean = df.filter(is_finite(col(x))).withColumn("__x", col(x).cast("double"))
    if not ties:
        return clean.dropDuplicates([*key, "__x"])
    # NaN and -0.0 cannot reach here as distinct keys: the filter and cast leave plain numbers.
    latest = F.max(F.struct(*[col(t) for t in ties], F.struct(*[col(c) for c in clean.columns]).alias("row")))
    grouped = clean.groupBy(*[col(k) for k in key], "__x").agg(latest.alias("__latest"))
    return grouped.select(F.col("__latest.row.*"))
