"""Global positions without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.columns import col
from streamloom.functions.values import is_numeric
from streamloom.operators.joins import key_join
from streamloom.operators.ordered import OrderedFrame, running_sum

_PREFIX = "__prefix"


def digest(*parts: Column) -> Column:
    """Stable text digest of the parts joined by `|`; nulls are written out as `null`."""
    texts = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws("|", *texts))


def digest_rank(
    df: DataFrame,
    digest_col: str,
    ties: Sequence[str],
    rank: str,
    total: str | None = None,
    prefix_chars: int | None = None,
) -> DataFrame:
    """0-based rank of every row in (digest, ties) order, and the overall row count.

    Digests are uniform, so their first characters cut the order into even buckets: rank inside
    a bucket plus the sizes of the buckets before it. Without
    `prefix_chars`, their number follows from a count: some 50,000 rows a bucket.
    """
    if prefix_chars is None:
        prefix_chars = max(1, math.ceil(math.log(max(1, df.count()) / 50_000, 16)))
    named = df.withColumn(_PREFIX, F.substring(col(digest_col), 1, prefix_chars))
    sizes = named.groupBy(_PREFIX).agg(F.count(F.lit(1)).alias("__n"))
    # At most 16 ** prefix_chars rows reach this window.
    order = Window.orderBy(_PREFIX)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        _PREFIX,
        (F.sum("__n").over(order) - F.col("__n")).alias("__before"),
        F.sum("__n").over(everything).alias("__total"),
    )
    inside = Window.partitionBy(_PREFIX).orderBy(col(digest_col), *[col(t) for t in ties])
    ranked = named.withColumn("__rn", F.row_number().over(inside) - 1).join(offsets, _PREFIX)
    out = ranked.withColumn(rank, (F.col("__rn") + F.col("__before")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop(_PREFIX, "__rn", "__before", "__total")


def total_order_offset(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    weight: str | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Sum of `weight` (1 per row by default) over all rows before this one in a total order.

    The columns before the first numeric one form groups; rows are ordered inside a group by the
    numeric column and the rest, with long groups cut into chunks. Only the table of group sizes
    is ordered as a whole.
    """
    axis_at = next((i for i, c in enumerate(order) if is_numeric(df.schema[c].dataType)), None)
    if axis_at is None:
        raise ValueError(f"a total order needs a numeric column, got {list(order)}")
    groups, axis, ties = list(order[:axis_at]), order[axis_at], list(order[axis_at + 1 :])
    w = F.lit(1) if weight is None else col(weight)
    frame = OrderedFrame.of(df, groups, axis, ties, longest=longest)
    summed = frame.scan({name: running_sum(w)}).result
    inside = col(name) - w
    if not groups:
        return summed.withColumn(name, inside.cast("long"))
    sizes = df.groupBy(*[col(c) for c in groups]).agg(F.sum(w).alias("__n"))
    before = Window.orderBy(*[col(c) for c in groups])
    starts = sizes.select(
        *[col(c) for c in groups], (F.sum("__n").over(before) - F.col("__n")).alias("__start")
    )
    return (
        key_join(summed, starts, groups, "left")
        .withColumn(name, (inside + F.col("__start")).cast("long"))
        .drop("__start")
    )


def total_order_position(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """0-based position of every row in the total order given by several columns."""
    return total_order_offset(df, order, name)


def first_occurrences(df: DataFrame, values: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Distinct rows of `values` in the order of their first occurrence: 0-based place in `name`.

    The smallest position per value is an aggregate with map-side sums, so a value that holds most rows is one row per task;
    places come from counts (`total_order_position`). `order` has a numeric column in it; values that first occur at the
    same place of it follow one another in their own order.
    """
    at = F.min(F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(order)])).alias("__first")
    firsts = df.groupBy(*[col(v) for v in values]).agg(at).select(*[col(v) for v in values], "__first.*")
    flat = firsts.withColumnsRenamed({f"o{i}": f"__o{i}" for i in range(len(order))})
    named = [f"__o{i}" for i in range(len(order))]
    return total_order_position(flat, [*named, *values], name).drop(*named)


def digest_number(digest_col: Column) -> Column:
    """First 15 hex digits of a digest as a non-negative integer."""
    return F.conv(F.substring(digest_col, 1, 15), 16, 10).cast("long")
