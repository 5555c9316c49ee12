"""Scoring of a predictions table: weighted losses, alignment, comparison frames.

Predictions are rows `(…, feature, position, logits array<float>, target, mask)`; one row per
scored position and feature.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.columns import col
from streamloom.functions.encodings import encoded, dot, expected_share, log_sum_exp
from streamloom.functions.scaling import Scale
from streamloom.functions.values import is_finite, or_false
from streamloom.operators.joins import key_join


def _by_feature(values: Mapping[str, float]) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
    return F.element_at(F.create_map(*pairs), F.col("feature"))


def valid_target(mask: Column, target: Column) -> Column:
    """Row mask and finite target."""
    return or_false(mask) & is_finite(target)


def with_losses(
    predictions: DataFrame,
    ranges: Mapping[str, tuple[float, float]],
    bins: int,
    sigma: float = 0.0,
) -> DataFrame:
    """Per row: `valid`, cross-entropy `ce`, decoded `prediction` and squared error `se`."""
    low = _by_feature({k: v[0] for k, v in ranges.items()})
    high = _by_feature({k: v[1] for k, v in ranges.items()})
    based = predictions.withColumns(
        {
            "valid": valid_target(F.col("mask"), F.col("target")),
            "__lse": log_sum_exp(F.col("logits")),
            "__low": low,
            "__high": high,
        }
    )
    lse = F.col("__lse")
    decoded = F.col("__low") + expected_share(F.col("logits"), lse) * (F.col("__high") - F.col("__low"))
    weights = encoded(F.col("target"), F.col("__low"), F.col("__high"), bins, sigma)
    # The weights sum to one, so the normalizer leaves the sum.
    ce = lse - dot(weights, F.col("logits"))
    scored = based.withColumn("prediction", decoded)
    error = F.col("prediction") - F.col("target").cast("double")
    return scored.withColumns(
        {"ce": F.when(F.col("valid"), ce), "se": F.when(F.col("valid"), error * error)}
    ).drop("__lse", "__low", "__high")


def loss_sums(losses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mergeable sums and counts per feature."""
    return losses.groupBy(*[col(b) for b in by], "feature").agg(
        F.coalesce(F.sum("ce"), F.lit(0.0)).alias("ce sum"),
        F.coalesce(F.sum("se"), F.lit(0.0)).alias("se sum"),
        F.count_if("valid").alias("count"),
    )


def merge_metrics(sums: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(overall, per feature) metrics from partial sums: sums over counts, never mean of means.

    A zero count gives loss 0 and no RMSE overall, and drops the feature.
    """
    keys = [col(b) for b in by]
    merged = sums.groupBy(*keys, "feature").agg(
        F.sum("ce sum").alias("ce sum"), F.sum("se sum").alias("se sum"), F.sum("count").alias("count")
    )
    per_feature = merged.filter(F.col("count") > 0).select(
        *keys,
        "feature",
        (F.col("ce sum") / F.col("count")).alias("loss"),
        F.sqrt(F.col("se sum") / F.col("count")).alias("rmse"),
        "count",
    )
    overall = merged.groupBy(*keys).agg(
        F.sum("ce sum").alias("__ce"), F.sum("se sum").alias("__se"), F.sum("count").alias("count")
    )
    n = F.col("count")
    overall = overall.select(
        *keys,
        F.when(n > 0, F.col("__ce") / n).otherwise(F.lit(0.0)).alias("loss"),
        F.when(n > 0, F.sqrt(F.col("__se") / n)).alias("rmse"),
        n,
    )
    return overall, per_feature


def first_batches(predictions: DataFrame, batches: int | None, batch_col: str = "batch") -> DataFrame:
    """Only the first N held-out batches; all when N is None."""
    return predictions if batches is None else predictions.filter(col(batch_col) < batches)


def metrics_table(
    sums: DataFrame, features: Sequence[str], by: Sequence[str] = ("checkpoint", "suffix steps")
) -> DataFrame:
    """One row per checkpoint and suffix width, with a loss and RMSE column per feature."""
    overall, per_feature = merge_metrics(sums, by)
    wide = per_feature.groupBy(*[col(b) for b in by]).pivot("feature", list(features)).agg(
        F.first("loss").alias("loss_ce"), F.first("rmse").alias("rmse")
    )
    renamed = {f"{f}_{m}": f"{m}/{f}" for f in features for m in ("loss_ce", "rmse")}
    table = key_join(
        overall.withColumnsRenamed({"loss": "loss_ce"}).drop("count"),
        wide.withColumnsRenamed(renamed),
        list(by),
        "left",
    )
    if "suffix steps" in by:
        strategy = F.when(F.col("`suffix steps`") == 0, "classic").otherwise("masked_suffix")
        table = table.withColumn("strategy", strategy)
    return table


# ---------------------------------------------------------------- suffix windows


def suffix_schedule(settings: DataFrame) -> DataFrame:
    """Window schedule from `suffix steps`, `roll forward` and `context`.

    Window 0 starts at 0; every later one shifts by at most the suffix width until the roll
    forward is used up. Adds the slice bounds of input, prediction, write and target.
    """
    s, roll, context = F.col("`suffix steps`"), F.col("`roll forward`"), F.col("context")
    i = F.col("window")
    rows = settings.withColumn("window", F.explode(F.sequence(F.lit(0), F.ceil(roll / s).cast("int"))))
    start = F.least(i * s, roll)
    left_before = roll - (i - 1) * s
    shift = F.when(i == 0, s).otherwise(F.least(s, left_before))
    remaining = roll - start
    rows = rows.withColumns(
        {
            "start": start.cast("long"),
            "steps": F.least(shift, context).cast("long"),
            "next shift": F.least(s, remaining).cast("long"),
        }
    )
    input_start = context - F.col("steps")
    write_start = F.col("start") + input_start
    return rows.withColumns(
        {
            "input start": input_start.cast("long"),
            "input stop": context.cast("long"),
            "prediction start": (input_start - 1).cast("long"),
            "prediction stop": (context - 1).cast("long"),
            "write start": write_start.cast("long"),
            "write stop": (F.col("start") + context).cast("long"),
            "target start": (write_start - 1).cast("long"),
            "target stop": (F.col("start") + context - 1).cast("long"),
        }
    )


def feedback_pairs(
    targets: Sequence[str], inputs: Sequence[str], channels: Sequence[str]
) -> list[tuple[int, int]]:
    """(target index, input index) of every fed-back channel."""
    return [(list(targets).index(c), list(inputs).index(c)) for c in channels]


def suffix_scored(
    positions: DataFrame, schedule: DataFrame, channels: Sequence[str], masked_only: bool = True
) -> DataFrame:
    """Target positions counted by the suffix objective, once per schedule window.

    `positions` has `feature`, `position`, `target` and `mask`. With `masked_only` a window
    scores only its suffix on the fed-back channels, else its whole context on all features.
    The schedule is a handful of rows; it is laid out per position so the join is on equality.
    """
    context = F.col("context")
    if masked_only:
        first, last = F.col("`target start`"), F.col("`target stop`")
        rows = positions.filter(F.col("feature").isin(*channels))
    else:
        first, last = F.col("start"), F.col("start") + context
        rows = positions
    spans = schedule.filter(last > first).select(
        "window", F.explode(F.sequence(first, last - 1)).alias("position")
    )
    hits = rows.join(spans, "position")
    return hits.filter(valid_target(F.col("mask"), F.col("target")))


# ---------------------------------------------------------------- rollouts


def rollout_windows(anchors: DataFrame, context: int, steps: int) -> tuple[DataFrame, DataFrame]:
    """(windows, problems): anchors need a full context before and observed rows after them."""
    anchor, n = F.col("anchor"), col(C.ROW_COUNT.name)
    problem = F.when(anchor < context - 1, "incomplete context").when(
        anchor + steps >= n, "not enough future rows"
    )
    checked = anchors.withColumn("problem", problem)
    good = checked.filter(F.col("problem").isNull()).drop("problem")
    return (
        good.withColumn("window offset", anchor - context + 1),
        checked.filter(F.col("problem").isNotNull()),
    )


def extended_rollout(
    window_rows: DataFrame,
    keys: Sequence[str],
    inputs: Sequence[str],
    targets: Sequence[str],
    overrides: Mapping[str, float],
    context: int,
    stored: int,
    steps: int,
    rules: Sequence[Scale] = (),
) -> DataFrame:
    """Append `steps` rows that repeat the last inputs, with control overrides.

    Overrides are physical values and need a scaling rule each. Added targets are NaN, and the
    mask is off from the last stored position on.
    """
    by_name = {r.column: r for r in rules}
    missing = [c for c in overrides if c not in by_name or c not in inputs]
    if missing:
        raise ValueError(f"overridden columns need to be inputs with a scaling rule: {missing}")
    end = context + stored
    extra = window_rows.filter(F.col("position") == end - 1).withColumn(
        "position", F.explode(F.sequence(F.lit(end).cast("long"), F.lit(end + steps - 1).cast("long")))
    )
    values = {
        **{name: by_name[name].forward(F.lit(float(v))) for name, v in overrides.items()},
        **{f"target {t}": F.lit(float("nan")) for t in targets},
        "mask": F.lit(False),
    }
    joined = window_rows.unionByName(extra.withColumns(values))
    return joined.withColumn("mask", F.col("mask") & (F.col("position") < end - 1))


def aligned_predictions(
    context: DataFrame,
    rollout: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Context and rollout predictions on the full target grid.

    `windows` gives `target start` and `total steps` per key. Rollout step k lands on
    target start + k and wins over the context; positions without either are NaN.
    """
    total = F.col("`total steps`")
    grid = windows.withColumn(
        "position", F.explode(F.when(total > 0, F.sequence(F.lit(0).cast("long"), total - 1)))
    )
    left = context.select(
        *[col(k) for k in keys], "position", *[col(v).alias(f"__c_{i}") for i, v in enumerate(values)]
    )
    moved = key_join(rollout, windows, keys).select(
        *[col(k) for k in keys],
        (F.col("`target start`") + F.col("step")).alias("position"),
        F.lit(True).alias("__rolled"),
        *[col(v).alias(f"__r_{i}") for i, v in enumerate(values)],
    )
    on = [*keys, "position"]
    out = key_join(key_join(grid, left, on, "left"), moved, on, "left")
    nan = F.lit(float("nan"))
    chosen = [
        F.coalesce(F.when(F.col("__rolled"), F.col(f"__r_{i}")).otherwise(F.col(f"__c_{i}")), nan).alias(v)
        for i, v in enumerate(values)
    ]
    return out.select(*[col(k) for k in keys], "position", *chosen)


def target_time_axis(window_rows: DataFrame, keys: Sequence[str], dt: str | None) -> DataFrame:
    """`target time` of each window position: elapsed time one row ahead of the input.

    Windows are bounded, so one task orders one window.
    """
    position = F.col("position")
    if dt is None:
        return window_rows.withColumn("target time", position + F.lit(1.0))
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy("position")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.greatest(col(dt).cast("double"), F.lit(0.0))
    elapsed = window_rows.withColumn("__elapsed", F.sum(step).over(so_far) - F.first(step).over(so_far))
    ahead = F.lead("__elapsed").over(w)
    return elapsed.withColumn(
        "target time", F.coalesce(ahead, F.col("__elapsed") + step)
    ).drop("__elapsed")


def comparison_frame(
    window_rows: DataFrame,
    predictions: DataFrame,
    keys: Sequence[str],
    inputs: Sequence[str],
    targets: Sequence[str],
    series: Sequence[tuple[str, int]],
    feedback: Sequence[str] = (),
    feedback_end: int | None = None,
) -> DataFrame:
    """Wide frame per position: `input::`, `target::`, `base::` and `prediction::` columns.

    `window_rows` has input columns by name and targets as `target <name>`. Predictions are
    `(keys, position, alias, suffix steps, feature, prediction)`; non-finite ones become null.
    Inputs that are fed back are hidden from `feedback_end` on.
    """
    names = list(dict.fromkeys([*inputs, *targets]))
    cols: list[Column] = []
    for n in names:
        if n in inputs:
            shown = col(n).cast("double")
            if n in feedback and feedback_end is not None:
                shown = F.when(F.col("position") < max(0, feedback_end), shown)
            cols.append(shown.alias(f"input::{n}"))
        if n in targets:
            cols.append(col(f"target {n}").cast("double").alias(f"target::{n}"))
        base = col(f"target {n}") if n in targets else col(n)
        cols.append(base.cast("double").alias(f"base::{n}"))
    base_frame = window_rows.select(*[col(k) for k in keys], "position", *cols)
    labels = [f"prediction::{a}::{s}::{t}" for a, s in series for t in targets]
    label = F.concat_ws("::", F.lit("prediction"), "alias", F.col("`suffix steps`").cast("string"), "feature")
    wide = (
        predictions.withColumn("__label", label)
        .groupBy(*[col(k) for k in keys], "position")
        .pivot("__label", labels)
        .agg(F.first(F.when(is_finite(F.col("prediction")), F.col("prediction"))))
    )
    return key_join(base_frame, wide, [*keys, "position"], "left")


def common_horizon(streams: DataFrame, context: int, requested: int, strict: bool = True) -> DataFrame:
    """Rollout length that fits every stream: `horizon` and whether the request was `clipped`.

    A stream without room beyond the context is an error; with `strict=False` such streams are counted in `too short`, and
    the others decide (null if there is none).
    """
    room = F.greatest(F.lit(0), col(C.ROW_COUNT.name) - context - 1)
    counted = room if strict else F.when(room > 0, room)
    out = streams.agg(F.min(counted).alias("room"), F.count_if(F.coalesce(room, F.lit(0)) <= 0).alias("too short"))
    horizon = F.when(F.col("room") > 0, F.least(F.col("room"), F.lit(requested).cast("long")))
    if strict:
        error = F.raise_error(F.lit("selected streams are too short for the context")).cast("long")
        horizon = horizon.otherwise(error)
    out = out.select(horizon.alias("horizon"), (F.col("room") < requested).alias("clipped"), "too short")
    return out.drop("too short") if strict else out
