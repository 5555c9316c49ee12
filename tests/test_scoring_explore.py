import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.operators import evaluate as V
from streamloom.operators.explore import (
    clamp_index,
    selected_page,
    viewport_counts,
    viewport_sample,
    window_overlay,
)
from streamloom.operators.select import viewport_condition


def test_metric_merge_weights_by_count(spark):
    sums = spark.createDataFrame(
        [("a", 2.0, 1.0, 2), ("b", 2.0, 1.0, 2), ("a", 18.0, 9.0, 6), ("b", 18.0, 9.0, 6), ("c", 0.0, 0.0, 0)],
        "feature string, `ce sum` double, `se sum` double, count long",
    )
    overall, per_feature = V.merge_metrics(sums)
    assert overall.first()["loss"] == 2.5
    assert {r["feature"] for r in per_feature.collect()} == {"a", "b"}
    empty, _ = V.merge_metrics(sums.filter("feature = 'c'"))
    assert tuple(empty.first()) == (0.0, None, 0)


def test_losses_match_numpy(spark):
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(6, 5)).tolist()
    target = [0.1, 0.9, 2.0, -1.0, float("nan"), 0.5]
    mask = [True, True, True, True, True, False]
    df = spark.createDataFrame(
        [("f", logits[i], target[i], mask[i], i) for i in range(6)],
        "feature string, logits array<float>, target double, mask boolean, i int",
    )
    rows = V.with_losses(df, {"f": (0.0, 1.0)}, 5).orderBy("i").collect()
    for i, r in enumerate(rows):
        z = np.array(logits[i], dtype=np.float32).astype(float)
        p = np.exp(z - z.max())
        p /= p.sum()
        assert r["prediction"] == pytest.approx((p * np.linspace(0, 1, 5)).sum(), rel=1e-6)
        assert r["valid"] == (mask[i] and math.isfinite(target[i]))
        if r["valid"]:
            place = min(max(target[i], 0.0), 1.0) * 4
            w = np.maximum(0, 1 - abs(place - np.arange(5)))
            assert r["ce"] == pytest.approx(-(w * np.log(p)).sum(), rel=1e-6)
        else:
            assert r["ce"] is None and r["se"] is None


def test_suffix_schedule(spark):
    df = spark.createDataFrame([(4, 9, 30), (5, 0, 12)], "`suffix steps` long, `roll forward` long, context long")
    rows = V.suffix_schedule(df).orderBy("`suffix steps`", "window").collect()
    assert [(r["start"], r["steps"], r["next shift"]) for r in rows] == [(0, 4, 4), (4, 4, 4), (8, 4, 1), (9, 1, 0), (0, 5, 0)]
    assert (rows[0]["target start"], rows[0]["target stop"]) == (25, 29)
    assert V.feedback_pairs(["v", "t"], ["i", "t", "v"], ["t"]) == [(1, 1)]


def test_rollout_windows(spark):
    df = spark.createDataFrame([(9, 40), (8, 40), (20, 40), (19, 40)], "anchor long, `row count` long")
    good, bad = V.rollout_windows(df, 10, 20)
    assert {(r["anchor"], r["window offset"]) for r in good.collect()} == {(9, 0), (19, 10)}
    assert {(r["anchor"], r["problem"]) for r in bad.collect()} == {
        (8, "incomplete context"),
        (20, "not enough future rows"),
    }


def test_target_time_axis(spark):
    df = spark.createDataFrame([("k", i, d) for i, d in enumerate([0.0, 2.0, 3.0])], "k string, position long, dt double")
    out = V.target_time_axis(df, ["k"], "dt").orderBy("position").collect()
    assert [r["target time"] for r in out] == [2.0, 5.0, 8.0]
    out = V.target_time_axis(df, ["k"], None).orderBy("position").collect()
    assert [r["target time"] for r in out] == [1.0, 2.0, 3.0]


def test_common_horizon(spark):
    df = spark.createDataFrame([(100,), (50,)], "`row count` long")
    assert tuple(V.common_horizon(df, 20, 40).first()) == (29, True)
    with pytest.raises(Exception, match="too short"):
        V.common_horizon(df, 60, 4).collect()


def trace(spark):
    return spark.range(10).select(
        F.lit("a").alias("trace"),
        F.col("id").cast("double").alias("x"),
        F.col("id").cast("double").alias("y"),
        (F.col("id") * 2).cast("double").alias("current"),
    )


def test_viewport(spark):
    df = trace(spark)
    args = dict(x_range=(8.0, 2.0), y_range=(3.0, 7.0))
    sample = viewport_sample(df, ["trace"], "x", "y", 3, custom=["current"], **args)
    rows = sample.orderBy("x").collect()
    assert (rows[0]["x"], rows[-1]["x"]) == (3.0, 7.0) and rows[0]["current"] == 6.0
    assert tuple(viewport_counts(df, sample, ["trace"], "x", "y", **args).first())[1:] == (5, 3, True)
    assert df.filter(viewport_condition("x", "y")).count() == 10
    with pytest.raises(ValueError):
        viewport_sample(df, ["trace"], "x", "y", 0)


def test_pages_over_traces(spark):
    rows = trace(spark).withColumn("data index", F.col("x").cast("long"))
    both = rows.unionByName(rows.withColumn("trace", F.lit("b")))
    page = selected_page(both, ["b", "a"], offset=8, limit=4).orderBy("row number").collect()
    assert [(r["trace"], r["data index"]) for r in page] == [("b", 8), ("b", 9), ("a", 0), ("a", 1)]
    with pytest.raises(ValueError):
        selected_page(both, ["a"], offset=-1)


def test_overlay_slices_and_clamp(spark):
    stream = trace(spark).withColumn("pos", F.col("x").cast("long"))
    got = window_overlay(stream, "pos", 3, 2, ["y"], "target").orderBy("pos").collect()
    assert [(r["role"], r["pos"]) for r in got] == [("target", 4), ("target", 5)]
    assert [clamp_index(i, 3) for i in (-1, 1, 9)] == [0, 1, 2] and clamp_index(4, 0) == 0
