import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.operators.ordered import OrderedFrame
from streamloom.operators.resample import (
    GridResampling,
    MinMaxLTTB,
    compensated,
    lttb_positions,
)

Y = [0, 1, 0.5, 3, 2, 5, 4, 7, 6, 9]


def trace(spark, n=10, y=Y, key="a"):
    return spark.createDataFrame(
        [(key, float(i), None if y[i] is None else float(y[i]), f"r{i}") for i in range(n)],
        "k string, x double, y double, label string",
    )


def kept(df):
    return [int(r["x"]) for r in df.orderBy("x").collect()]


def test_budget(spark):
    n = spark.range(1).select(F.lit(10).alias("n"))
    value = lambda spec: n.select(spec.budget(F.col("n"))).first()[0]
    assert value(MinMaxLTTB("x", "y", points=3)) == 3
    assert value(MinMaxLTTB("x", "y", points_ratio=0.5)) == 5
    assert value(MinMaxLTTB("x", "y", points=2, points_ratio=0.5)) == 3
    assert value(MinMaxLTTB("x", "y", points=40)) == 10
    for bad in (MinMaxLTTB("x", "y"), MinMaxLTTB("x", "y", points=0), MinMaxLTTB("x", "y", points_ratio=0.0)):
        with pytest.raises(ValueError):
            bad.budget(F.col("n"))


def test_golden_selection(spark, chunking):
    assert kept(MinMaxLTTB("x", "y", points=4).apply(trace(spark), ["k"])) == [0, 4, 5, 9]


@pytest.mark.parametrize(("points", "expected"), [(1, [0]), (2, [0, 9]), (10, list(range(10)))])
def test_small_and_full_budgets(spark, points, expected):
    spec = MinMaxLTTB("x", "y", points=points, min_points=1)
    assert kept(spec.apply(trace(spark), ["k"])) == expected


def test_non_finite_rows(spark):
    y = [0, 1, None, 3, float("nan"), 5, 4, 7, 6, 9]
    assert kept(MinMaxLTTB("x", "y", points=8).apply(trace(spark, y=y), ["k"])) == [0, 1, 3, 5, 6, 7, 8, 9]
    assert kept(MinMaxLTTB("x", "y", points=10).apply(trace(spark, y=y), ["k"])) == list(range(10))


def test_repeated_rows_stay_without_ties(spark):
    rows = [("a", 1.0, 2.0, "same")] * 3 + [("a", 1.0, 2.0, "other"), ("a", 2.0, 2.0, "end")]
    df = spark.createDataFrame(rows, "k string, x double, y double, label string")
    assert sorted(r["label"] for r in MinMaxLTTB("x", "y", points=9).apply(df, ["k"]).collect()) == [
        "end",
        "other",
        "same",
        "same",
        "same",
    ]


def wave(n, seed):
    rng = np.random.default_rng(seed)
    return np.cumsum(rng.normal(size=n))


def test_blocks_equal_single_fold(spark, chunking):
    frames, expected = [], {}
    for key, n in (("a", 200), ("b", 37), ("c", 64)):
        y = wave(n, n)
        frames.append(trace(spark, n, list(y), key))
        expected[key] = lttb_positions(np.arange(n, dtype=float), y, 60).tolist()
    df = frames[0].unionByName(frames[1]).unionByName(frames[2])
    for size in (4, 7, 65536):
        out = MinMaxLTTB("x", "y", points=60, block_buckets=size).apply(df, ["k"])
        got = {k: kept(out.filter(F.col("k") == k)) for k in expected}
        assert got == expected


def test_preselection_keeps_extremes_and_matches_two_steps(spark):
    n, points = 1000, 20
    y = wave(n, 1)
    spec = MinMaxLTTB("x", "y", points=points)
    df = trace(spark, n, list(y))
    cand = sorted(int(r["x"]) for r in spec.candidates(df, ["k"]).collect())
    bins = points * 2
    width = (n - 1) / bins
    number = np.minimum(bins - 1, np.floor(np.arange(1, n - 1) / width))
    want = {0, n - 1}
    for b in range(bins):
        rows = np.flatnonzero(number == b) + 1
        want |= {int(rows[y[rows].argmin()]), int(rows[y[rows].argmax()])}
    assert cand == sorted(want)
    x = np.array(cand)
    assert kept(spec.apply(df, ["k"])) == x[lttb_positions(x.astype(float), y[x], points)].tolist()


def test_linear_grid(spark):
    df = spark.createDataFrame([("k", 0.0, 0.0, "a"), ("k", 2.0, 4.0, "b")], "k string, x double, y double, label string")
    rows = GridResampling("x", 3).apply(df, ["k"]).orderBy("x").collect()
    assert [(r["x"], r["y"], r["label"]) for r in rows] == [(0.0, 0.0, "a"), (1.0, 2.0, "a"), (2.0, 4.0, "b")]


def numpy_grid(x, y, grid):
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    out = np.interp(grid, x, y)
    left, right = grid < x[0], grid > x[-1]
    out[left] = y[0] + (y[1] - y[0]) / (x[1] - x[0]) * (grid[left] - x[0])
    out[right] = y[-1] + (y[-1] - y[-2]) / (x[-1] - x[-2]) * (grid[right] - x[-1])
    return out


@pytest.mark.parametrize("scale", ["linear", "log"])
@pytest.mark.parametrize("value_range", [None, (0.5, 40.0)])
def test_grid_matches_numpy(spark, scale, value_range):
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(1, 30, 25))
    y = rng.normal(size=25)
    y[[0, 7, 24]] = np.nan
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    rows = GridResampling("x", 17, scale, value_range).apply(df, ["k"]).orderBy("x").collect()
    lo, hi = value_range or (x[0], x[-1])
    grid = np.linspace(lo, hi, 17) if scale == "linear" else np.logspace(np.log10(lo), np.log10(hi), 17)
    assert [r["x"] for r in rows] == pytest.approx(grid)
    assert [r["y"] for r in rows] == pytest.approx(numpy_grid(x, y, grid), rel=1e-9, abs=1e-9)


def test_grid_duplicates_keep_last_and_constants(spark):
    df = spark.createDataFrame(
        [("k", 0.0, 1.0, 0, None), ("k", 0.0, 5.0, 1, None), ("k", 1.0, None, 2, None), ("k", None, 9.0, 3, 1.0)],
        "k string, x double, y double, seq long, z double",
    )
    rows = GridResampling("x", 2).apply(df, ["k"], ["seq"]).orderBy("x").collect()
    assert [(r["x"], r["y"]) for r in rows] == [(0.0, 5.0), (1.0, 5.0)]
    assert all(np.isnan(r["z"]) for r in rows)


def test_grid_errors(spark):
    for args in (("x", 0), ("x", 3, "cubic"), ("x", 3, "linear", (2.0, 1.0)), ("x", 3, "log", (0.0, 1.0))):
        with pytest.raises(ValueError):
            GridResampling(*args)
    df = spark.createDataFrame([("k", 0.0, 0.0), ("k", 1.0, 0.0)], "k string, x double, y double")
    with pytest.raises(Exception, match="positive axis range"):
        GridResampling("x", 3, "log").apply(df, ["k"]).collect()


def test_compensation(spark, chunking):
    dt = [1.0, 2.0, 3.0, 4.0, 0.0, 5.0]
    s = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]
    df = spark.createDataFrame(
        [("k", i, float(i), dt[i], s[i], i in (1, 3, 4)) for i in range(6)],
        "k string, i long, t double, dt double, s double, keep boolean",
    )
    frame = OrderedFrame.of(df, ["k"], "i")
    rows = compensated(frame, F.col("keep"), "dt", "t", "s").orderBy("i").collect()
    assert [r["dt"] for r in rows] == pytest.approx([5.0, 4.0, 5.0])
    assert [r["t"] for r in rows] == pytest.approx([0.0, 5.0, 9.0])
    assert [r["s"] for r in rows] == pytest.approx([(40 + 90) / 5, 40.0, 60.0])


def test_compensation_has_equal_bits_whole_and_cut(spark, events):
    rows = events.select("user_id", "event_id", F.col("event_id").cast("double").alias("t"), "value")
    rows = rows.withColumn("user_id", F.col("user_id") % 2).withColumns({"dt": F.rand(3) / 3, "keep": F.col("event_id") % 5 == 1})
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    got = []
    for bound in (2_000_000, 60):
        frame = OrderedFrame.of(rows, ["user_id"], "t", ["event_id"], max_rows=bound)
        assert frame.split == (bound == 60)
        out = compensated(frame, F.col("keep"), "dt", "t", "value").select("event_id", "dt", F.col("t").cast("double"), "value")
        got.append(sorted((r[0], *(x.hex() for x in tuple(r)[1:])) for r in out.collect()))
    assert got[0] == got[1] and len(got[0]) > 100
