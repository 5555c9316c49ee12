import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.operators import ordered as o
from streamloom.operators.joins import key_join, spread_join
from streamloom.operators.ranking import digest, digest_rank, total_order_position


def scans():
    some = F.when(F.col("value") > 20, F.col("value"))
    return {
        "p": o.position(),
        "n": o.total(),
        "lg": o.lag(some),
        "ld": o.lead(F.col("event_id")),
        "rs": o.running_sum(F.col("event_id")),
        "lv": o.last_valid(some),
        "nv": o.next_valid(some),
        "fv": o.first_valid(some),
    }


def test_chunked_scan_equals_plain_window(events):
    # One key holds most rows and most of its axis values repeat.
    df = events.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, F.col("user_id")).otherwise(-1))
    df = df.withColumn("axis", F.when(F.col("value") > 5, F.hour("ts").cast("double")))
    plain = o.OrderedFrame.of(df, ["user_id"], "axis", ["event_id"]).scan(scans())
    assert not plain.split
    for bound in (5, 64):
        cut = o.OrderedFrame.of(df, ["user_id"], "axis", ["event_id"], max_rows=bound).scan(scans())
        assert cut.split
        assert cut.result.exceptAll(plain.result).count() == 0
        assert plain.result.exceptAll(cut.result).count() == 0


@pytest.mark.parametrize("kind", ["decimal(12,2)", "decimal(30,4)", "timestamp", "timestamp_ntz", "date", "float", "int"])
def test_every_axis_type_and_null_ties_are_cut_alike(spark, kind):
    n = 400
    value = {"timestamp": "timestamp_millis(x div 3)", "timestamp_ntz": "cast(timestamp_millis(x div 3) as timestamp_ntz)", "date": "date_from_unix_date(x div 9)"}
    axis = value.get(kind, f"cast(x / 7 as {kind})")
    df = spark.range(n).selectExpr("id", "(id * 37) % 211 AS x").selectExpr(
        "id % 2 AS k", f"if(id % 13 = 0, null, {axis}) AS axis", "if(id % 3 = 0, null, 1000 - id) AS tie", "id AS value", "id AS event_id"
    )
    plain = o.OrderedFrame.of(df, ["k"], "axis", ["tie", "event_id"]).scan(scans())
    cut = o.OrderedFrame.of(df, ["k"], "axis", ["tie", "event_id"], max_rows=11).scan(scans())
    assert cut.split and not plain.split
    assert sorted(map(repr, cut.result.collect())) == sorted(map(repr, plain.result.collect()))


def test_chunks_are_bounded(events):
    cut = o.OrderedFrame.of(events.withColumn("k", F.lit(1)), ["k"], "value", ["event_id"], max_rows=50)
    biggest = cut.df.groupBy("k", o.CHUNK).count().agg(F.max("count")).first()[0]
    assert biggest <= 50 * 6


def test_null_keys_are_a_stream(spark):
    df = spark.createDataFrame([(None, float(i), i) for i in range(20)], "k string, x double, i long")
    frame = o.OrderedFrame.of(df, ["k"], "x", ["i"], max_rows=3).scan({"p": o.position()})
    assert [r["p"] for r in frame.result.orderBy("i").collect()] == list(range(20))


def test_digest_rank_is_a_permutation_in_digest_order(events):
    ranked = digest_rank(events.withColumn("d", digest(F.lit(7), F.col("event_id"))), "d", ["event_id"], "r", "n")
    rows = ranked.orderBy("d").select("r", "n").collect()
    assert [r["r"] for r in rows] == list(range(len(rows)))
    assert {r["n"] for r in rows} == {len(rows)}


def test_total_order_position_matches_sort(events):
    order = ["event_type", "user_id", "event_id"]
    rows = total_order_position(events, order, "p").orderBy(*order).select("p").collect()
    assert [r["p"] for r in rows] == list(range(len(rows)))


def test_spread_join_equals_key_join(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else "a", i) for i in range(50)], "k string, v long")
    names = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, n int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = key_join(rows, names.filter("n < 3"), ["k"], how)
        spread = spread_join(rows, names.filter("n < 3"), ["k"], F.col("v"), how)
        assert plain.columns == spread.columns
        assert plain.exceptAll(spread).isEmpty() and spread.exceptAll(plain).isEmpty()


def test_whole_table_as_one_stream(events):
    for bound in (100, 10**6):
        frame = o.OrderedFrame.of(events, [], "event_id", max_rows=bound).scan({"p": o.position()})
        assert frame.split == (bound == 100)
        assert frame.result.filter("p <> event_id").isEmpty()


def test_running_sums_have_equal_bits_whole_and_cut(spark):
    """Sums of doubles of all sizes are the same to the last bit however a stream is cut, and right."""
    rng = np.random.default_rng(3)
    values = {
        "mixed": rng.normal(size=2000) * 10.0 ** rng.integers(-12, 12, 2000),
        "tenth": np.full(2000, 0.1),
        "huge": rng.normal(size=50) * 1e307,
        "tiny": rng.normal(size=50) * 1e-300,
        "odd": np.array([1.0, np.nan, 2.0]),
        "inf": np.array([1.0, np.inf, -3.0]),
        "none": np.array([0.0, 0.0]),
    }
    rows = [(k, i, float(v)) for k, vs in values.items() for i, v in enumerate(vs)] + [("tenth", 5000, None)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(5)
    sums = {}
    for bound in (2_000_000, 40):
        frame = o.OrderedFrame.of(df, ["k"], "i", [], max_rows=bound).scan({"s": o.running_sum(F.col("v")), "n": o.position()})
        got = frame.result.collect()
        assert frame.result.columns == ["k", "i", "v", "s", "n"]
        sums[bound] = {(r["k"], r["i"]): r["s"].hex() for r in got}
    assert sums[2_000_000] == sums[40]
    for k, vs in values.items():
        for i in (0, len(vs) // 2, len(vs) - 1):
            exact = math.fsum(vs[: i + 1]) if np.isfinite(vs[: i + 1]).all() else sum(vs[: i + 1])
            assert float.fromhex(sums[40][k, i]) == pytest.approx(exact, rel=1e-15, abs=0, nan_ok=True)
    assert sums[40]["tenth", 5000] == sums[40]["tenth", 1999] == (200.0).hex()


def test_cut_streams_are_numbered_dealt_and_sorted_once(events):
    """What a scan adds to the plan reads the rows where they lie: no second numbering, exchange or sort of them."""
    frame = o.OrderedFrame.of(events, ["user_id"], "value", ["event_id"], max_rows=4)
    plan = frame._scan({"p": o.position()}).df._jdf.queryExecution().sparkPlan().toString()
    assert frame.split and "Python" not in plan
    placed = frame.df.withColumn("n", F.row_number().over(frame.window))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan


def test_chunk_numbers_of_many_keys():
    rng = np.random.default_rng(5)
    axis = [-np.inf, 1.0, 2.0, np.inf, np.nan]
    cut = sorted({(int(h), int(a), int(t)) for h, a, t in zip(*(rng.integers(0, n, 900) for n in (60, 5, 9)), strict=True)})
    h, a, t = (rng.integers(low, high, 2000) for low, high in ((-1, 62), (0, 5), (-1, 10)))
    table = o.pd.DataFrame([(k, axis[x], y) for k, x, y in cut], columns=["h", "a", "t"])
    cuts = o.Cuts.of(table.sample(frac=1, random_state=1))
    got = o.chunk_numbers(h, np.array(axis)[a], t, cuts.keys, cuts.starts, cuts.axis, cuts.tie)
    assert got.tolist() == [sum(k == x[0] and x[1:] <= (y, z) for x in cut) for k, y, z in zip(h, a, t, strict=True)]
