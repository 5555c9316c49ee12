import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.operators.checks import AxisCheck, BoundsCheck, MissingCheck, TimeCheck, run_checks
from streamloom.operators.ordered import OrderedFrame
from streamloom.streaming.checks import (
    annotated_time_check,
    axis_flags,
    rebuild_rows,
    stream_axis_check,
    stream_row_checks,
    stream_time_check,
)
from streamloom.streaming.reorder import PROVIDER, reordered_time_check


def chunks(times, late="drop", limit=5.0):
    pending, dup, elapsed, dropped, out = None, False, 0.0, 0, []
    for part in times:
        rows = pd.DataFrame({"t": part})
        emit, pending, dup, elapsed, n = rebuild_rows(rows, pending, dup, elapsed, "t", "dt", limit, late)
        dropped += n
        out += list(zip(emit["t"], emit["dt"], emit["__duplicate"], emit["__big_dt"])) if len(emit) else []
    return out, dropped


def test_newest_row_waits():
    assert chunks([[0.0]])[0] == []
    assert [r[0] for r in chunks([[0.0], [1.0, 2.0]])[0]] == [0.0, 1.0]


def test_duplicate_flag_survives_the_chunk_edge():
    whole, _ = chunks([[0.0, 1.0, 1.0, 10.0]])
    split, _ = chunks([[0.0, 1.0, 1.0], [10.0]])
    assert whole == split == [(0.0, 1.0, False, False), (1.0, 9.0, True, True)]
    assert chunks([[0.0, 1.0], [1.0, 3.0]])[0] == [(0.0, 1.0, False, False), (1.0, 2.0, True, False)]


def test_late_rows():
    rows, dropped = chunks([[0.0, 5.0], [3.0, 10.0]], limit=None)
    assert ([r[0] for r in rows], dropped) == ([0.0, 5.0], 1)
    rows, dropped = chunks([[0.0, 5.0], [3.0, 10.0]], late="reference", limit=None)
    # The row before the late one loses its step, the late one stays.
    assert [(r[0], r[1]) for r in rows] == [(0.0, 5.0), (5.0, 7.0)] and dropped == 0


def test_axis_flags_over_chunks():
    check = AxisCheck("f", 0.1, True)
    v, bad, prev = axis_flags(np.array([0.0, 1.0]), None, check)
    assert (v.tolist(), bad.tolist(), prev) == ([0.1, 1.0], [False, False], 1.0)
    v, bad, prev = axis_flags(np.array([1.0, -1.0, np.nan]), prev, check)
    assert (bad.tolist(), prev) == ([True, True, True], -1.0)


SCHEMA = "cell string, `Time [s]` double, seq long, `Cooling alpha [W.m-2.K-1]` double"


def run_in_batches(spark, folder, batches, transform):
    """Feed batches one micro-batch at a time through a file stream."""
    source, sink = f"{folder}/in", f"{folder}/out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = transform(spark.readStream.schema(SCHEMA).parquet(source))
        query = (
            stream.writeStream.format("parquet")
            .option("path", sink)
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.parquet(sink)


def batches():
    rng = np.random.default_rng(5)
    t = {c: 0.0 for c in "ab"}
    out, seq = [], 0
    for _ in range(3):
        rows = []
        for _ in range(20):
            c = "ab"[rng.integers(2)]
            t[c] += float(rng.integers(0, 4))
            rows.append((c, t[c], seq, 20.0))
            seq += 1
        out.append(rows)
    return out


def test_stream_equals_batch(spark, tmp_path):
    check = TimeCheck(max_dt_s=2.0)
    key, ties = ["cell"], ["seq"]
    got = run_in_batches(
        spark, str(tmp_path), batches(), lambda s: annotated_time_check(stream_time_check(s, key, check, ties), check)
    )
    rows = spark.createDataFrame([r for b in batches() for r in b], SCHEMA)
    want = run_checks(OrderedFrame.of(rows, key, C.TIME.name, ties), [check]).annotated()
    want = want.select(*[F.col(f"`{c}`") for c in got.columns])
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stream_axis_equals_batch(spark, tmp_path):
    check = AxisCheck(C.TIME.name, 1e-7, True)
    got = run_in_batches(spark, str(tmp_path), batches(), lambda s: stream_axis_check(s, ["cell"], check, ["seq"]))
    rows = spark.createDataFrame([r for b in batches() for r in b], SCHEMA)
    frame = OrderedFrame.of(rows, ["cell"], "seq")
    want = run_checks(frame, [check]).annotated().select("seq", F.col("annotations").isNotNull().alias("bad"))
    assert got.select("seq", F.col("__invalid_axis").alias("bad")).exceptAll(want).isEmpty()


def test_row_checks_and_options(spark, tmp_path):
    checks = [MissingCheck((C.TIME.name,)), BoundsCheck.of({C.TIME.name: (1.0, None)})]
    got = run_in_batches(
        spark, str(tmp_path), [[("a", None, 0, 1.0), ("a", 0.5, 1, 1.0)], [("a", 2.0, 2, 1.0)]], lambda s: stream_row_checks(s, checks)
    )
    found = {r["seq"]: None if r["annotations"] is None else [a["reason"] for a in r["annotations"]] for r in got.collect()}
    assert found == {0: [C.REASON_MISSING], 1: [C.REASON_BELOW], 2: None}
    with pytest.raises(ValueError):
        stream_time_check(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["cell"], late="never")


def test_late_and_timeless_rows_are_put_out(spark, tmp_path):
    check = TimeCheck(max_dt_s=None)
    parts = [[("a", 0.0, 0, 1.0), ("a", 5.0, 1, 1.0)], [("a", 3.0, 2, 1.0), ("a", None, 3, 1.0)], [("a", 9.0, 4, 1.0), ("a", 4.0, 5, 1.0)]]
    got = run_in_batches(spark, str(tmp_path), parts, lambda s: annotated_time_check(stream_time_check(s, ["cell"], check, ["seq"]), check))
    found = {r["seq"]: (r[C.TIME.name], [a["reason"] for a in r["annotations"] or []]) for r in got.collect()}
    assert found == {0: (0.0, []), 1: (5.0, []), 2: (3.0, ["late row"]), 3: (None, ["missing time"]), 5: (4.0, ["late row"])}


REORDERED = "cell string, `Time [s]` double, seq long, ts timestamp"


def reordered(spark, folder, batches, **options):
    """Rows (cell, time, seq) in files of one micro-batch each, through one query."""
    spark.conf.set(*PROVIDER)
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "cell string, `Time [s]` double, seq long")
        df = df.withColumn("ts", F.timestamp_seconds(F.coalesce(F.col("`Time [s]`"), F.lit(0.0)) + 1000))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in/part={k:03d}")
    stream = spark.readStream.schema(REORDERED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    check = TimeCheck("Time [s]", "dt", 5.0)
    out = reordered_time_check(stream, ["cell"], check, "ts", ["seq"], **options)
    query = (
        out.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark.conf.unset(PROVIDER[0])
    data = [p for p in query.recentProgress if p["numInputRows"]]
    return spark.read.parquet(f"{folder}/out").collect(), data


def test_rows_out_of_order_take_their_place(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(c, float(i if i % 7 else i + 1), i) for i in range(60) for c in "ab"]
    arrival = sorted(rows, key=lambda r: r[1] + 6 * rng.random())
    got, progress = reordered(spark, tmp_path, [arrival[i : i + 25] for i in range(0, 120, 25)], delay_s=8.0, grace="1 hour")
    assert len(progress) == 5
    df = spark.createDataFrame(rows, "cell string, `Time [s]` double, seq long")
    checked = run_checks(OrderedFrame.of(df, ["cell"], "Time [s]", ["seq"]), [TimeCheck("Time [s]", "dt", 5.0)])
    want = {(r["cell"], r["seq"]): (r["Time [s]"], r["dt"]) for r in checked.annotated().collect()}
    have = {(r["cell"], r["seq"]): (r["Time [s]"], r["dt"]) for r in got}
    assert all(r["__late"] is None for r in got) and len(have) == len(got)
    # What the last delay covers still waits.
    assert have == {k: v for k, v in want.items() if k in have} and len(have) >= len(want) - 24


def test_ended_keys_late_rows_and_missing_times(spark, tmp_path):
    batches = [
        [("a", float(i), i) for i in range(5)] + [("b", 0.0, 0), ("b", None, 99)],
        [("b", 40.0, 1), ("b", 41.0, 2)],
        [("b", 35.0, 3), ("b", 90.0, 4), ("b", 91.0, 5)],
        [("b", 200.0, 6), ("a", 190.0, 7)],
        [("b", 300.0, 8)],
    ]
    got, progress = reordered(spark, tmp_path, batches, delay_s=1.0, idle_s=20.0, grace="10 seconds")
    assert len(progress) == 5
    rows = {(r["cell"], r["seq"]): (r["Time [s]"], r["dt"], r["__late"]) for r in got}
    assert [rows["a", i][:2] for i in range(4)] == [(float(i), 1.0) for i in range(4)]
    assert rows["a", 4][0] == 4.0 and rows["a", 4][2] == "end of stream"
    assert rows["b", 99][2] == "missing time" and rows["b", 3][0] == 35.0 and rows["b", 3][2] == "late row"
    assert rows["b", 0] == (0.0, 40.0, None)
    # The key that came back is a stream of its own; it has ended too.
    assert rows["a", 7][0] == 190.0 and rows["a", 7][2] == "end of stream"


def test_many_keys_share_few_states(spark, tmp_path):
    """Keys of one bucket are one state and do not see each other; a null among whole numbers leaves the others exact."""
    big = 2**60
    keys = [None, *[big + k for k in range(40)]]
    rows = [(k, float(i), big + i if (n + i) % 5 else None) for n, k in enumerate(keys) for i in range(12)]
    spark.conf.set(*PROVIDER)
    for part in range(2):  # the second file brings what is left of every key, in another order
        chosen = [r for r in rows if (r[1] < 6) == (part == 0)][:: 1 - 2 * part]
        df = spark.createDataFrame(chosen, "cell long, `Time [s]` double, seq long").withColumn("ts", F.timestamp_seconds(F.col("`Time [s]`") + 1000))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    schema = "cell long, `Time [s]` double, seq long, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = reordered_time_check(stream, ["cell"], TimeCheck("Time [s]", "dt", 5.0), "ts", ["seq"], 2.0, buckets=3)
    assert out.columns[:4] == ["cell", "Time [s]", "seq", "ts"]
    writer = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    spark.conf.unset(PROVIDER[0])
    # Heads, keys, the timer and the waiting rows of three buckets, whatever the number of keys.
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] < len(keys)
    got = sorted((str(r["cell"]), r["Time [s]"], str(r["seq"]), r["dt"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((str(k), t, str(s), 1.0) for k, t, s in rows if t < 9.0)
