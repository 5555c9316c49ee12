import math

import pytest
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.functions.derive import CRate, ImpedanceComponents
from streamloom.operators.checks import (
    AxisCheck,
    BoundsCheck,
    MissingCheck,
    TimeCheck,
    annotated_aliases,
    annotation_boundaries,
    annotation_catalogue,
    final_annotations,
    run_checks,
)
from streamloom.operators.ordered import OrderedFrame

T, DT, I, V = "Time [s]", "Time diff [s]", "Current [A]", "Terminal voltage [V]"


def reasons(row):
    return None if row["annotations"] is None else [(a["column"], a["reason"]) for a in row["annotations"]]


def stream(spark, times, **extra):
    names = list(extra)
    rows = [("a", t, i, *[extra[n][i] for n in names]) for i, t in enumerate(times)]
    schema = "`cell` string, `Time [s]` double, seq long" + "".join(f", `{n}` double" for n in names)
    return OrderedFrame.of(spark.createDataFrame(rows, schema), ["cell"], T, ["seq"])


def test_time_axis_is_rebuilt_and_annotated(spark, chunking):
    frame = stream(spark, [0.0, 1.0, 1.0, 10.0])
    rows = run_checks(frame, [TimeCheck(T, DT, max_dt_s=5.0)]).annotated().orderBy("seq").collect()
    assert [r[T] for r in rows] == [0.0, 1.0]
    assert [r["seq"] for r in rows] == [0, 2]  # the last duplicate survives
    assert reasons(rows[0]) is None
    assert reasons(rows[1]) == [(T, C.REASON_DUPLICATE_TIME), (DT, C.REASON_BIG_DT)]


def test_one_row_and_null_times(spark, chunking):
    assert run_checks(stream(spark, [3.0]), [TimeCheck(T, DT)]).annotated().count() == 0
    rows = run_checks(stream(spark, [None, 5.0, 7.0, float("nan")]), [TimeCheck(T, DT)])
    assert [r[T] for r in rows.annotated().collect()] == [0.0]


def test_bad_limits_are_refused():
    with pytest.raises(ValueError):
        TimeCheck(T, DT, max_dt_s=0.0)


def test_missing_and_bounds(spark):
    frame = stream(spark, [0.0, 1.0, 2.0], **{I: [1.0, None, math.nan], V: [6.0, 3.0, math.nan]})
    checks = [MissingCheck((I, "absent")), BoundsCheck.of({V: (2.0, 5.0), "absent": (0.0, 1.0)})]
    rows = run_checks(frame, checks).annotated().orderBy("seq").collect()
    assert [reasons(r) for r in rows] == [
        [(V, C.REASON_ABOVE)],
        [(I, C.REASON_MISSING)],
        [(I, C.REASON_MISSING)],
    ]


def test_axis_check_after_zero_replacement(spark, chunking):
    # File order is kept by ordering on the row number.
    df = spark.createDataFrame(
        [("a", i, f) for i, f in enumerate([0.0, 1.0, 1.0, -1.0])], "cell string, seq long, `f` double"
    )
    frame = OrderedFrame.of(df, ["cell"], "seq")
    out = run_checks(frame, [AxisCheck("f", zero_replacement=0.1, enforce_positive=True)])
    rows = out.annotated().orderBy("seq").collect()
    assert [r["f"] for r in rows] == [0.1, 1.0, 1.0, -1.0]
    assert [reasons(r) is not None for r in rows] == [False, False, True, True]


def test_axis_check_keeps_order_of_its_own_axis(spark, chunking):
    frame = OrderedFrame.of(
        spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 2.0)], "cell string, f double"), ["cell"], "f"
    )
    rows = run_checks(frame, [AxisCheck("f", 1e-7, True)]).annotated().collect()
    assert sorted(r["f"] for r in rows) == [1e-7, 2.0, 2.0]
    assert sum(r["annotations"] is not None for r in rows) == 1


def test_violations_see_rows_dropped_later(spark, chunking):
    # The duplicate that is dropped carries the only missing value.
    frame = stream(spark, [0.0, 1.0, 1.0, 2.0], **{V: [3.0, None, 3.0, 3.0]})
    checked = run_checks(frame, [MissingCheck((V,)), TimeCheck(T, DT), BoundsCheck.of({V: (2.0, 5.0)})])
    found = {(r["column"], r["reason"]) for r in checked.violations().collect()}
    assert found == {(V, C.REASON_MISSING), (T, C.REASON_DUPLICATE_TIME)}
    assert checked.strict().count() == 0


def test_strict_keeps_clean_tasks(spark, chunking):
    df = spark.createDataFrame(
        [("good", 0.0, 0), ("good", 1.0, 1), ("good", 2.0, 2), ("bad", 0.0, 3), ("bad", 0.0, 4), ("bad", 1.0, 5)],
        "cell string, `Time [s]` double, seq long",
    )
    checked = run_checks(OrderedFrame.of(df, ["cell"], T, ["seq"]), [TimeCheck(T, DT)])
    rows = checked.strict().orderBy("seq").collect()
    assert [(r["cell"], r[T]) for r in rows] == [("good", 0.0), ("good", 1.0)]


def test_ordered_check_after_drop_sees_kept_rows(spark, chunking):
    frame = stream(spark, [0.0, 1.0, 1.0, 2.0])
    checked = run_checks(frame, [TimeCheck(T, DT), AxisCheck(T)])
    rows = checked.annotated().orderBy("seq").collect()
    assert [r["seq"] for r in rows] == [0, 2]
    found = {(r["column"], r["reason"]) for r in checked.violations().collect()}
    assert found == {(T, C.REASON_DUPLICATE_TIME)}


def test_annotation_list_is_whole_unless_a_length_is_given(spark):
    df = spark.range(1).select(
        F.array(*[F.struct(F.lit(str(i)).alias("column"), F.lit("r").alias("reason")) for i in range(20)]).alias("a")
    )
    assert len(df.select(final_annotations(F.col("a"))).first()[0]) == 20
    assert len(df.select(final_annotations(F.col("a"), 16)).first()[0]) == 16


def test_catalogue_aliases_and_boundaries(spark, chunking):
    anns = [None, [("Terminal voltage [V]", "missing")], [("Terminal voltage [V]", "missing")], None]
    df = spark.createDataFrame(
        [("a", float(i), 3.0 + i / 10, a) for i, a in enumerate(anns)],
        "cell string, `Time [s]` double, `Terminal voltage [V]` double, annotations array<struct<column string, reason string>>",
    )
    assert [tuple(r) for r in annotation_catalogue(df).collect()] == [(V, "missing")]
    by_reason = annotated_aliases(annotation_catalogue(df), C.VOLTAGE).collect()
    assert [(r["reason"], r["columns"]) for r in by_reason] == [("missing", [V])]
    frame = OrderedFrame.of(df, ["cell"], T)
    rows = annotation_boundaries(frame, T, V, [V], "missing").orderBy(f"`{T}`").collect()
    assert [(r[T], r[V]) for r in rows] == [(1.0, 3.1), (2.0, 3.2)]


def test_c_rate_fills_only_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 9.0)], "`Current [A]` double, `Current [C-rate]` double")
    assert [r[1] for r in CRate(2.0)(df).collect()] == [0.5, 9.0]
    assert CRate(2.0)(df.select("`Current [C-rate]`")).columns == ["Current [C-rate]"]


def test_impedance_both_ways(spark):
    rect = spark.createDataFrame([(3.0, 4.0)], "`Impedance real [Ohm]` double, `Impedance imaginary [Ohm]` double")
    row = ImpedanceComponents()(rect).first()
    assert row["Impedance magnitude [Ohm]"] == 5.0
    assert row["Impedance phase [deg]"] == pytest.approx(53.13010235415598)
    polar = spark.createDataFrame([(5.0, 53.13010235415598)], "`Impedance magnitude [Ohm]` double, `Impedance phase [deg]` double")
    row = ImpedanceComponents()(polar).first()
    assert (row["Impedance real [Ohm]"], row["Impedance imaginary [Ohm]"]) == pytest.approx((3.0, 4.0))
    with pytest.raises(ValueError):
        ImpedanceComponents()(spark.range(1))
