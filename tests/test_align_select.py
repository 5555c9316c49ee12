import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamloom import columns as C
from streamloom.columns import ColumnSpec, col
from streamloom.operators import manifest as M
from streamloom.operators import select as S
from streamloom.operators.align import (
    IngestSpec,
    add_missing_columns,
    align_to_protocol,
    check_one_of_groups,
    column_catalogue,
    select_canonical,
    union_relaxed,
)
from streamloom.protocols import CYCLING, EIS, INGEST_MANIFEST, MetadataLayout, ProtocolSpec, protocol_name

SPEC = IngestSpec(
    CYCLING,
    (C.TIME.with_alias("time_s"), C.CURRENT.with_alias("Current_A"), C.VOLTAGE.with_alias("voltage_v")),
    dropped=(ColumnSpec("dropped", T.StringType(), ("junk",)),),
    flip_current_sign=True,
)


def raw(spark, names="TIME_S string, current_a string, voltage_v string, junk string, `cell id` string"):
    return spark.createDataFrame([("0.5", "1.0", "3.0", "x", "a")], names)


def test_column_specs():
    spec = ColumnSpec("canonical", T.DoubleType(), ("Raw", "raw2"))
    assert spec.matching_name(["RAW", "canonical x"]) == "RAW"
    assert spec.matching_name(["raw2", "Canonical"]) == "Canonical"
    assert spec.matching_name(["other"]) is None
    assert spec.exact_sources(["RAW", "raw2"]) == ("raw2",)
    assert spec.with_alias("x").candidates == ("canonical", "x")
    assert spec.with_values("a", "b").values == ("a", "b")


def test_align_matches_casts_flips_and_warns(spark):
    df, warnings = align_to_protocol(raw(spark), SPEC, keep=["cell id"])
    assert df.columns == ["cell id", "Time [s]", "Current [A]", "Terminal voltage [V]"]
    assert tuple(df.first()) == ("a", 0.5, -1.0, 3.0)
    assert warnings == ["left out as declared: junk"]


def test_align_errors_and_duplicates(spark):
    with pytest.raises(ValueError, match="no column for"):
        align_to_protocol(raw(spark).drop("voltage_v"), SPEC)
    with pytest.raises(ValueError, match="unknown columns"):
        align_to_protocol(raw(spark).withColumn("mystery", F.lit(1)), SPEC)
    twice = IngestSpec(CYCLING, (C.TIME.with_alias("time_s"), C.TIME.with_alias("time_s")))
    df, warnings = align_to_protocol(raw(spark).select("TIME_S"), twice)
    assert df.columns == ["Time [s]", "Time [s] 1"]
    assert "once more" in warnings[0]
    filled = add_missing_columns(raw(spark).drop("voltage_v"), SPEC.columns)
    assert align_to_protocol(filled, SPEC)[0].first()["Terminal voltage [V]"] is None


def test_one_of_groups():
    check_one_of_groups(["Impedance real [Ohm]", "IMPEDANCE IMAGINARY [OHM]"], EIS)
    with pytest.raises(ValueError):
        check_one_of_groups(["Impedance real [Ohm]", "Impedance phase [deg]"], EIS)


def test_protocols_and_layouts():
    assert protocol_name("hppc") == "HPPC" and protocol_name(EIS) == "EIS"
    with pytest.raises(ValueError):
        protocol_name("other")
    with pytest.raises(ValueError):
        ProtocolSpec("EIS", C.FREQUENCY, key_choices=((C.SOC,),), key_choice=(C.EIS_VOLTAGE,))
    layout = INGEST_MANIFEST.with_protocols([CYCLING, EIS])
    assert [c.name for c in layout.optional] == ["cell id", "cycle index", "SOC [%]"]
    with pytest.raises(ValueError, match="missing metadata"):
        layout.check(["protocol"], "manifest")


def test_select_canonical_and_union(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "a int, b double, c string")
    spec = ColumnSpec("v", T.DoubleType(), ("b", "a"))
    assert tuple(select_canonical(df, [spec, ColumnSpec("w", T.LongType())]).first()) == (2.0, None)
    other = spark.createDataFrame([(3.5, "x")], "a double, d string")
    both = union_relaxed([df, other])
    assert dict(both.dtypes) == {"a": "double", "b": "double", "c": "string", "d": "string"}
    assert both.count() == 2


def test_column_catalogue():
    out = column_catalogue({"s": [(CYCLING, (C.TIME, C.VOLTAGE)), (EIS, (C.FREQUENCY,))]})
    assert out["s"] == {
        "columns": ["Time [s]", "Terminal voltage [V]", "Frequency [Hz]"],
        "axis": ["Time [s]", "Frequency [Hz]"],
        "other": ["Terminal voltage [V]"],
    }


def manifest(spark):
    return spark.createDataFrame(
        [("cycling", "a", 1, 5, "d1"), ("cycling", "b", 1, 7, "d1"), ("HPPC", "a", 2, 9, "d1"), ("cycling", "z", 1, 1, "d2")],
        "protocol string, `cell id` string, `cycle index` long, `row count` long, `dataset id` string",
    )


def test_selection(spark):
    keys = ["cell id", "cycle index"]
    pick = lambda *a: {(r[0], r[1]) for r in S.select_manifest(manifest(spark), keys, *a).collect()}
    assert pick("cycling", {"cell id": "a"}) == {("cycling", "a")}
    assert pick(None, [{"cell id": ["a", "b"], "cycle index": 1}, {"cycle index": 2}]) == {
        ("cycling", "a"),
        ("cycling", "b"),
        ("HPPC", "a"),
    }
    assert len(pick(None, {"cell id": None})) == 4
    with pytest.raises(ValueError, match="Unknown group"):
        S.selection_condition(keys, None, {"nope": 1})
    with pytest.raises(ValueError, match="No row matched"):
        S.select_manifest(manifest(spark), keys, "RPT")
    with pytest.raises(TypeError):
        S.selection_condition(keys, None, 3)


def test_protocol_filter_modes(spark):
    with pytest.raises(ValueError, match="not found"):
        S.filter_protocols(manifest(spark), ["cycling", "HPPC"])
    assert S.filter_protocols(manifest(spark), ["cycling", "HPPC"], "available").count() == 4
    with pytest.raises(ValueError, match="not found"):
        S.filter_protocols(manifest(spark), ["HPPC"], "available")
    assert S.filter_protocols(manifest(spark), None).count() == 4
    with pytest.raises(ValueError):
        S.filter_protocols(manifest(spark), [])


def test_row_ids_and_model_columns(spark):
    ids = lambda x: S.select_row_ids(manifest(spark), "row count", x).count()
    assert (ids([5, 9]), ids([])) == (2, 0)
    S.check_model_columns(["a", "b"], ["b"], ["b"], ["a", "b"])
    for bad in (
        (["a", "a"], ["b"], [], ["a", "b"]),
        (["a"], ["b"], [], ["a"]),
        (["a"], ["b"], ["b"], ["a", "b"]),
    ):
        with pytest.raises(ValueError):
            S.check_model_columns(*bad)
    with pytest.raises(ValueError, match="EIS"):
        S.selected_protocols(manifest(spark).withColumn("protocol", F.lit("EIS")), ["EIS"])
    with pytest.raises(ValueError, match="not configured"):
        S.selected_protocols(manifest(spark), ["cycling"])


def test_dataset_ids(spark):
    with pytest.raises(ValueError, match="multiple"):
        S.with_dataset_id(manifest(spark), "x")
    bare = manifest(spark).drop("dataset id")
    assert S.with_dataset_id(bare, "type=a/dataset=q/m").first()["dataset id"] == "q"
    with pytest.raises(ValueError, match="infer"):
        S.with_dataset_id(bare, "type=a/m")
    with pytest.raises(ValueError, match="7 characters"):
        S.revision_problems(manifest(spark), {"p": "abc"})


def test_build_manifest_groups_segments(spark):
    rows = spark.createDataFrame(
        [(["a.csv"], [("a.parquet", 0, 2)], 2, "cycling", 0), (["a.csv"], [("b.parquet", 0, 3)], 3, "cycling", 1)],
        "`raw file paths` array<string>, `ingested segments` array<struct<`file path` string, `row start` long, `row count` long>>, `row count` long, protocol string, o int",
    )
    row = M.build_manifest(rows, INGEST_MANIFEST, C.INGESTED_SEGMENTS, ["o"]).first()
    assert row["row count"] == 5 and row["raw file paths"] == ["a.csv"]
    assert [tuple(s) for s in row["ingested segments"]] == [("a.parquet", 0, 2), ("b.parquet", 0, 3)]


def test_provenance_priority_and_text(spark):
    layout = MetadataLayout((C.DATASET_ID,), {C.PROCESSING_STAGE: "layout", C.GIT_STATUS: None})
    df = spark.createDataFrame([("task",)], "`processing stage` string")
    row = M.encoded_provenance(M.resolve_provenance(df, layout, {"dataset id": "d", "processing stage": "run"}), layout)
    assert tuple(row.first()) == ("d", "task", "null")
    with pytest.raises(ValueError, match="missing required"):
        M.resolve_provenance(df, layout, {})
    holes = spark.createDataFrame([(None,)], "`dataset id` string")
    with pytest.raises(Exception, match="missing required provenance"):
        M.resolve_provenance(holes, layout, {}).select(col("dataset id")).collect()


def test_manifest_kind(spark):
    tasks = spark.createDataFrame([("succeeded",), ("failed",)], "status string")
    assert M.manifest_kind(tasks) == "err_manifest"
    assert M.manifest_kind(tasks.filter("status = 'succeeded'")) == "manifest"
    assert M.manifest_kind(tasks.limit(0)) == "none"
