"""Stage plans end to end in a temporary folder."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.columns import col
from streamloom.functions.derive import CRate
from streamloom.operators.checks import BoundsCheck, MissingCheck, TimeCheck
from streamloom.operators.resample import MinMaxLTTB
from streamloom.plans.datasets import (
    POZZATO_2022,
    SYNTHETIC_M50T,
    NormalizeSpec,
    dataset,
    override_resampling,
)
from streamloom.plans.ingest import DelimitedSource, SidecarSource, ingested_rows, run_ingest
from streamloom.plans.normalize import dry_run, normalize_rows, resample_again, run_normalize
from streamloom.plans.training import training_windows, write_windows
from streamloom.operators.index import ValidationSplit, build_index
from streamloom.operators.windows import WindowSpec
from streamloom.functions.scaling import linear_scales
from streamloom.protocols import CYCLING, EIS
from streamloom.sources.tables import read_segments
from streamloom.sources.writers import available_manifests, load_manifest

PROVENANCE = {"git commit": "abcdef1234", "git status": "clean"}
T, DT, I, V = C.TIME.name, C.TIME_DIFF.name, C.CURRENT.name, C.VOLTAGE.name
RECIPE = NormalizeSpec(
    CYCLING,
    columns=(C.TIME_DIFF, C.C_RATE, C.VOLTAGE),
    constants=((C.NOMINAL_CAPACITY, 2.0),),
    transforms=(CRate(2.0),),
    checks=(MissingCheck((I, V)), TimeCheck(max_dt_s=5.0), BoundsCheck.of({V: (2.0, 5.0)})),
)


def raw_rows(n, dirty=False, start=0.0):
    rows = []
    for i in range(n):
        volts = 9.0 if dirty and i == 3 else 3.0 + i / 100
        rows.append(
            {
                "Test_Time(s)": start + i,
                "Date_Time": f"2022-01-01 00:00:{i % 60:02d}.500",
                "Current(A)": 5.0,
                "Voltage(V)": volts,
                "Aux_Temperature(¡æ)_1": 25.0,
                "Current": 1,
            }
        )
    return rows


def write_csv(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, list(rows[0]))
        w.writeheader()
        w.writerows(rows)


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    write_csv(f"{root}/Cycling_1/V4/a_Channel_1_Part1.csv", raw_rows(40))
    write_csv(f"{root}/Cycling_1/V4/a_Channel_1_Part2.csv", raw_rows(30, start=40.0))
    write_csv(f"{root}/Cycling_1/W5/b_Channel_1.csv", raw_rows(30, dirty=True))
    write_csv(f"{root}/Diag_2/lot_W5_Channel_1.csv", raw_rows(20))
    write_csv(f"{root}/.hidden/Cycling_9/V1/x.csv", raw_rows(3))
    write_csv(f"{root}/docs/README.csv", [{"a": 1}])
    spectrum = [{"Freq": 10.0**k, "Zreal": 0.01 + k / 100, "imaginary": -0.02} for k in range(5)]
    write_csv(f"{root}/EIS/t_V4_SOC50_HPPC_3.csv", spectrum)
    out = tmp_path_factory.mktemp("store")
    manifest = run_ingest(spark, DelimitedSource(POZZATO_2022), str(root), str(out), PROVENANCE)
    return str(out), manifest


def test_ingest_writes_shards_and_manifest(spark, ingested):
    out, manifest = ingested
    rows = {
        (r[C.PROTOCOL.name], r[C.CELL_ID.name], r[C.CYCLE_INDEX.name]): r for r in manifest.collect()
    }
    assert {k: r[C.ROW_COUNT.name] for k, r in rows.items()} == {
        ("cycling", "V4", 1): 70,
        ("cycling", "W5", 1): 30,
        ("RPT", "W5", 1): 20,
        ("EIS", "V4", 3): 5,
    }
    assert [os.path.basename(p) for p in rows["cycling", "V4", 1][C.RAW_PATHS.name]] == [
        "a_Channel_1_Part1.csv",
        "a_Channel_1_Part2.csv",
    ]
    assert rows["EIS", "V4", 3][C.SOC.name] == 50.0
    data = ingested_rows(spark, out, POZZATO_2022, "cycling")
    assert data.agg(F.max(col(I))).first()[0] == -5.0  # discharge sign is flipped
    assert dict(data.dtypes)[C.DATE_TIME.name] == "timestamp_ntz"
    assert data.filter(col(C.DATE_TIME.name).isNull()).isEmpty()
    v4 = data.filter(col(C.CELL_ID.name) == "V4").orderBy(col(C.ROW_POSITION.name))
    assert [r[T] for r in v4.select(col(T)).collect()] == [float(i) for i in range(70)]


def test_segments_read_back_in_order(spark, ingested):
    out, manifest = ingested
    keys = [C.PROTOCOL.name, C.CELL_ID.name, C.CYCLE_INDEX.name]
    cycling = manifest.filter("protocol = 'cycling'")
    rows = read_segments(spark, out, cycling, C.INGESTED_SEGMENTS.name, keys)
    assert rows.count() == 100
    wrong = rows.filter(F.col("`stream position`") != col(C.ROW_POSITION.name))
    assert wrong.isEmpty()


def test_normalize_published_dataset(spark, ingested, tmp_path_factory):
    out, _ = ingested
    inputs = {p: ingested_rows(spark, out, POZZATO_2022, p) for p in ("cycling", "RPT", "EIS")}
    store = str(tmp_path_factory.mktemp("norm"))
    specs = override_resampling(POZZATO_2022.normalize, {"cycling": 12, "RPT": 0.5})
    tasks = run_normalize(spark, POZZATO_2022, inputs, store, PROVENANCE, specs=specs)
    status = {(r["protocol"], r["cell id"]): (r["status"], r[C.ROW_COUNT.name]) for r in tasks.collect()}
    assert status == {
        ("cycling", "V4"): ("succeeded", 12),
        ("cycling", "W5"): ("failed", None),
        ("RPT", "W5"): ("succeeded", 10),
        ("EIS", "V4"): ("succeeded", 48),
    }
    # One failed task turns the manifest into an error manifest.
    folder = f"{store}/{POZZATO_2022.stage_root('normalized')}"
    assert os.path.exists(f"{folder}/err_manifest.parquet")
    assert not os.path.exists(f"{folder}/manifest.parquet")
    m = spark.read.parquet(f"{folder}/err_manifest.parquet")
    row = m.filter("protocol = 'cycling'").first()
    stats = {s["column"]: (s["min"], s["max"]) for s in row[C.NORMALIZED_STATS.name]}
    assert stats[C.C_RATE.name] == (-1.0, -1.0)
    assert row[C.RESAMPLING_METHOD.name] == "min_max_lttb"
    assert json.loads(row[C.RESAMPLING_PARAMS.name])["points"] == 12
    eis = spark.read.parquet(f"{folder}/data/eis").orderBy(col(C.ROW_POSITION.name)).collect()
    assert (eis[0][C.FREQUENCY.name], eis[-1][C.FREQUENCY.name]) == (1.0, 10_000.0)


def test_a_bad_spectrum_leaves_the_others_alone(spark, ingested, tmp_path_factory):
    """One stream without a positive axis range fails with its reason, also in an annotated run; the rest is written."""
    out, _ = ingested
    good = ingested_rows(spark, out, POZZATO_2022, "EIS")
    bad = good.withColumns({C.CELL_ID.name: F.lit("V9"), C.FREQUENCY.name: -col(C.FREQUENCY.name)})
    store = str(tmp_path_factory.mktemp("bad"))
    inputs = {"EIS": good.unionByName(bad)}
    tasks = run_normalize(spark, POZZATO_2022, inputs, store, PROVENANCE, annotate=True).collect()
    states = {r["cell id"]: (r["status"], r["reason"], r[C.ROW_COUNT.name], r["warnings"]) for r in tasks}
    assert states == {
        "V4": ("succeeded", None, 48, 0),
        "V9": ("failed", "log scale needs a positive axis range", None, 0),
    }
    folder = f"{store}/{POZZATO_2022.stage_root('normalized')}"
    assert spark.read.parquet(f"{folder}/data/eis").count() == 48 and os.path.exists(f"{folder}/err_manifest.parquet")
    strict = run_normalize(spark, POZZATO_2022, inputs, str(tmp_path_factory.mktemp("strict")), PROVENANCE).collect()
    assert {r["cell id"]: r["status"] for r in strict} == {"V4": "succeeded", "V9": "failed"}


def test_annotated_violations_are_warnings(spark, ingested, tmp_path_factory):
    out, _ = ingested
    inputs = {"cycling": ingested_rows(spark, out, POZZATO_2022, "cycling")}
    store = str(tmp_path_factory.mktemp("warn"))
    tasks = run_normalize(spark, POZZATO_2022, inputs, store, PROVENANCE, annotate=True, resample=False).collect()
    states = {r["cell id"]: (r["status"], r["reason"], r["warnings"]) for r in tasks}
    assert states == {"V4": ("succeeded", None, 0), "W5": ("succeeded", None, 1)}


def test_annotated_selection_builds_index_and_windows(spark, ingested, tmp_path_factory):
    out, _ = ingested
    inputs = {"cycling": ingested_rows(spark, out, POZZATO_2022, "cycling")}
    store = str(tmp_path_factory.mktemp("sel"))
    run_normalize(
        spark, POZZATO_2022, inputs, store, PROVENANCE, annotate=True, resample=False, protocols="cycling"
    )
    assert available_manifests(spark, store) == [f"{POZZATO_2022.stage_root('normalized')}/manifest.parquet"]
    path = available_manifests(spark, store)[0]
    manifest = load_manifest(spark, store, path)
    index = build_index(
        {path: manifest},
        {path: "abcdef1"},
        ["cycling"],
        validation=ValidationSplit(strategy="provide", provided=({C.CELL_ID.name: "W5"},)),
    )
    assert [(r["cell id"], r["split"]) for r in index.orderBy("__ml_index_row_id").collect()] == [
        ("V4", "train"),
        ("W5", "val"),
    ]
    with pytest.raises(ValueError, match="revision"):
        build_index({path: manifest}, {path: "1234567"})
    data = spark.read.parquet(f"{store}/{POZZATO_2022.stage_root('normalized')}/data/cycling")
    assert data.filter(col(C.ANNOTATIONS.name).isNotNull()).count() == 1
    rows = data.withColumn(C.DATASET_ID.name, F.lit(POZZATO_2022.dataset_id))
    rules = linear_scales({V: (2.0, 10.0), C.C_RATE.name: (-2.0, 2.0)})
    windows = training_windows(
        index, rows, "train", [V, C.C_RATE.name], [V], WindowSpec(2, 8), rules, [V], world_size=2
    )
    table = windows.orderBy("plan index", "lane").collect()
    assert [(r["plan index"], r["lane"], r["rank"]) for r in table] == [
        (p, lane, p % 2) for p in range(4) for lane in range(2)
    ]
    assert table[0]["inputs"][0] == pytest.approx([(3.0 - 2) / 8 * 2 - 1, -0.5])
    assert table[0]["targets"][0][0] == table[0]["inputs"][1][0]
    assert all(r["mask"] == [True] * 8 for r in table)
    with pytest.raises(ValueError, match="Scaling bounds"):
        training_windows(
            index, rows, "train", [V], [V], WindowSpec(2, 8), linear_scales({V: (3.2, 3.3)})
        )
    target = f"{store}/windows"
    write_windows(windows.withColumn(C.SPLIT.name, F.lit("train")), target)
    assert spark.read.parquet(target).filter("rank = 1").count() == 4


def test_synthetic_sources(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("syn"))
    def series(n):
        return spark.range(n).select(
            F.col("id").cast("double").alias(T),
            F.lit(1.0).alias(I),
            F.lit(0.2).alias(C.C_RATE.name),
            (F.lit(3.0) + F.col("id") / 100).alias(V),
            F.lit(25.0).alias("Auxiliary temperature [degC]"),
            F.lit(26.0).alias("Core temperature [degC]"),
            F.lit(0.0).alias("Cumulative throughput [Ah]"),
            F.lit(20.0).alias(C.AMBIENT_TEMPERATURE.name),
            F.lit(20.0).alias(C.COOLING_ALPHA.name),
        )
    series(20).toPandas().to_parquet(f"{root}/Cycling_a.parquet")
    spark.range(1, 6).select(
        F.pow(F.lit(10.0), F.col("id")).alias(C.FREQUENCY.name),
        F.lit(0.01).alias(C.Z_REAL.name),
        F.lit(-0.01).alias(C.Z_IMAGINARY.name),
    ).toPandas().to_parquet(f"{root}/EIS3p7V_a.parquet")
    meta = json.dumps({"index": {"cell_id": "U1", "cycle_index": 2, "nominal_capacity_ah": 4.85}})
    sidecar = spark.createDataFrame(
        [("Cycling_a.parquet", meta), ("EIS3p7V_a.parquet", meta)], "path string, metadata string"
    )
    store = str(tmp_path_factory.mktemp("synstore"))
    manifest = run_ingest(spark, SidecarSource(SYNTHETIC_M50T, sidecar), root, store, PROVENANCE)
    got = {r["protocol"]: (r["cell id"], r["cycle index"], r[C.EIS_VOLTAGE.name]) for r in manifest.collect()}
    assert got == {"cycling": ("U1", 2, None), "EIS": ("U1", 2, 3.7)}
    inputs = {p: ingested_rows(spark, store, SYNTHETIC_M50T, p) for p in ("cycling", "EIS")}
    tasks = run_normalize(spark, SYNTHETIC_M50T, inputs, store, PROVENANCE)
    assert {(r["protocol"], r["status"], r[C.ROW_COUNT.name]) for r in tasks.collect()} == {
        ("cycling", "succeeded", 12),
        ("EIS", "succeeded", 32),
    }


def canonical(spark, rows, extra=""):
    return spark.createDataFrame(
        rows,
        "`cell id` string, `cycle index` long, `Time [s]` double, `Current [A]` double, `Terminal voltage [V]` double",
    )


def clean(cell, n=5):
    return [(cell, 1, float(i), 1.0 + i / 10, 3.0 + i / 10) for i in range(n)]


BAD = [("bad", 1, t, c, v) for t, c, v in ((0.0, 1.0, 3.0), (1.0, None, 3.1), (1.0, 1.2, 6.0), (10.0, 1.3, 3.3))]


def test_normalize_golden(spark, chunking):
    out = normalize_rows(canonical(spark, clean("a") + clean("b")), RECIPE)
    rows = out.rows.orderBy("cell id", col(C.ROW_POSITION.name)).collect()
    assert [(r["cell id"], r[T]) for r in rows] == [(c, float(i)) for c in "ab" for i in range(4)]
    assert [r[C.C_RATE.name] for r in rows[:2]] == [0.5, 0.55]
    assert rows[0][C.NOMINAL_CAPACITY.name] == 2.0
    assert out.violations.isEmpty()


def test_strict_task_is_left_out_and_dry_run_reports(spark, chunking):
    data = canonical(spark, clean("a") + BAD)
    assert {r["cell id"] for r in normalize_rows(data, RECIPE).rows.collect()} == {"a"}
    found = {(r["cell id"], r["column"], r["reason"]) for r in dry_run(data, RECIPE).collect()}
    assert found == {
        ("bad", I, C.REASON_MISSING),
        ("bad", T, C.REASON_DUPLICATE_TIME),
        ("bad", DT, C.REASON_BIG_DT),
        ("bad", V, C.REASON_ABOVE),
    }


def test_alias_and_required_columns(spark):
    recipe = NormalizeSpec(
        CYCLING,
        columns=(C.CURRENT.with_alias("current"), C.C_RATE),
        constants=((C.NOMINAL_CAPACITY, 2.0),),
        transforms=(CRate(2.0),),
        checks=(TimeCheck(),),
    )
    data = canonical(spark, [("a", 1, 0.0, 1.0, 3.0), ("a", 1, 1.0, 2.0, 3.0), ("a", 1, 2.0, 3.0, 3.0)])
    aliased = data.withColumnRenamed(I, "current")
    rows = normalize_rows(aliased, recipe).rows.orderBy(col(T)).collect()
    assert [(r[I], r[C.NOMINAL_CAPACITY.name], r[C.C_RATE.name]) for r in rows] == [(1.0, 2.0, 0.5), (2.0, 2.0, 1.0)]
    assert recipe.required_inputs == (T, I)
    with pytest.raises(ValueError, match="missing required"):
        normalize_rows(data.drop(T), RECIPE)


def test_compensated_normalization_conserves_charge(spark, chunking):
    spec = NormalizeSpec(
        CYCLING,
        columns=(C.TIME_DIFF, C.C_RATE, C.VOLTAGE),
        transforms=(CRate(1.0),),
        checks=(TimeCheck(),),
        resampling=MinMaxLTTB(T, V, points=6),
    )
    data = canonical(spark, [("a", 1, i * 1.5, (i % 7) - 3.0, 3 + ((i * 37) % 11) / 10) for i in range(60)])
    full = normalize_rows(data, spec, resample=False).rows
    small = normalize_rows(data, spec, compensate=True).rows
    assert small.count() == 6
    charge = lambda df: df.agg(F.sum(col(DT)), F.sum(col(DT) * col(C.C_RATE.name))).first()
    assert tuple(charge(small)) == pytest.approx(tuple(charge(full)))
    assert small.agg(F.min(col(T))).first()[0] == 0.0


def test_resample_again_refuses_resampled(spark):
    spec = NormalizeSpec(CYCLING, columns=(C.VOLTAGE,), resampling=MinMaxLTTB(T, V, points=4))
    rows = normalize_rows(canonical(spark, clean("a", 20)), spec, resample=False).rows
    none = spark.createDataFrame([("none",)], "`resampling method` string")
    assert resample_again(rows, none, spec).count() == 4
    done = spark.createDataFrame([("linear",)], "`resampling method` string")
    with pytest.raises(ValueError, match="already resampled"):
        resample_again(rows, done, spec)


def test_registry_and_overrides():
    assert dataset("pozzato-2022") is POZZATO_2022
    with pytest.raises(ValueError, match="Unknown dataset"):
        dataset("nope")
    specs = {s.protocol.name: s for s in override_resampling(POZZATO_2022.normalize, {"cycling": 0.5, "EIS": 10, "RPT": None})}
    assert specs["cycling"].resampling.points_ratio == 0.5
    assert specs["EIS"].resampling.points == 10
    assert specs["RPT"].resampling is None
    assert specs["HPPC"].resampling.points == 16_384
    assert EIS.key_names == ["cell id", "cycle index", "SOC [%]"]
