"""Composite jobs and streaming runs on the events."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scenarios.common import E, INDEX, events, query, reason_text, rounded, stream_index, table
from scenarios.ingesting import exact_names
from scenarios.quality import BIG, LEAD, CHECKS
from scenarios.training import DIGEST_SQL, GROUP_SQL, STREAM, STREAM_SQL
from streamloom import columns as C
from streamloom.columns import col
from streamloom.functions.derive import CRate
from streamloom.functions.scaling import Scale
from streamloom.functions.values import epoch_seconds
from streamloom.operators.checks import AxisCheck, BoundsCheck, MissingCheck, TimeCheck
from streamloom.operators.index import ValidationSplit, build_index
from streamloom.operators.joins import key_join
from streamloom.operators.ordered import OrderedFrame, position
from streamloom.operators.windows import WindowSpec
from streamloom.operators.resample import MinMaxLTTB, no_resampling_metadata
from streamloom.plans.datasets import DatasetSpec, NormalizeSpec, override_resampling
from streamloom.plans.normalize import dry_run, normalize_rows, resample_again, run_normalize
from streamloom.plans.training import training_windows
from streamloom.protocols import CYCLING
from streamloom.session import checkpoint_dir, written
from streamloom.sources.tables import read_table, stage_segments
from streamloom.sources.writers import available_manifests, load_manifest, write_table_once
from streamloom.streaming.reorder import PROVIDER, reordered_time_check
from streamloom.streaming.checks import (
    annotated_time_check,
    stream_axis_check,
    stream_overlay_time,
    stream_row_checks,
    stream_time_check,
)

LIMIT = 200_000.0
RECIPE = NormalizeSpec(
    CYCLING,
    columns=(C.TIME_DIFF, C.C_RATE, C.VOLTAGE.with_alias("volts")),
    constants=((C.NOMINAL_CAPACITY, 2.0),),
    transforms=(CRate(2.0),),
    checks=(
        MissingCheck((C.C_RATE.name, C.VOLTAGE.name)),
        TimeCheck(max_dt_s=LIMIT),
        BoundsCheck.of({C.VOLTAGE.name: (3.0, 6.0)}),
    ),
)


def cycling_rows(spark, d):
    """Events as ingested cycling rows: one task per user."""
    return events(spark, d).select(
        F.col("user_id").cast("string").alias("cell id"),
        (F.col("user_id") % 4).alias("cycle index"),
        F.col("event_id").alias("ingest order"),
        F.col("t").alias("Time [s]"),
        (F.col("value") / 10).alias("Current [A]"),
        (F.col("value") / 100 + 3).alias("volts"),
    )


SHOWN = ["cell id", "cycle index", "row position"]


def normalized_text(rows, *extra):
    return rows.select(
        *[col(c) for c in SHOWN],
        rounded("`Time [s]`", 4).alias("time"),
        rounded("`Time diff [s]`", 4).alias("dt"),
        rounded("`Current [C-rate]`", 6).alias("rate"),
        rounded("`Terminal voltage [V]`", 6).alias("volts"),
        col("Nominal capacity [Ah]").alias("capacity"),
        *extra,
    )


NORMALIZED = f"""a AS ({LEAD.format(src=E)}),
  f AS (SELECT *, dup AS b1, dt > {LIMIT} AS b2, dt > 0 AND value / 100 + 3 > 6 AS b3 FROM a),
  k AS (SELECT *, row_number() OVER w - 1 AS pos, sum(dt) OVER w - dt AS time FROM f WHERE dt > 0
    WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"""
NORMALIZED_COLS = """user_id::VARCHAR AS "cell id", user_id % 4 AS "cycle index", pos AS "row position",
  round(time, 4) AS time, round(dt, 4) AS dt, round(value / 10 / 2, 6) AS rate, round(value / 100 + 3, 6) AS volts,
  2.0::DOUBLE AS capacity"""


@query(
    "q2_normalize_strict",
    f"""WITH {NORMALIZED} SELECT {NORMALIZED_COLS} FROM k
      WHERE user_id NOT IN (SELECT user_id FROM f WHERE b1 OR b2 OR b3)""",
)
def normalize_strict(spark, d):
    return normalized_text(normalize_rows(cycling_rows(spark, d), RECIPE).rows)


JOB_POINTS = 12


@query(
    "q2_normalize_job",
    f"""WITH {NORMALIZED}, n AS (SELECT user_id, count(*) AS n FROM k GROUP BY user_id),
      b AS (SELECT user_id, bool_or(b1) AS b1, bool_or(b2) AS b2, bool_or(b3) AS b3 FROM f GROUP BY user_id)
    SELECT u.user_id::VARCHAR AS "cell id", u.user_id % 4 AS "cycle index",
      CASE WHEN b1 OR b2 OR b3 THEN 'failed' ELSE 'succeeded' END AS status,
      nullif(concat_ws(';', CASE WHEN b3 THEN 'Terminal voltage [V]:above column maximum' END,
        CASE WHEN b2 THEN 'Time diff [s]:big time diff' END, CASE WHEN b1 THEN 'Time [s]:duplicate time steps' END), '') AS reason,
      CASE WHEN NOT (b1 OR b2 OR b3) THEN least(n, {JOB_POINTS}) END AS "row count",
      (NOT (b1 OR b2 OR b3) AND n IS NULL)::BIGINT AS warnings
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN n USING (user_id) LEFT JOIN b USING (user_id)""",
)
def normalize_job(spark, d):
    """The stage as a job: checks, downsampling, shards, statistics and manifest, with a state for every task."""
    spec = replace(RECIPE, resampling=MinMaxLTTB(C.TIME.name, C.VOLTAGE.name, points=JOB_POINTS))
    dataset = DatasetSpec("events", "derived", ingest=(), normalize=(spec,))
    store = f"{checkpoint_dir(spark).rstrip('/')}/normalize-{uuid.uuid4().hex}"
    provenance = {"git commit": "abcdef1234", "git status": "clean"}
    with exact_names(spark):
        tasks = run_normalize(spark, dataset, {spec.protocol.name: cycling_rows(spark, d)}, store, provenance)
        out = tasks.select("cell id", "cycle index", "status", "reason", "row count", "warnings")
        return written(out, "normalize-states")


@query(
    "q3_q4_normalize_annotated",
    f"""WITH {NORMALIZED} SELECT {NORMALIZED_COLS}, nullif(concat_ws(';', CASE WHEN b1 THEN 'Time [s]:duplicate time steps' END,
      CASE WHEN b2 THEN 'Time diff [s]:big time diff' END,
      CASE WHEN b3 THEN 'Terminal voltage [V]:above column maximum' END), '') AS reasons
      FROM k""",
)
def normalize_annotated(spark, d):
    rows = normalize_rows(cycling_rows(spark, d), RECIPE, annotate=True).rows
    return normalized_text(rows, reason_text(col("annotations")).alias("reasons"))


@query(
    "q3_q4_selected_stage",
    f"""WITH {NORMALIZED} SELECT user_id::VARCHAR AS "cell id", user_id % 4 AS "cycle index", pos AS "stream position",
      round(time, 4) AS time, round(value / 100 + 3, 6) AS volts, 'derived' AS type, 'none' AS method FROM k WHERE user_id % 4 IN (1, 3)""",
)
def selected_stage(spark, d):
    """An annotated run over selected tasks; its manifest is found and loaded, and its rows are read by their segments."""
    dataset = DatasetSpec("events", "derived", ingest=(), normalize=(RECIPE,))
    store = f"{checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    provenance = {"git commit": "abcdef1234", "git status": "clean"}
    with exact_names(spark):
        rows = {"cycling": cycling_rows(spark, d)}
        run_normalize(
            spark, dataset, rows, store, provenance, annotate=True, resample=False, group_values={"cycle index": [1, 3]}
        )
        found = available_manifests(spark, store)
        manifest = load_manifest(spark, store, found[0])
        keys = ["cell id", "cycle index", "protocol"]
        read = stage_segments(spark, store, manifest, manifest, C.NORMALIZED_SEGMENTS.name, keys)
        named = manifest.select(*[col(k) for k in keys], "type", col(C.RESAMPLING_METHOD.name).alias("method"))
        out = key_join(read, named, keys).select(
            "cell id",
            "cycle index",
            "stream position",
            rounded("`Time [s]`", 4).alias("time"),
            rounded("`Terminal voltage [V]`", 6).alias("volts"),
            "type",
            "method",
        )
        return written(out, "stage-rows")


@query(
    "r10_r13_resample_again",
    f"""WITH {NORMALIZED}, e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS back FROM k
      WHERE user_id NOT IN (SELECT user_id FROM f WHERE b1 OR b2 OR b3))
    SELECT user_id::VARCHAR AS "cell id", user_id % 4 AS "cycle index", (pos > 0)::BIGINT AS "row position", round(time, 4) AS time,
      round(value / 100 + 3, 6) AS volts FROM e WHERE pos = 0 OR back = 1""",
)
def again(spark, d):
    """An unresampled result, resampled later with an overridden budget of two points: its ends."""
    spec = override_resampling([replace(RECIPE, resampling=MinMaxLTTB(C.TIME.name, C.VOLTAGE.name, points=50, min_points=2))], {"cycling": 2})[0]
    rows = normalize_rows(cycling_rows(spark, d), spec, resample=False).rows
    method, params = no_resampling_metadata()
    manifest = rows.select("cell id").distinct().withColumns(
        {C.RESAMPLING_METHOD.name: F.lit(method), C.RESAMPLING_PARAMS.name: F.lit(params)}
    )
    out = resample_again(rows, manifest, spec)
    return out.select(
        "cell id",
        "cycle index",
        "row position",
        rounded("`Time [s]`", 4).alias("time"),
        rounded("`Terminal voltage [V]`", 6).alias("volts"),
    )


@query(
    "s11_table_once",
    """SELECT event_id, value, false AS overwritten FROM events""",
)
def table_once(spark, d):
    """A table that is written once; a second write is refused."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/once-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select("event_id", "value")
    write_table_once(rows, path)
    try:
        write_table_once(rows.limit(0), path)
        overwritten = True
    except AnalysisException:
        overwritten = False
    return read_table(spark, path).withColumn("overwritten", F.lit(overwritten))


@query(
    "c7_dry_run",
    f"""WITH {NORMALIZED} SELECT DISTINCT user_id::VARCHAR AS "cell id", user_id % 4 AS "cycle index", c AS "column", r AS reason FROM (
      SELECT user_id, 'Time [s]' AS c, 'duplicate time steps' AS r FROM f WHERE b1
      UNION ALL SELECT user_id, 'Time diff [s]', 'big time diff' FROM f WHERE b2
      UNION ALL SELECT user_id, 'Terminal voltage [V]', 'above column maximum' FROM f WHERE b3)""",
)
def dry(spark, d):
    return dry_run(cycling_rows(spark, d), RECIPE)


@query(
    "m1_q5_training_index",
    f"""WITH i AS (SELECT * FROM {INDEX} WHERE protocol IN ('cycling', 'HPPC')), g AS (SELECT DISTINCT {GROUP_SQL} FROM i),
      r AS (SELECT *, row_number() OVER (ORDER BY {DIGEST_SQL}, {GROUP_SQL}) AS rn, count(*) OVER () AS n FROM g),
      m AS (SELECT {STREAM_SQL}, row_number() OVER (PARTITION BY "dataset id" ORDER BY "cycle index", "cell id", protocol) - 1 AS mid
        FROM {INDEX})
    SELECT {STREAM_SQL}, CASE WHEN rn <= floor(n * 0.3) THEN 'val' ELSE 'train' END AS split, mid AS manifest_row,
      row_number() OVER (ORDER BY {STREAM_SQL}) - 1 AS index_row
    FROM i JOIN r USING ({GROUP_SQL}) JOIN m USING ({STREAM_SQL})""",
)
def training_index(spark, d):
    index = stream_index(spark, d)
    manifests, revisions = {}, {}
    for name in ("a", "b"):
        stage = f"type=published/dataset={name}/source=normalized"
        segment = F.struct(
            F.concat(F.lit(f"{stage}/data/"), "protocol", F.lit(".parquet")).alias("file path"),
            F.lit(0).alias("row start"),
            col("row count"),
        )
        rows = index.filter(col("dataset id") == name).withColumns(
            {
                "normalized segments": F.array(segment).cast(C.NORMALIZED_SEGMENTS.dtype),
                "git commit": F.lit("0123456789ab"),
                "git status": F.lit("clean"),
            }
        )
        manifests[f"{stage}/manifest.parquet"] = rows
        revisions[f"{stage}/manifest.parquet"] = "0123456"
    built = build_index(
        manifests, revisions, ["cycling", "HPPC"], "available", ValidationSplit(fraction=0.3)
    )
    return built.select(
        *[col(c) for c in STREAM],
        "split",
        F.col("__manifest_row_id").alias("manifest_row"),
        F.col("__ml_index_row_id").alias("index_row"),
    )


SPEC = WindowSpec(batch_size=2, seq_len=3)


@query(
    "q6_training_windows",
    f"""WITH x AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'b' ELSE 'a' END AS "dataset id", 'cell-' || (user_id % 20) AS "cell id",
        user_id AS "cycle index", CASE WHEN event_type IN ('click', 'signup') THEN 'cycling' WHEN event_type = 'view' THEN 'HPPC'
        WHEN event_type = 'purchase' THEN 'RPT' ELSE 'EIS' END AS protocol FROM {E}),
      s AS (SELECT *, row_number() OVER w - 1 AS pos, (value - 0) / 1000 * 2 - 1 AS sv,
        count(*) OVER (PARTITION BY {STREAM_SQL}) AS n FROM x WHERE "cell id" NOT IN ('cell-3', 'cell-4')
        WINDOW w AS (PARTITION BY {STREAM_SQL} ORDER BY t, event_id)),
      p AS (SELECT {STREAM_SQL}, n, unnest(range(0, greatest(0, ceil((n - 6) / 6.0))::BIGINT)) AS k
        FROM (SELECT DISTINCT {STREAM_SQL}, n FROM s WHERE n > 1)),
      o AS (SELECT *, row_number() OVER (ORDER BY {STREAM_SQL}, k) - 1 AS pi, count(*) OVER () AS total FROM p)
    SELECT o."dataset id", o."cell id", o."cycle index", o.protocol, k AS "window number", pi AS "plan index", pi % 2 AS rank,
      i // 3 AS lane, i % 3 AS position, round(a.sv, 4) AS input, round(b.sv, 4) AS target
    FROM o, range(6) r(i)
    JOIN s a ON a."dataset id" = o."dataset id" AND a."cell id" = o."cell id" AND a."cycle index" = o."cycle index"
      AND a.protocol = o.protocol AND a.pos = k * 6 + i
    JOIN s b ON b."dataset id" = o."dataset id" AND b."cell id" = o."cell id" AND b."cycle index" = o."cycle index"
      AND b.protocol = o.protocol AND b.pos = k * 6 + i + 1
    WHERE pi < total // 2 * 2""",
)
def windows(spark, d):
    kind = F.col("event_type")
    protocol = (
        F.when(kind.isin("click", "signup"), "cycling")
        .when(kind == "view", "HPPC")
        .when(kind == "purchase", "RPT")
        .otherwise("EIS")
    )
    rows = events(spark, d).select(
        F.when(kind == "signup", "b").otherwise("a").alias("dataset id"),
        F.concat(F.lit("cell-"), (F.col("user_id") % 20).cast("string")).alias("cell id"),
        F.col("user_id").alias("cycle index"),
        protocol.alias("protocol"),
        "t",
        "event_id",
        "value",
    )
    numbered = OrderedFrame.of(rows, STREAM, "t", ["event_id"]).scan({"row position": position()}).result
    held_out = F.when(col("cell id").isin("cell-3", "cell-4"), "val").otherwise("train")
    index = stream_index(spark, d).withColumn("split", held_out)
    stat = F.struct(F.lit("value").alias("column"), F.col("low").alias("min"), F.col("high").alias("max"))
    index = index.withColumn(C.NORMALIZED_STATS.name, F.array(stat))
    lanes = training_windows(
        index,
        numbered,
        "train",
        ["value"],
        ["value"],
        SPEC,
        (Scale("value", (0.0, 1000.0)),),
        world_size=2,
    )
    cells = F.posexplode(F.arrays_zip("inputs", "targets")).alias("position", "cell")
    out = lanes.select(*[col(c) for c in STREAM], "window number", "plan index", "rank", "lane", cells)
    return out.select(
        *[col(c) for c in STREAM],
        "window number",
        "plan index",
        "rank",
        "lane",
        F.col("position").cast("long").alias("position"),
        rounded(F.col("cell.inputs")[0].cast("double"), 4).alias("input"),
        rounded(F.col("cell.targets")[0].cast("double"), 4).alias("target"),
    )


# ---------------------------------------------------------------- streaming


def event_stream(spark, d, columns):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("t", epoch_seconds(F.col("ts"))).select(*columns)


def drained(spark, stream):
    """Run a stream over everything there is and read back what it wrote."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    run = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query(
    "t1_stream_time_check",
    f"""WITH a AS ({LEAD.format(src=E)}), b AS (SELECT * FROM a WHERE dt > 0)
    SELECT user_id, event_id, round(dt, 5) AS dt, round(sum(dt) OVER (PARTITION BY user_id ORDER BY t, event_id) - dt, 4) AS time,
      nullif(concat_ws(';', CASE WHEN dup THEN 't:duplicate time steps' END, CASE WHEN dt > {BIG} THEN 'dt:big time diff' END), '') AS reasons FROM b""",
)
def stream_time(spark, d):
    check = TimeCheck("t", "dt", BIG)
    stream = stream_time_check(event_stream(spark, d, ["user_id", "event_id", "t"]), ["user_id"], check, ["event_id"])
    rows = drained(spark, annotated_time_check(stream, check))
    return rows.select(
        "user_id",
        "event_id",
        rounded("dt", 5).alias("dt"),
        rounded("t", 4).alias("time"),
        reason_text(F.col("annotations")).alias("reasons"),
    )


# The stream arrives in six files by time. One row in seven comes one file late, which the waiting list covers; of the fifth file
# and the one before it, one row in eleven comes at the very end and is late if its key has put out a later row by then.
ARRIVAL = f"""(SELECT *, event_id % 11 = 3 AND part IN (3, 4) AS last, CASE WHEN event_id % 11 = 3 AND part IN (3, 4) THEN 6
    ELSE least(part + (event_id % 7 = 2)::INT, 5) END AS file
  FROM (SELECT user_id, event_id, t, least(floor(6 * (t - lo) / (hi - lo)), 5)::INT AS part
    FROM {E}, (SELECT min(t) AS lo, max(t) AS hi FROM {E})))"""
ARRIVAL_DELAY = 12 * 24 * 3600.0


@query(
    "t1_stream_reordered",
    f"""WITH s AS {ARRIVAL},
      top AS (SELECT user_id, max(t) AS newest FROM s WHERE NOT last GROUP BY user_id),
      front AS (SELECT s.user_id, max(t) AS head FROM s JOIN top USING (user_id) WHERE NOT last AND t <= newest - {ARRIVAL_DELAY} GROUP BY s.user_id),
      m AS (SELECT s.*, coalesce(last AND t < head, false) AS late FROM s LEFT JOIN front USING (user_id)),
      done AS (SELECT user_id, max(t) - {ARRIVAL_DELAY} AS until FROM m WHERE NOT late GROUP BY user_id),
      a AS (SELECT m.*, lead(t) OVER w - t AS dt, first(t) OVER w AS start FROM m JOIN done USING (user_id)
        WHERE NOT late AND t <= until WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT user_id, event_id, round(dt, 4) AS dt, round(t - start, 3) AS time, NULL AS late FROM a WHERE dt > 0
    UNION ALL SELECT user_id, event_id, NULL, round(t, 3), 'late row' FROM m WHERE late""",
)
def stream_reordered(spark, d):
    """Events over seven micro-batches, partly out of order and partly late."""
    rows = table(spark, d, "events").withColumn("t", epoch_seconds(F.col("ts"))).select("user_id", "event_id", "t")
    ends = rows.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    part = F.least(F.floor(6 * (F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo"))), F.lit(5)).cast("int")
    rows = rows.crossJoin(ends).withColumn("part", part)  # one row of bounds
    last = (F.col("event_id") % 11 == 3) & F.col("part").isin(3, 4)
    file = F.when(last, 6).otherwise(F.least(F.col("part") + (F.col("event_id") % 7 == 2).cast("int"), F.lit(5)))
    rows = rows.select("user_id", "event_id", "t", F.timestamp_seconds("t").alias("at"), file.alias("file"))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/arrival-{uuid.uuid4().hex}"
    staged = f"{checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    rows.write.partitionBy("file").parquet(staged)  # the events are read once, not once a file
    for k in range(7):  # files are taken in the order of their writing
        part = spark.read.schema("user_id long, event_id long, t double, at timestamp, file int").parquet(staged)
        part.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    stream = spark.readStream.schema("user_id long, event_id long, t double, at timestamp")
    stream = stream.option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        checked = reordered_time_check(
            stream, ["user_id"], TimeCheck("t", "dt", BIG), "at", ["event_id"], ARRIVAL_DELAY, 400 * 24 * 3600.0, "400 days"
        )
        out = drained(spark, checked)
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])
    return out.select("user_id", "event_id", rounded("dt", 4).alias("dt"), rounded("t", 3).alias("time"), F.col("__late").alias("late"))


@query(
    "t2_stream_axis_check",
    f"""SELECT user_id, event_id, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) <= 0, false) AS invalid
      FROM events""",
)
def stream_axis(spark, d):
    check = AxisCheck("value", zero_replacement=1e-7, enforce_positive=True)
    stream = stream_axis_check(event_stream(spark, d, ["user_id", "event_id", "value"]), ["user_id"], check, ["event_id"])
    return drained(spark, stream).select("user_id", "event_id", F.col("__invalid_axis").alias("invalid"))


@query(
    "t3_stream_row_checks",
    """SELECT event_id, CASE WHEN value < 5 THEN 'value:below column minimum' WHEN value > 200 THEN 'value:above column maximum' END AS reasons
      FROM events""",
)
def stream_rows(spark, d):
    stream = event_stream(spark, d, ["event_id", "value"])
    rows = drained(spark, stream_row_checks(stream, [CHECKS[0], CHECKS[2]]))
    return rows.select("event_id", reason_text(F.col("annotations")).alias("reasons"))


@query(
    "t4_stream_overlay_time",
    f"""WITH a AS ({LEAD.format(src=E)}), b AS (SELECT * FROM a WHERE dt > 0)
    SELECT user_id, event_id, round(sum(dt) OVER (PARTITION BY user_id ORDER BY t, event_id) - dt, 4) AS time FROM b""",
)
def stream_overlay(spark, d):
    stream = event_stream(spark, d, ["user_id", "event_id", "t"])
    rows = drained(spark, stream_overlay_time(stream, ["user_id"], "t", ["event_id"]))
    return rows.select("user_id", "event_id", rounded("t", 4).alias("time"))
