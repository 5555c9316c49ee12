"""The ingest stage over delimited exports written from the events: two kinds of header, one manifest, rows by segments."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import functions as F

from scenarios.common import E, events, query, rounded
from streamloom import columns as C
from streamloom.columns import col
from streamloom.plans.datasets import POZZATO_2022
from streamloom.plans.ingest import DelimitedSource, run_ingest
from streamloom.session import checkpoint_dir, written
from streamloom.sources.tables import read_segments

KEYS = [C.PROTOCOL.name, C.CELL_ID.name, C.CYCLE_INDEX.name]
PROVENANCE = {"git commit": "abcdef1234", "git status": "clean"}
CELLS = 4


@contextmanager
def exact_names(spark):
    """The stage tells `cycle index` from `Cycle index`."""
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def ingested(spark, d):
    """(output root, manifest) of the events as exports: a folder per cell, whose header is one of two."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    rows = events(spark, d).withColumn("cell", F.col("user_id") % CELLS)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")

    def export(cell):
        mine = rows.where(F.col("cell") == cell).orderBy("t", "event_id")
        seconds, volts = (F.col("event_id") * 0.5).cast("string"), (3 + F.col("value") / 1000).cast("string")
        amps = (F.col("value") / 100).cast("string")
        if cell % 2:
            names = {"Date_Time": stamp, "Test Time (s)": seconds, "Voltage (V)": volts, "Current (A)": amps, "Cycle Index": F.lit("7")}
        else:
            names = {"Test_Time(s)": seconds, "Date_Time": stamp, "Current(A)": amps, "Voltage(V)": volts, "Current": F.lit("1")}
        folder = f"{base}/raw/Cycling_1/V{cell}"
        # All tasks sort; the one that writes the cell's file only reads their rows on end.
        lines = mine.select(*[v.alias(k) for k, v in names.items()]).checkpoint()
        lines.coalesce(1).write.option("header", "true").csv(folder)

    with ThreadPoolExecutor(CELLS) as cells:
        list(cells.map(export, range(CELLS)))
    manifest = run_ingest(spark, DelimitedSource(POZZATO_2022), f"{base}/raw", f"{base}/store", PROVENANCE)
    return f"{base}/store", manifest


@query(
    "q1_ingest_manifest",
    f"""SELECT 'cycling' AS protocol, 'V' || (user_id % {CELLS}) AS "cell id", 1::BIGINT AS "cycle index", count(*) AS "row count",
      'pozzato-2022' AS "dataset id", 'ingested' AS stage, count(*) AS "segment rows", 1::BIGINT AS files FROM events GROUP BY user_id % {CELLS}""",
)
def ingest_manifest(spark, d):
    with exact_names(spark):
        _, manifest = ingested(spark, d)
        held = F.aggregate(col(C.INGESTED_SEGMENTS.name), F.lit(0).cast("long"), lambda a, s: a + s["row count"])
        rows = manifest.select(
            *[col(k) for k in KEYS],
            "row count",
            col(C.DATASET_ID.name).alias("dataset id"),
            col(C.PROCESSING_STAGE.name).alias("stage"),
            held.alias("segment rows"),
            F.size(col(C.RAW_PATHS.name)).cast("long").alias("files"),
        )
        return written(rows, "ingest-manifest")


@query(
    "q1_ingest_rows",
    f"""SELECT 'V' || (user_id % {CELLS}) AS cell, row_number() OVER (PARTITION BY user_id % {CELLS} ORDER BY t, event_id) - 1 AS position,
      event_id * 0.5 AS time, round(-value / 100, 6) AS amps, round(3 + value / 1000, 6) AS volts,
      strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') AS stamp,
      CASE WHEN user_id % 2 = 1 THEN 7 END::DOUBLE AS counter FROM {E}""",
)
def ingest_rows(spark, d):
    with exact_names(spark):
        store, manifest = ingested(spark, d)
        rows = read_segments(spark, store, manifest, C.INGESTED_SEGMENTS.name, KEYS)
        out = rows.select(
            col(C.CELL_ID.name).alias("cell"),
            F.col("`stream position`").alias("position"),
            col(C.TIME.name).alias("time"),
            rounded(f"`{C.CURRENT.name}`", 6).alias("amps"),
            rounded(f"`{C.VOLTAGE.name}`", 6).alias("volts"),
            F.date_format(col(C.DATE_TIME.name), "yyyy-MM-dd HH:mm:ss.SSS").alias("stamp"),
            col(C.TESTER_CYCLE_INDEX.name).cast("double").alias("counter"),
        )
        return written(out, "ingest-rows")
