"""Sources, selection, validation and manifest queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scenarios.common import INDEX, events, gappy, query, stream_index, table
from scenarios.training import GROUP, GROUP_SQL, STREAM, STREAM_SQL
from streamloom import columns as C
from streamloom import protocols as P
from streamloom.columns import col
from streamloom.functions.values import display_label, group_label, is_finite
from streamloom.operators import manifest as M
from streamloom.operators import select as S
from streamloom.operators.explore import matching_overlays, preview_metadata
from streamloom.operators.index import with_manifest_row_ids
from streamloom.operators.joins import key_join, lineage_lookup
from streamloom.operators.ranking import first_occurrences
from streamloom.sources.files import source_order, with_path_metadata, with_sidecar_metadata
from streamloom.sources.tables import ROW_INDEX, read_segments, read_table, stage_rows, stage_segments, with_row_source


@query(
    "s1_s2_scan_table",
    """SELECT event_id, value FROM events WHERE value > 50
      UNION ALL SELECT event_id, value FROM events WHERE value > 50""",
)
def scan(spark, d):
    path = f"{d}/events.parquet"
    return read_table(spark, [path, path], ["event_id", "value"], F.col("value") > 50)


@query(
    "s3_read_segments",
    """WITH m AS (SELECT count(*) AS n FROM events)
    SELECT event_id, event_id // 1000 AS part, CASE WHEN event_id % 1000 < 300 THEN event_id % 1000
      ELSE event_id % 1000 - 200 END AS "stream position"
    FROM events, m WHERE event_id % 1000 < 300 OR event_id % 1000 >= 500""",
)
def segments(spark, d):
    """Two row ranges of every thousand rows of the file, read through a manifest."""
    n = table(spark, d, "events").agg(F.max("event_id").alias("last"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 1000)))
    parts = n.select("last", part.alias("part"))

    def piece(start: int, rows: int):
        begin = F.col("part") * 1000 + start
        return F.struct(
            F.lit("events.parquet").alias("file path"), begin.alias("row start"), F.lit(rows).alias("row count")
        )

    manifest = parts.select("part", F.array(piece(0, 300), piece(500, 500)).cast(C.INGESTED_SEGMENTS.dtype).alias("segments"))
    rows = read_segments(spark, d, manifest, "segments", ["part"])
    return rows.select("event_id", "part", "stream position")


# Raw paths in the vendor's naming convention, derived from the pages table.
PATHS = """(SELECT page_id, CASE page_id % 5
    WHEN 0 THEN 'raw/Cycling_' || page_id || '/V' || (page_id % 9) || '/run_Channel_1_Part2_' || (page_id % 7) || '.csv'
    WHEN 1 THEN 'raw/Diag_' || page_id || '/lot_W' || (page_id % 8) || '_Channel_3.' || (page_id % 4) || '.csv'
    WHEN 2 THEN 'raw/EIS/test_G' || (page_id % 6) || '_SOC' || (page_id % 100) || '.5_HPPC_' || page_id || '.csv'
    WHEN 3 THEN 'raw/HPPC_' || page_id || '_A1_B' || (page_id % 3) || '_Channel_2.csv'
    ELSE url END AS path FROM pages)"""


def raw_paths(spark, d):
    pages = table(spark, d, "pages")
    i = F.col("page_id")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    path = (
        F.when(i % 5 == 0, text("raw/Cycling_", i, "/V", i % 9, "/run_Channel_1_Part2_", i % 7, ".csv"))
        .when(i % 5 == 1, text("raw/Diag_", i, "/lot_W", i % 8, "_Channel_3.", i % 4, ".csv"))
        .when(i % 5 == 2, text("raw/EIS/test_G", i % 6, "_SOC", i % 100, ".5_HPPC_", i, ".csv"))
        .when(i % 5 == 3, text("raw/HPPC_", i, "_A1_B", i % 3, "_Channel_2.csv"))
        .otherwise(F.col("url"))
    )
    return pages.select("page_id", path.alias("path"))


PATH_META = f"""SELECT page_id, path,
    CASE WHEN path LIKE '%EIS%' THEN 'EIS' WHEN path LIKE '%HPPC%' THEN 'HPPC' WHEN path LIKE '%Diag%' THEN 'RPT'
      WHEN path LIKE '%Cycling%' THEN 'cycling' END AS protocol,
    CASE page_id % 5 WHEN 2 THEN (page_id % 100) + 0.5 END AS "SOC [%]",
    CASE page_id % 5 WHEN 1 THEN page_id - 1 WHEN 4 THEN NULL ELSE page_id END AS "cycle index",
    CASE page_id % 5 WHEN 0 THEN 'V' || (page_id % 9) WHEN 1 THEN 'W' || (page_id % 8)
      WHEN 2 THEN 'G' || (page_id % 6) WHEN 3 THEN 'B' || (page_id % 3) END AS "cell id" FROM {PATHS}"""


@query("s7_path_metadata", f'SELECT page_id, protocol, "SOC [%]"::DOUBLE AS "SOC [%]", coalesce("cycle index", -1) AS "cycle index", "cell id" FROM ({PATH_META})')
def path_metadata(spark, d):
    named = with_path_metadata(raw_paths(spark, d), "path", strict=False).drop("path")
    # Plain integers compare the same everywhere, so unreadable cycles show as -1.
    return named.withColumn("cycle index", F.coalesce(col("cycle index"), F.lit(-1).cast("long")))


# The file order read off the path itself; pages that share an address follow one another by their number.
ORDERED_PATHS = rf"""(SELECT *, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^.]*$', '') AS stem,
    regexp_extract(path, '(?:^|/)(Cycling|Diag)_(\d+)(?:/|$)', 1) AS folder,
    try_cast(regexp_extract(path, '(?:^|/)(Cycling|Diag)_(\d+)(?:/|$)', 2) AS BIGINT) AS no,
    CASE WHEN path LIKE '%EIS%' THEN 3 WHEN path LIKE '%HPPC%' THEN 1 WHEN path LIKE '%Diag%' THEN 2
      WHEN path LIKE '%Cycling%' THEN 0 ELSE 99 END AS r FROM {PATHS})"""


@query(
    "s9_source_order",
    rf"""SELECT page_id, row_number() OVER (ORDER BY r, c NULLS FIRST, cell NULLS FIRST, soc, part, ch, path NULLS FIRST, page_id) AS place
      FROM (SELECT page_id, path, r,
        CASE folder WHEN 'Cycling' THEN no WHEN 'Diag' THEN no - 1
          ELSE try_cast(regexp_extract(stem, '(?:Cycling|Diag|HPPC)_(\d+)', 1) AS BIGINT) END AS c,
        CASE folder WHEN 'Cycling' THEN nullif(regexp_extract(path, '(?:^|/)Cycling_\d+/([A-Za-z]\d+)(?:/|$)', 1), '')
          ELSE [x FOR x IN string_split(string_split(stem, '_Channel_')[1], '_') IF regexp_full_match(x, '[A-Za-z]\d+')][-1] END AS cell,
        coalesce(CASE WHEN r = 3 THEN try_cast(regexp_extract(path, '(?:SOC|EIS)(\d+(?:\.\d+)?)', 1) AS DOUBLE) END, -1) AS soc,
        coalesce(try_cast(regexp_extract(stem, '^.*?Part(\d+)(?:_|Part|$)', 1) AS BIGINT), 0) AS part,
        coalesce(try_cast(coalesce(nullif(regexp_extract(stem, '\.(\d+)$', 1), ''), regexp_extract(stem, '_(\d+)$', 1)) AS BIGINT), 0) AS ch
      FROM {ORDERED_PATHS})""",
)
def file_order(spark, d):
    """All paths; those that name no protocol or cycle have a place too, equal ones by their page."""
    named = with_path_metadata(raw_paths(spark, d), "path", strict=False)
    return (
        named.withColumn("o", source_order("path"))
        .withColumn("cycle", F.col("o.cycle"))
        .transform(lambda df: _ranked(df))
        .select("page_id", "place")
    )


def _ranked(df):
    from streamloom.operators.ranking import total_order_position

    flat = df.select("page_id", "o.*")
    order = ["protocol", "cycle", "cell", "soc", "part", "channel", "path", "page_id"]
    return total_order_position(flat, order, "place").withColumn("place", F.col("place") + 1)


@query(
    "s8_sidecar_metadata",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'cycling' WHEN 1 THEN 'RPT' ELSE 'EIS' END AS protocol,
      'U' || (page_id % 10) AS "cell id", page_id // 10 AS "cycle index",
      CASE WHEN page_id % 2 = 0 THEN 4.85 END::DOUBLE AS "Nominal capacity [Ah]",
      CASE page_id % 3 WHEN 2 THEN 3 + (page_id % 10) / 10.0 END::DOUBLE AS "EIS voltage [V]" FROM pages""",
)
def sidecar(spark, d):
    i = F.col("page_id")
    volts = F.concat(F.lit("EIS3p"), (i % 10).cast("string"), F.lit("V_"), i.cast("string"), F.lit(".parquet"))
    path = F.when(i % 3 == 0, F.concat(F.lit("a/Cycling_"), i.cast("string"), F.lit(".parquet"))).when(
        i % 3 == 1, F.concat(F.lit("a/x"), i.cast("string"), F.lit(".parquet"))
    ).otherwise(F.concat(F.lit("a/"), volts))
    index = F.struct(
        F.concat(F.lit("U"), (i % 10).cast("string")).alias("cell_id"),
        F.floor(i / 10).alias("cycle_index"),
        F.when(i % 2 == 0, F.lit(4.85)).alias("nominal_capacity_ah"),
        F.when(i % 3 == 1, "Diag").alias("domain"),
    )
    rows = table(spark, d, "pages").select("page_id", path.alias("path"), F.to_json(F.struct(index.alias("index"))).alias("meta"))
    return with_sidecar_metadata(rows, "path", "meta").drop("path", "meta")


@query(
    "s12_manifest_kind",
    """SELECT CASE WHEN count(*) FILTER ("row count" < 5) > 0 THEN 'err_manifest' ELSE 'manifest' END AS kind,
      count(*) AS streams, count(*) FILTER ("row count" < 5) AS failed FROM """ + INDEX,
)
def manifest_kind(spark, d):
    tasks = stream_index(spark, d).withColumn("status", F.when(F.col("row count") < 5, "failed").otherwise("succeeded"))
    kind = M.manifest_kind(tasks)
    return tasks.agg(F.count(F.lit(1)).alias("streams"), F.count_if(F.col("status") == "failed").alias("failed")).select(
        F.lit(kind).alias("kind"), "streams", "failed"
    )


@query(
    "s13_provenance",
    """SELECT "cycle index"::VARCHAR AS cycle, protocol, CASE WHEN "cycle index" % 2 = 0 THEN 'own' ELSE 'run-set' END AS "dataset id",
      'normalized' AS "processing stage", 'abcdef1234' AS "git commit", 'clean' AS "git status",
      'm.parquet' AS "manifest path", 'start_of_interval' AS "time convention", 'null' AS "SOC [%]"
    FROM """ + INDEX,
)
def provenance(spark, d):
    rows = stream_index(spark, d).withColumn(
        "dataset id", F.when(F.col("`cycle index`") % 2 == 0, F.lit("own"))
    )
    layout = P.PROVENANCE.with_optional({C.TIME_CONVENTION: "start_of_interval", C.SOC: None})
    runtime = {
        "dataset id": "run-set",
        "processing stage": "normalized",
        "git commit": "abcdef1234",
        "git status": "clean",
        "manifest path": "m.parquet",
    }
    full = P.MetadataLayout((*layout.required, C.CYCLE_INDEX, C.PROTOCOL), layout.optional)
    out = M.encoded_provenance(M.resolve_provenance(rows, full, runtime), full)
    return out.withColumnRenamed("cycle index", "cycle")


@query(
    "s15_stage_rows",
    """SELECT event_id, user_id FROM events JOIN (SELECT user_id, event_type FROM events WHERE event_type = 'view'
      GROUP BY ALL HAVING count(*) >= 14) USING (user_id, event_type)""",
)
def selected_rows(spark, d):
    data = table(spark, d, "events").withColumnsRenamed({"event_type": "protocol"})
    manifest = data.groupBy("protocol", "user_id").agg(F.count(F.lit(1)).alias("row count"))
    chosen = manifest.filter((F.col("protocol") == "view") & (F.col("`row count`") >= 14))
    return stage_rows(data, chosen, ["protocol", "user_id"]).select("event_id", "user_id")


@query(
    "s15_stage_segments",
    """WITH s AS (SELECT user_id FROM events GROUP BY user_id HAVING count(*) % 3 = 1)
    SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS "stream position"
    FROM events JOIN s USING (user_id)""",
)
def segments_of_streams(spark, d):
    """Every stretch of neighbouring rows of a user is a segment; a third of the users is read back by segments."""
    rows = with_row_source(table(spark, d, "events")).select("user_id", F.col(ROW_INDEX).alias("i"))
    order = Window.partitionBy("user_id").orderBy("i")
    stretch = rows.withColumn("island", F.col("i") - F.row_number().over(order))
    pieces = stretch.groupBy("user_id", "island").agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("n"))
    piece = F.struct(F.lit("events.parquet").alias("file path"), F.col("start").alias("row start"), F.col("n").alias("row count"))
    manifest = pieces.groupBy("user_id").agg(
        F.array_sort(F.collect_list(piece)).cast(C.INGESTED_SEGMENTS.dtype).alias("segments"), F.sum("n").alias("row count")
    )
    chosen = manifest.filter(F.col("`row count`") % 3 == 1)
    found = stage_segments(spark, d, manifest, chosen, "segments", ["user_id"])
    return found.select("event_id", "user_id", "stream position")


@query(
    "f1_stage_selection",
    f"""SELECT {STREAM_SQL} FROM {INDEX} WHERE protocol IN ('cycling', 'EIS')
      AND (("cell id" = 'cell-2' AND "cycle index" IN (2, 22, 42)) OR "cell id" IN ('cell-7', 'cell-8'))""",
)
def selection(spark, d):
    groups = [{"cell id": "cell-2", "cycle index": [2, 22, 42]}, {"cell id": ["cell-7", "cell-8"]}]
    rows = S.select_manifest(stream_index(spark, d), STREAM, ["cycling", "EIS"], groups)
    return rows.select(*[col(c) for c in STREAM])


@query(
    "f2_manifest_inputs",
    f"""SELECT DISTINCT protocol, "cell id", "cycle index",
      CASE protocol WHEN 'cycling' THEN 1 WHEN 'HPPC' THEN 2 WHEN 'RPT' THEN 3 ELSE 0 END::BIGINT AS "protocol order"
    FROM {INDEX}""",
)
def inputs(spark, d):
    rows = S.manifest_inputs(stream_index(spark, d), [P.CYCLING, P.HPPC, P.RPT])
    return rows.withColumn("protocol order", F.col("`protocol order`").cast("long"))


@query("f3_row_ids", "SELECT event_id, event_type FROM events WHERE event_id IN (SELECT l_orderkey FROM lineitem)")
def row_ids(spark, d):
    ids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"))
    return S.select_row_ids(table(spark, d, "events"), "event_id", ids).select("event_id", "event_type")


AVAILABLE = f"""SELECT "dataset id", string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS available,
    CASE WHEN bool_or(protocol = 'HPPC') THEN '' ELSE 'HPPC' END AS missing FROM {INDEX} GROUP BY 1"""


@query("f5_a4_protocol_availability", AVAILABLE)
def availability(spark, d):
    rows = S.protocol_availability(stream_index(spark, d), ["cycling", "hppc"])
    return rows.select(
        col("dataset id"), F.array_join("available", ",").alias("available"), F.array_join("missing", ",").alias("missing")
    )


@query("f5_filter_protocols", f"SELECT {STREAM_SQL} FROM {INDEX} WHERE protocol IN ('cycling', 'HPPC')")
def protocols(spark, d):
    rows = S.filter_protocols(stream_index(spark, d), ["cycling", "HPPC"], "available")
    return rows.select(*[col(c) for c in STREAM])


@query("f7_provided_groups", f"""SELECT DISTINCT {GROUP_SQL} FROM {INDEX} WHERE "cell id" IN ('cell-1') OR "cycle index" IN (5, 6)""")
def given_groups(spark, d):
    groups = stream_index(spark, d).select(*[col(c) for c in GROUP]).distinct()
    return S.provided_groups(groups, [{"cell id": "cell-1"}, {"cycle index": (5, 6)}], GROUP)


@query("f8_finite_rows", "SELECT event_id FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0")
def finite(spark, d):
    return gappy(events(spark, d)).filter(is_finite(F.col("value"))).select("event_id")


@query(
    "f9_batch_metadata_errors",
    f"""SELECT "cell id", "cycle index", protocol, CASE WHEN protocol <> 'cycling' THEN 'protocol mismatch'
      ELSE 'missing task key' END AS problem FROM (SELECT * REPLACE (CASE WHEN "cycle index" % 4 = 0 THEN NULL ELSE "cell id" END
      AS "cell id") FROM {INDEX}) WHERE protocol <> 'cycling' OR "cell id" IS NULL""",
)
def metadata_errors(spark, d):
    rows = stream_index(spark, d).withColumn(
        "cell id", F.when(F.col("`cycle index`") % 4 != 0, F.col("`cell id`"))
    )
    return S.batch_metadata_errors(rows, P.CYCLING).select("cell id", "cycle index", "protocol", "problem")


@query(
    "f10_non_canonical_paths",
    """SELECT 'type=' || lang || '/dataset=' || source || CASE WHEN doc_id % 3 = 0 THEN '/stage=x/' ELSE '/source=normalized/' END
      || doc_id AS "file path" FROM documents WHERE doc_id % 3 = 0""",
)
def canonical_paths(spark, d):
    rows = table(spark, d, "documents")
    middle = F.when(F.col("doc_id") % 3 == 0, "/stage=x/").otherwise("/source=normalized/")
    path = F.concat(F.lit("type="), "lang", F.lit("/dataset="), "source", middle, F.col("doc_id").cast("string"))
    segs = rows.select(F.array(F.struct(path.alias("file path"))).alias("segs"))
    return S.non_canonical_segments(segs, "segs")


@query(
    "f11_revision_problems",
    """SELECT DISTINCT source AS "manifest path", CASE lang WHEN 'en' THEN 'abcdef1999' WHEN 'de' THEN 'na' ELSE 'fffffff000' END AS "git commit",
      CASE WHEN doc_id % 2 = 0 THEN 'clean' ELSE 'dirty' END AS "git status",
      CASE WHEN lang = 'de' THEN 'no git commit' WHEN lang <> 'en' OR source <> 'src0' THEN 'git commit mismatch' ELSE 'dirty' END AS problem
    FROM documents WHERE NOT (lang = 'en' AND source = 'src0' AND doc_id % 2 = 0)""",
)
def revisions(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("source").alias("manifest path"),
        F.when(F.col("lang") == "en", "abcdef1999").when(F.col("lang") == "de", "na").otherwise("fffffff000").alias("git commit"),
        F.when(F.col("doc_id") % 2 == 0, "clean").otherwise("dirty").alias("git status"),
    )
    return S.revision_problems(rows, {"src0": "abcdef1"})


@query("f13_dataset_ids", """SELECT DISTINCT user_id, 'x-1' AS "dataset id" FROM events""")
def dataset_ids(spark, d):
    rows = table(spark, d, "events").select("user_id").distinct()
    return S.with_dataset_id(rows, "type=published/dataset=x-1/source=normalized/manifest.parquet")


@query(
    "f15_m34_selected_protocols",
    f"""SELECT DISTINCT protocol FROM {INDEX} WHERE protocol <> 'EIS'""",
)
def protocol_list(spark, d):
    rows = stream_index(spark, d).filter("protocol <> 'EIS'")
    S.selected_protocols(rows, ["cycling", "HPPC", "RPT"])
    return rows.select("protocol").distinct()


@query(
    "j8_single_stream_matches",
    f"""SELECT s AS selector, count(i."row count") AS matches FROM (SELECT DISTINCT "cycle index" AS s FROM {INDEX})
      LEFT JOIN {INDEX} i ON i."cycle index" = s AND i.protocol = 'cycling' GROUP BY s HAVING count(i."row count") <> 1""",
)
def single_matches(spark, d):
    index = stream_index(spark, d)
    selectors = index.select("cycle index").distinct().withColumns(
        {"selector": F.col("`cycle index`"), "protocol": F.lit("cycling")}
    )
    return S.single_stream_matches(index, selectors, ["cycle index", "protocol"])


SEG_SQL = """SELECT user_id::VARCHAR AS "cell id", event_type AS protocol, date_trunc('day', ts) AS day, min(event_id) AS first,
    count(*) AS n FROM events GROUP BY 1, 2, 3"""


def segment_table(spark, d):
    """One segment per user, type and day."""
    rows = table(spark, d, "events").groupBy(
        F.col("user_id").cast("string").alias("cell id"),
        F.col("event_type").alias("protocol"),
        F.date_trunc("day", "ts").alias("day"),
    ).agg(F.min("event_id").alias("first"), F.count(F.lit(1)).alias("row count"))
    segment = F.struct(
        F.date_format("day", "yyyy-MM-dd").alias("file path"), F.col("first").alias("row start"), col("row count")
    )
    return rows.withColumns(
        {
            "ingested segments": F.array(segment).cast(C.INGESTED_SEGMENTS.dtype),
            "raw file paths": F.array(F.concat(F.col("protocol"), F.lit(".csv"))),
        }
    )


def segment_text(c):
    return F.array_join(
        F.transform(c, lambda s: F.concat_ws("@", s["file path"], s["row start"].cast("string"), s["row count"].cast("string"))), ","
    )


PARTS = "string_agg(strftime(day, '%Y-%m-%d') || '@' || first || '@' || n, ',' ORDER BY day, first)"


@query(
    "a1_build_manifest",
    f"""SELECT protocol || '.csv' AS paths, {PARTS} AS segments, sum(n)::BIGINT AS "row count", protocol, "cell id"
      FROM ({SEG_SQL}) GROUP BY protocol, "cell id" """,
)
def build(spark, d):
    layout = P.INGEST_MANIFEST.with_optional({C.CELL_ID: None})
    out = M.build_manifest(segment_table(spark, d), layout, C.INGESTED_SEGMENTS, ["day", "first"])
    return out.select(
        F.array_join("raw file paths", ",").alias("paths"),
        segment_text(col("ingested segments")).alias("segments"),
        col("row count"),
        "protocol",
        col("cell id"),
    )


@query(
    "a2_merge_tasks",
    f"""SELECT 'cycling' AS protocol, "cell id", cyc AS "cycle index", sum(n)::BIGINT AS "row count", {PARTS} AS segments,
      string_agg(DISTINCT event_type || '.csv', ',' ORDER BY event_type || '.csv') AS paths,
      'cycling_cell_id-' || "cell id" || '_cycle_index-' || cyc AS task
    FROM (SELECT user_id::VARCHAR AS "cell id", user_id % 4 AS cyc, event_type, date_trunc('day', ts) AS day,
      min(event_id) AS first, count(*) AS n FROM events GROUP BY ALL) GROUP BY "cell id", cyc""",
)
def tasks(spark, d):
    rows = segment_table(spark, d).withColumns(
        {"protocol": F.lit("cycling"), "cycle index": F.col("`cell id`").cast("long") % 4}
    )
    out = M.merge_tasks(rows, P.CYCLING, C.INGESTED_SEGMENTS, ["day", "first"])
    return out.select(
        "protocol",
        col("cell id"),
        col("cycle index"),
        col("row count"),
        segment_text(col("ingested segments")).alias("segments"),
        F.array_join(F.array_sort(col("raw file paths")), ",").alias("paths"),
        F.col("`task id`").alias("task"),
    )


@query(
    "a3_stream_stats",
    """SELECT user_id, event_type, n AS "row count", "column", low AS "min", high AS "max" FROM (
      SELECT user_id, event_type, 'value' AS "column", min(v) AS low, max(v) AS high, any_value(n) AS n FROM (
        SELECT *, CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN NULL ELSE value END AS v,
          count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) GROUP BY 1, 2
      UNION ALL SELECT user_id, event_type, 'event_id', min(event_id), max(event_id), count(*) FROM events GROUP BY 1, 2)
    WHERE low IS NOT NULL""",
)
def stats(spark, d):
    rows = gappy(events(spark, d)).select("user_id", "event_type", "event_id", "value")
    out = M.stream_stats(rows, ["user_id", "event_type"])
    return out.select("user_id", "event_type", col("row count"), F.explode(col("normalized stats")).alias("s")).select(
        "user_id", "event_type", "row count", "s.column", "s.min", "s.max"
    )


@query(
    "a5_grouped_manifest",
    f"""SELECT "cell id", string_agg(protocol, ',' ORDER BY day, protocol, first) AS protocols,
      string_agg(n::VARCHAR, ',' ORDER BY day, protocol, first) AS counts FROM ({SEG_SQL}) GROUP BY 1""",
)
def grouped(spark, d):
    rows = segment_table(spark, d).select("cell id", "protocol", "day", "first", col("row count"))
    out = M.grouped_manifest(rows, ["cell id"], ["day", "protocol", "first"])
    text = F.transform(col("row count"), lambda v: v.cast("string"))
    return out.select(col("cell id"), F.array_join("protocol", ",").alias("protocols"), F.array_join(text, ",").alias("counts"))


@query(
    "a6_merged_entries",
    f"""SELECT protocol, "cell id", sum(n)::BIGINT AS "row count", {PARTS} AS segments FROM ({SEG_SQL}) GROUP BY 1, 2""",
)
def entries(spark, d):
    out = M.merged_entries(segment_table(spark, d), ["protocol", "cell id"], "ingested segments", ["day", "first"])
    return out.select("protocol", col("cell id"), col("row count"), segment_text(col("ingested segments")).alias("segments"))


@query(
    "a9_run_statistics",
    f"""SELECT count(*) FILTER ("row count" >= 12) AS succeeded, count(*) FILTER ("row count" < 12) AS failed,
      sum("row count" % 2)::BIGINT AS warnings, sum("row count" // 5 + 1) FILTER ("row count" >= 12)::BIGINT AS chunks,
      sum("row count") FILTER ("row count" >= 12)::BIGINT AS rows FROM {INDEX}""",
)
def run_stats(spark, d):
    n = F.col("`row count`")
    tasks = stream_index(spark, d).withColumns(
        {"status": F.when(n < 12, "failed").otherwise("succeeded"), "warnings": n % 2, "chunks": F.floor(n / 5) + 1}
    )
    return M.run_statistics(tasks)


@query(
    "a10_common_columns",
    """WITH f AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source),
      t AS (SELECT lang, count(*) AS files FROM f GROUP BY lang),
      c AS (SELECT lang, unnest(CASE WHEN n % 2 = 0 THEN ['text', 'source', 'n_chars']
        ELSE ['text', 'source'] END) AS name FROM f)
    SELECT c.lang AS protocol, c.name AS "column" FROM c JOIN t USING (lang)
      GROUP BY c.lang, c.name, t.files HAVING count(*) = t.files""",
)
def shared_columns(spark, d):
    files = table(spark, d, "documents").groupBy(F.col("lang").alias("protocol"), F.col("source").alias("file path")).agg(
        F.count(F.lit(1)).alias("n")
    )
    names = F.when(F.col("n") % 2 == 0, F.array(*[F.lit(c) for c in ("text", "source", "n_chars")])).otherwise(
        F.array(F.lit("text"), F.lit("source"))
    )
    return M.common_columns(files.select("protocol", "file path", F.explode(names).alias("column")))


@query(
    "j3_overlay_matches",
    f"""SELECT a.protocol, a."cell id", a."cycle index", a."row count" AS shown, b."row count" AS overlay
    FROM {INDEX} a JOIN (SELECT * FROM {INDEX} WHERE "row count" >= 10) b USING (protocol, "cell id", "cycle index")""",
)
def overlays(spark, d):
    index = stream_index(spark, d)
    keys = ["cell id", "cycle index"]
    shown = index.select("protocol", *keys, F.col("`row count`").alias("shown"))
    other = index.filter("`row count` >= 10").select("protocol", *keys, F.col("`row count`").alias("overlay"))
    return matching_overlays(shown, other, keys)


@query(
    "j7_row_lookup",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def lookup(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return key_join(lines, orders, ["l_orderkey"])


@query(
    "j7_lineage_lookup",
    f"""SELECT {STREAM_SQL}, "row count", row_number() OVER (PARTITION BY "dataset id" ORDER BY "cycle index", "cell id", protocol) - 1 AS "row id"
      FROM {INDEX} QUALIFY "row id" % 3 = 1""",
)
def lineage(spark, d):
    """Rows of two manifests by the (manifest path, row id) pairs that windows carry, many times each."""
    index = stream_index(spark, d)
    a, b = (with_manifest_row_ids(index.filter(col("dataset id") == name)) for name in "ab")
    rows = a.unionByName(b).withColumn("manifest path", F.concat(F.lit("dataset="), F.col("`dataset id`"), F.lit("/manifest.parquet")))
    manifest = rows.withColumnRenamed("__manifest_row_id", "row id")
    carried = manifest.filter(F.col("`row id`") % 3 == 1).select("manifest path", "row id", F.explode(F.array_repeat(F.lit(0), 4)))
    found = lineage_lookup(manifest, carried)
    return found.select(*[col(c) for c in STREAM], "row count", "row id")


@query(
    "u3_first_occurrence",
    """SELECT k, row_number() OVER (ORDER BY seen, k) - 1 AS place FROM
      (SELECT l_suppkey AS k, min(l_orderkey * 1000 + l_linenumber) AS seen FROM lineitem GROUP BY l_suppkey)""",
)
def first_seen(spark, d):
    lines = table(spark, d, "lineitem").withColumn("k", F.col("l_suppkey"))
    return first_occurrences(lines, ["k"], ["l_orderkey", "l_linenumber"], "place")


@query(
    "u3_u4_distinct_difference",
    """SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')""",
)
def difference(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    low = table(spark, d, "orders").filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("k"))
    return key_join(lines, low, ["k"], "left_anti")


@query(
    "label_display",
    f"""SELECT DISTINCT 'cell id=' || "cell id" || CASE WHEN "cycle index" % 3 > 0 THEN ' | cycle index=' || "cycle index" ELSE '' END
      AS label, "cell id" || ':' || protocol AS short FROM {INDEX}""",
)
def labels(spark, d):
    rows = stream_index(spark, d)
    some = rows.withColumn("cycle index", F.when(F.col("`cycle index`") % 3 > 0, F.col("`cycle index`")))
    return some.select(
        display_label(["cell id", "cycle index"]).alias("label"),
        group_label(["dataset id", "cell id", "protocol"]).alias("short"),
    ).distinct()


@query(
    "m33_preview_metadata",
    f"""SELECT 'stream' AS scope, 'protocol' AS field, protocol AS value FROM {INDEX}
      UNION ALL SELECT 'stream', 'row count', "row count"::VARCHAR FROM {INDEX}""",
)
def preview(spark, d):
    return preview_metadata(stream_index(spark, d), ["protocol", "row count"], "stream")
