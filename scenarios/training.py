"""Index, split, scaling and window queries on streams derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenarios.common import GAPPY, INDEX, events, gappy, query, rounded, stream_index, table
from streamloom import columns as C
from streamloom.columns import COLUMN_STAT, col
from streamloom.functions.scaling import Scale, inverse_scale, linear_scales, scale
from streamloom.operators.index import (
    INDEX_ROW_ID,
    ValidationSplit,
    assign_splits,
    scaling_violations,
    with_index_row_ids,
    with_manifest_row_ids,
)
from streamloom.operators.ordered import OrderedFrame, position
from streamloom.operators.ranking import digest, digest_rank
from streamloom.operators.select import filter_split
from streamloom.operators.windows import (
    WindowSpec,
    batch_counts,
    missing_shard_columns,
    shuffled_batch_count,
    shuffled_batches,
    stream_plans,
    window_lanes,
    window_lineage,
    window_refs,
    with_phase_plan,
    with_rank,
    with_sequential_plan,
    with_sequential_plan_index,
    with_stateful_groups,
    with_whole_stream_plan,
)
from streamloom.sources.tables import segment_rows, segment_windows

GROUP = ["dataset id", "cell id", "cycle index"]
GROUP_SQL = '"dataset id", "cell id", "cycle index"'
STREAM = [*GROUP, "protocol"]
STREAM_SQL = GROUP_SQL + ", protocol"
DIGEST_SQL = """md5(concat_ws('|', 69, "dataset id", "cell id", "cycle index"))"""
NO_EIS = f"(SELECT * FROM {INDEX} WHERE protocol <> 'EIS')"


def splits(spark, d, **kw):
    out = assign_splits(stream_index(spark, d), ValidationSplit(**kw))
    return out.select(*[col(c) for c in STREAM], "split")


@query(
    "m2_split_sample",
    f"""WITH i AS (SELECT * FROM {INDEX}), g AS (SELECT DISTINCT {GROUP_SQL} FROM i),
      r AS (SELECT *, row_number() OVER (ORDER BY {DIGEST_SQL}, {GROUP_SQL}) AS rn, count(*) OVER () AS n FROM g)
    SELECT {STREAM_SQL}, CASE WHEN rn <= floor(n * 0.2) THEN 'val' ELSE 'train' END AS split
    FROM i JOIN r USING ({GROUP_SQL})""",
)
def split_sample(spark, d):
    return splits(spark, d, strategy="sample", fraction=0.2)


PROVIDED = ({"cell id": ("cell-3", "cell-4")}, {"dataset id": "b", "cell id": "cell-5"})
PROVIDED_SQL = """("cell id" IN ('cell-3', 'cell-4') OR ("dataset id" = 'b' AND "cell id" = 'cell-5'))"""


@query(
    "m2_f7_split_provide",
    f"SELECT {STREAM_SQL}, CASE WHEN {PROVIDED_SQL} THEN 'val' ELSE 'train' END AS split FROM {INDEX}",
)
def split_provide(spark, d):
    return splits(spark, d, strategy="provide", provided=PROVIDED)


@query(
    "m2_j2_split_merge",
    f"""WITH i AS (SELECT * FROM {INDEX}), g AS (SELECT DISTINCT {GROUP_SQL}, {PROVIDED_SQL} AS p FROM i),
      r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY {DIGEST_SQL}, {GROUP_SQL}) AS rn,
        count(*) OVER () AS n, sum(p::INT) OVER () AS k FROM g)
    SELECT {STREAM_SQL}, CASE WHEN p OR rn <= floor(n * 0.4) - k THEN 'val' ELSE 'train' END AS split
    FROM i JOIN r USING ({GROUP_SQL})""",
)
def split_merge(spark, d):
    return splits(spark, d, strategy="merge", fraction=0.4, provided=PROVIDED)


@query(
    "f6_filter_split",
    f"SELECT {STREAM_SQL} FROM {INDEX} WHERE {PROVIDED_SQL}",
)
def val_rows(spark, d):
    return filter_split(splits(spark, d, strategy="provide", provided=PROVIDED), "val").drop("split")


@query(
    "o2_w7_index_row_ids",
    f"""SELECT {STREAM_SQL}, row_number() OVER (ORDER BY {STREAM_SQL}) - 1 AS row_id FROM {INDEX}""",
)
def index_row_ids(spark, d):
    rows = with_index_row_ids(stream_index(spark, d))
    return rows.select(*[col(c) for c in STREAM], F.col(INDEX_ROW_ID).alias("row_id"))


@query(
    "o3_w6_manifest_row_ids",
    f"""SELECT {STREAM_SQL}, row_number() OVER (PARTITION BY "dataset id" ORDER BY "cycle index", "cell id", protocol) - 1 AS row_id
      FROM {INDEX}""",
)
def manifest_row_ids(spark, d):
    index = stream_index(spark, d)
    a, b = (with_manifest_row_ids(index.filter(col("dataset id") == name)) for name in "ab")  # a manifest each
    rows = a.unionByName(b)
    return rows.select(*[col(c) for c in STREAM], F.col("__manifest_row_id").alias("row_id"))


@query(
    "o4_o6_digest_order",
    """SELECT event_id, row_number() OVER (ORDER BY md5(concat_ws('|', 7, 0, event_id)), event_id) - 1 AS place
      FROM events""",
)
def digest_order(spark, d):
    rows = table(spark, d, "events").select("event_id")
    named = rows.withColumn("d", digest(F.lit(7), F.lit(0), F.col("event_id")))
    return digest_rank(named, "d", ["event_id"], "place").select("event_id", "place")


RULES = (
    Scale("l_quantity", (1.0, 50.0)),
    Scale("l_extendedprice", (0.0, 60_000.0), log=True),
    Scale("l_discount", (0.02, 0.08), (0.0, 1.0), clip=True),
)
LOG_HIGH = "ln(1 + 60000.0::DOUBLE)"
LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_SQL = ", ".join(LINE_ID)


@query(
    "m3_scale",
    f"""SELECT {LINE_SQL}, round((l_quantity - 1) / 49.0 * 2 - 1, 6) AS l_quantity,
      round(ln(1 + l_extendedprice) / {LOG_HIGH} * 2 - 1, 6) AS l_extendedprice,
      round(greatest(0, least(1, (l_discount - 0.02) / 0.06)), 6) AS l_discount, l_tax FROM lineitem""",
)
def scaled(spark, d):
    rows = table(spark, d, "lineitem").select(*LINE_ID, *[r.column for r in RULES], "l_tax")
    out = scale(rows, RULES)
    return out.withColumns({r.column: rounded(r.column) for r in RULES})


@query(
    "m4_inverse_scale",
    f"""SELECT {LINE_SQL}, l_quantity, l_extendedprice, round(l_discount * 0.06 + 0.02, 6) AS l_discount
      FROM lineitem""",
)
def inverse(spark, d):
    rows = table(spark, d, "lineitem").select(*LINE_ID, *[r.column for r in RULES])
    there = scale(rows.drop("l_discount"), RULES[:2])
    kept = rows.select(*LINE_ID, "l_quantity", "l_extendedprice", "l_discount")
    both = kept.withColumns({c: RULES[i].forward(F.col(c)) for i, c in enumerate(there.columns[4:])})
    out = inverse_scale(both, RULES)
    return out.withColumns({c: rounded(c, 4) for c in ("l_quantity", "l_extendedprice")}).withColumn(
        "l_discount", rounded("l_discount")
    )


def with_stats(spark, d):
    index = stream_index(spark, d)
    stats = F.array(
        F.struct(F.lit("value").alias("column"), F.col("low").alias("min"), F.col("high").alias("max"))
    )
    some = F.when(F.col("`cycle index`") % 11 != 0, stats.cast(f"array<{COLUMN_STAT.simpleString()}>"))
    return index.withColumn(C.NORMALIZED_STATS.name, some)


@query(
    "m5_m6_scaling_violations",
    f"""SELECT {STREAM_SQL}, "column", problem FROM (
      SELECT *, 'value' AS "column", CASE WHEN "cycle index" % 11 = 0 THEN 'missing stats'
        WHEN low < 0.5 OR high > 150 THEN 'out of bounds' END AS problem FROM {INDEX}
      UNION ALL SELECT *, 'other', 'missing stats' FROM {INDEX}) WHERE problem IS NOT NULL""",
)
def scaling_bounds(spark, d):
    rules = linear_scales({"value": (0.5, 150.0), "other": (0.0, 1.0)})
    rows = scaling_violations(with_stats(spark, d), rules)
    return rows.select(*[col(c) for c in STREAM], "column", "problem")


T = 8


def digest_int(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


IDENT = '"dataset id", "cell id", "cycle index", protocol'
PLANS = f"""(SELECT *, {digest_int("69", IDENT, "'start'")} % {T} AS ps,
    CASE WHEN s0 % 2 = 1 THEN s0 WHEN s0 + 1 < {T} THEN s0 + 1 ELSE 1 END AS st
  FROM (SELECT *, {digest_int("69", IDENT, "'stride'")} % {T - 1} + 1 AS s0 FROM {INDEX} WHERE "row count" > 1))"""


def plans(spark, d):
    return stream_plans(stream_index(spark, d), STREAM, T)


@query(
    "m7_stream_plans",
    f"""SELECT {STREAM_SQL}, ps AS "phase start", st AS "phase stride" FROM {PLANS}""",
)
def planned_streams(spark, d):
    return plans(spark, d).select(*[col(c) for c in STREAM], "phase start", "phase stride")


def refs(planned):
    rows = window_refs(planned, STREAM)
    return rows.select(*[col(c) for c in STREAM], "window number", "window offset")


def offsets_sql(source: str, first: str, stop: str, step: int) -> str:
    return f"""SELECT {STREAM_SQL}, k AS "window number", ({first}) + k * {step} AS "window offset"
      FROM (SELECT *, unnest(range(0, greatest(0, ceil((({stop}) - ({first})) / {float(step)}))::BIGINT)) AS k
        FROM {source})"""


SPEC = WindowSpec(batch_size=2, seq_len=3)
PARTIAL = WindowSpec(batch_size=2, seq_len=3, drop_incomplete=False, step_rows=4)


@query("m8_sequential_offsets", offsets_sql(PLANS, "0", '"row count" - 7 + 1', 6))
def sequential_offsets(spark, d):
    return refs(with_sequential_plan(plans(spark, d), SPEC))


@query("m8_incomplete_offsets", offsets_sql(PLANS, "0", '"row count" - 1', 4))
def incomplete_offsets(spark, d):
    return refs(with_sequential_plan(plans(spark, d), PARTIAL))


@query("m9_phase_offsets", offsets_sql(PLANS, f"(ps + 3 * st) % {T}", f'"row count" - {T}', T))
def phase_offsets(spark, d):
    return refs(with_phase_plan(plans(spark, d), T, epoch=3))


@query("m10_whole_stream_offsets", offsets_sql(PLANS, "0", f'"row count" - {T}', T))
def whole_offsets(spark, d):
    return refs(with_whole_stream_plan(plans(spark, d), T))


def batch_sql(chain: bool, run: int, batch: int = 4) -> str:
    keys = GROUP_SQL if chain else STREAM_SQL
    digest_keys = f"69, 1, {keys}, sg"
    group = "0" if run == -1 else f"ord // {run}"
    step = "ord" if run == -1 else f"ord % {run}"
    length = "n" if run == -1 else str(run)
    full = "true" if run == -1 else f"(sg + 1) * {run} <= n"
    rank = "CASE protocol WHEN 'cycling' THEN 0 WHEN 'HPPC' THEN 1 WHEN 'RPT' THEN 2 ELSE 3 END"
    phase = "0" if run == -1 else f"(ps + 1 * st) % {T}"
    start = f"""sum(steps) OVER (ORDER BY bg) - steps""" if run == -1 else f"bg * {run}"
    return f"""WITH p AS (SELECT * FROM {PLANS} WHERE protocol <> 'EIS'),
      w AS ({offsets_sql("p", phase, f'"row count" - {T}', T)}),
      o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {rank}, "window offset") - 1 AS ord,
        count(*) OVER (PARTITION BY {keys}) AS n FROM w),
      g AS (SELECT *, {group} AS sg, {step} AS step FROM o),
      l AS (SELECT DISTINCT {keys}, sg, {length} AS len FROM g WHERE {full}),
      r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', {digest_keys})), {keys}, sg) - 1 AS rn,
        count(*) OVER () AS total FROM l),
      b AS (SELECT *, rn // {batch} AS bg, rn % {batch} AS lane, min(len) OVER (PARTITION BY rn // {batch}) AS steps
        FROM r WHERE (rn // {batch} + 1) * {batch} <= total),
      s AS (SELECT bg, {start} AS ps FROM (SELECT DISTINCT bg, steps FROM b))
    SELECT {STREAM_SQL}, "window offset", bg AS "batch group", lane, step, steps::BIGINT AS steps,
      (s.ps + step)::BIGINT AS "plan index"
    FROM g JOIN b USING ({keys}, sg) JOIN s USING (bg) WHERE step < steps"""


def batches(spark, d, chain, run, batch=4):
    streams = plans(spark, d).filter("protocol <> 'EIS'")
    planned = with_whole_stream_plan(streams, T) if run == -1 else with_phase_plan(streams, T, 1)
    grouped = with_stateful_groups(planned, GROUP, "protocol", run, chain)
    plan = shuffled_batches(grouped, GROUP, STREAM, batch, run, epoch=1, chain=chain)
    names = ["window offset", "batch group", "lane", "step", "steps", "plan index"]
    return plan.select(*[col(c) for c in STREAM], *names)


@query("m11_m13_batch_plan", batch_sql(False, 2))
def batch_plan(spark, d):
    return batches(spark, d, False, 2)


@query("m12_chained_batch_plan", batch_sql(True, 2))
def chained_plan(spark, d):
    return batches(spark, d, True, 2)


@query("m13_whole_stream_batch_plan", batch_sql(True, -1))
def whole_stream_plan(spark, d):
    return batches(spark, d, True, -1)


@query(
    "m14_batch_counts",
    f"""SELECT (SELECT count(*) FROM ({offsets_sql(PLANS, "0", '"row count" - 7 + 1', 6)})) AS sequential,
      (SELECT count(DISTINCT "plan index") FROM ({batch_sql(False, 2)})) AS shuffled""",
)
def counts(spark, d):
    sequential = batch_counts(with_sequential_plan(plans(spark, d), SPEC))
    planned = with_phase_plan(plans(spark, d).filter("protocol <> 'EIS'"), T, 1)
    shuffled = shuffled_batch_count(planned, STREAM, 4, 2)
    one = F.lit(1).alias("one")
    left = sequential.select(one, F.col("batches").alias("sequential"))
    right = shuffled.select(one, F.col("batches").alias("shuffled"))
    return left.join(right, "one").drop("one")


@query(
    "m15_rank_assignment",
    f"""WITH w AS ({offsets_sql(PLANS, "0", '"row count" - 7 + 1', 6)}),
      i AS (SELECT *, row_number() OVER (ORDER BY {STREAM_SQL}, "window offset") - 1 AS p, count(*) OVER () AS n FROM w)
    SELECT {STREAM_SQL}, "window offset", p AS "plan index", p % 3 AS rank, (p // 3) % 2 AS worker
    FROM i WHERE p < n // 3 * 3""",
)
def ranks(spark, d):
    planned = with_sequential_plan_index(with_sequential_plan(plans(spark, d), SPEC), STREAM)
    rows = window_refs(planned, STREAM).withColumn(
        "plan index", F.col("`plan start`") + F.col("`window number`")
    )
    total = batch_counts(planned).first()[0]
    out = with_rank(rows, 3, 2, total=total)
    return out.select(*[col(c) for c in STREAM], "window offset", "plan index", "rank", "worker")


def user_streams(spark, d):
    frame = OrderedFrame.of(gappy(events(spark, d)), ["user_id"], "t", ["event_id"])
    rows = frame.scan({"pos": position()}).result.withColumn("extra", F.col("event_id") * 0.5)
    streams = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("row count"))
    return rows.select("user_id", "pos", "value", "extra"), streams


def window_rows_sql(spec: WindowSpec) -> str:
    stop = f"n - {spec.rows} + 1" if spec.drop_incomplete else "n - 1"
    rows, t = spec.rows - 1, spec.seq_len
    return f"""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS pos,
        value, event_id * 0.5 AS extra, count(*) OVER (PARTITION BY user_id) AS n FROM {GAPPY}),
      w AS (SELECT user_id, n, k, k * {spec.step} AS o FROM (SELECT user_id, n,
        unnest(range(0, greatest(0, ceil(({stop}) / {float(spec.step)}))::BIGINT)) AS k
        FROM (SELECT DISTINCT user_id, n FROM s))),
      c AS (SELECT w.*, i FROM w, range({rows}) r(i))
    SELECT c.user_id, k AS "window number", i // {t} AS lane, i % {t} AS position,
      round(CASE WHEN x.pos IS NULL THEN -2 WHEN x.value IS NULL OR isnan(x.value) THEN -2 ELSE x.value END, 3) AS value,
      CASE WHEN y.pos IS NULL THEN -2 ELSE y.extra END AS target, o + i + 1 < c.n AS mask
    FROM c LEFT JOIN s x ON x.user_id = c.user_id AND x.pos = o + i
    LEFT JOIN s y ON y.user_id = c.user_id AND y.pos = o + i + 1"""


def window_rows(spark, d, spec):
    rows, streams = user_streams(spark, d)
    planned = with_sequential_plan(streams, spec)
    lanes = window_lanes(rows, planned, ["user_id"], "pos", ["value", "extra"], ["extra"], spec)
    cells = F.posexplode(F.arrays_zip("inputs", "targets", "mask")).alias("position", "cell")
    out = lanes.select("user_id", "window number", "lane", cells)
    return out.select(
        "user_id",
        "window number",
        "lane",
        F.col("position").cast("long").alias("position"),
        rounded(F.col("cell.inputs")[0].cast("double"), 3).alias("value"),
        F.col("cell.targets")[0].cast("double").alias("target"),
        F.col("cell.mask").alias("mask"),
    )


@query("m16_m17_window_rows", window_rows_sql(SPEC))
def full_windows(spark, d):
    return window_rows(spark, d, SPEC)


@query("m17_padded_window_rows", window_rows_sql(PARTIAL))
def padded_windows(spark, d):
    return window_rows(spark, d, PARTIAL)


def user_segments(spark, d):
    """Each user's rows split over files by event type, as manifest segments."""
    per_file = table(spark, d, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), (F.min("event_id")).alias("start")
    )
    segment = F.struct(
        F.concat(F.col("event_type"), F.lit(".parquet")).alias("file path"),
        F.col("start").alias("row start"),
        F.col("n").alias("row count"),
    )
    manifest = per_file.groupBy("user_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    return segment_rows(manifest, "segments", ["user_id"])


SEGMENTS = """s AS (SELECT user_id, event_type || '.parquet' AS f, min(event_id) AS start, count(*) AS n,
    sum(count(*)) OVER (PARTITION BY user_id ORDER BY event_type || '.parquet') - count(*) AS base
    FROM events GROUP BY user_id, event_type)"""
OVERLAPS = f"""WITH {SEGMENTS},
  w AS (SELECT user_id, unnest(range(0, n::BIGINT, 20)) AS o FROM (SELECT user_id, sum(n) AS n FROM s GROUP BY 1)),
  x AS (SELECT w.user_id, o, f, base, greatest(o, base) AS a, least(o + 25, base + n) AS b, start, n
    FROM w JOIN s ON w.user_id = s.user_id AND o < base + n AND o + 25 > base)"""


def windows_of(segments):
    sizes = segments.groupBy("user_id").agg(F.sum("row count").alias("n"))
    offset = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(20).cast("long")))
    return sizes.select("user_id", offset.alias("window offset"), F.lit(25).alias("window rows"))


@query(
    "s4_j4_segment_overlap",
    OVERLAPS
    + """ SELECT user_id, o AS "window offset", f AS "file path", (start + a - base)::BIGINT AS "window row start",
      (b - a)::BIGINT AS "window row count" FROM x""",
)
def segment_overlap(spark, d):
    segments = user_segments(spark, d)
    rows = segment_windows(segments, windows_of(segments), ["user_id"], bucket=16)
    return rows.select("user_id", "window offset", "file path", "window row start", "window row count")


@query(
    "m18_window_lineage",
    OVERLAPS
    + """ SELECT user_id, o AS "window offset",
      string_agg(f || '@' || (start + a - base)::BIGINT || '+' || (b - a)::BIGINT, ',' ORDER BY base) AS parts
      FROM x GROUP BY user_id, o""",
)
def lineage(spark, d):
    segments = user_segments(spark, d)
    rows = window_lineage(segments, windows_of(segments), ["user_id"])
    text = F.transform(
        "segments",
        lambda s: F.concat(
            s["file path"], F.lit("@"), s["window row start"].cast("string"), F.lit("+"), s["window row count"].cast("string")
        ),
    )
    return rows.select("user_id", "window offset", F.array_join(text, ",").alias("parts"))


@query(
    "m19_missing_shard_columns",
    """SELECT source || '/' || lang AS "file path", 'n_chars' AS missing FROM documents GROUP BY 1
      HAVING count(*) % 2 = 1""",
)
def shard_columns(spark, d):
    files = table(spark, d, "documents").groupBy(F.concat_ws("/", "source", "lang").alias("file path")).agg(
        F.count(F.lit(1)).alias("n")
    )
    present = F.when(F.col("n") % 2 == 1, F.array(F.lit("text"))).otherwise(F.array(F.lit("text"), F.lit("n_chars")))
    gaps = missing_shard_columns(files.withColumn("columns", present), ["text", "n_chars"])
    return gaps.select("file path", F.array_join("missing", ",").alias("missing"))
