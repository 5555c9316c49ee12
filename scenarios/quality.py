"""Derivations, checks and annotations on events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenarios.common import E, GAPPY, events, gappy, query, reason_text, rounded, table
from streamloom import columns as C
from streamloom.columns import ColumnSpec
from streamloom.functions.derive import CRate, ImpedanceComponents, negate, replace_zero
from streamloom.functions.values import safe_name, task_id
from streamloom.operators.align import coalesced, union_relaxed, with_resolved_columns
from streamloom.operators.checks import (
    AxisCheck,
    BoundsCheck,
    MissingCheck,
    TimeCheck,
    annotated_aliases,
    annotation_boundaries,
    annotation_catalogue,
    run_checks,
)
from streamloom.operators.ordered import OrderedFrame
from pyspark.sql import types as T

KEY = ["user_id"]
BIG = 43_200.0
CHECKS = (
    MissingCheck(("value",)),
    TimeCheck("t", "dt", max_dt_s=BIG),
    BoundsCheck.of({"value": (5.0, 200.0)}),
)


def ordered(df):
    return OrderedFrame.of(df, KEY, "t", ["event_id"])


def checked(spark, d):
    return run_checks(ordered(gappy(events(spark, d))), CHECKS)


LEAD = f"""SELECT *, lead(t) OVER w - t AS dt,
    coalesce(lag(t) OVER w = t, false) OR coalesce(lead(t) OVER w = t, false) AS dup
  FROM {{src}} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)"""


@query(
    "c2_time_axis_rebuild",
    f"""WITH a AS ({LEAD.format(src=E)}), b AS (SELECT * FROM a WHERE dt > 0)
    SELECT user_id, event_id, round(dt, 6) AS dt,
      round(sum(dt) OVER (PARTITION BY user_id ORDER BY t, event_id) - dt, 5) AS time FROM b""",
)
def time_axis_rebuild(spark, d):
    rows = run_checks(ordered(events(spark, d)), [TimeCheck("t", "dt", None)]).annotated()
    return rows.select("user_id", "event_id", rounded("dt").alias("dt"), rounded("t", 5).alias("time"))


HOURLY = "(SELECT * REPLACE (epoch_us(date_trunc('hour', ts)) / 1e6 AS t) FROM " + E + ")"


@query(
    "c2_duplicate_time_flags",
    f"""WITH a AS ({LEAD.format(src=HOURLY)})
    SELECT user_id, event_id, round(dt, 6) AS dt,
      nullif(concat_ws(';', CASE WHEN dup THEN 't:duplicate time steps' END,
        CASE WHEN dt > {BIG} THEN 'dt:big time diff' END), '') AS reasons FROM a WHERE dt > 0""",
)
def duplicate_time_flags(spark, d):
    from streamloom.functions.values import epoch_seconds

    hourly = events(spark, d).withColumn("t", epoch_seconds(F.date_trunc("hour", "ts")))
    rows = run_checks(ordered(hourly), [TimeCheck("t", "dt", BIG)]).annotated()
    return rows.select(
        "user_id", "event_id", rounded("dt").alias("dt"), reason_text(F.col("annotations")).alias("reasons")
    )


@query(
    "c1_c3_bounds_annotations",
    f"""SELECT event_id, nullif(concat_ws(';',
        CASE WHEN value IS NULL OR isnan(value) THEN 'value:missing' END,
        CASE WHEN NOT isnan(value) AND value < 5 THEN 'value:below column minimum' END,
        CASE WHEN NOT isnan(value) AND value > 200 THEN 'value:above column maximum' END), '') AS reasons
      FROM {GAPPY}""",
)
def bounds_annotations(spark, d):
    frame = OrderedFrame(gappy(events(spark, d)), ("user_id",), "t", ("event_id",), False)
    rows = run_checks(frame, [MissingCheck(("value",)), BoundsCheck.of({"value": (5.0, 200.0)})])
    return rows.annotated().select("event_id", reason_text(F.col("annotations")).alias("reasons"))


LINE_ORDER = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(
    "c4_domain_axis_check",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      coalesce(l_extendedprice - lag(l_extendedprice) OVER ({LINE_ORDER}) <= 0, false) AS invalid
    FROM lineitem""",
)
def domain_axis_check(spark, d):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    frame = OrderedFrame.of(
        table(spark, d, "lineitem").select(*cols), ["l_orderkey"], "l_linenumber", cols[2:]
    )
    rows = run_checks(frame, [AxisCheck("l_extendedprice", enforce_positive=True)]).annotated()
    return rows.select(*cols, F.col("annotations").isNotNull().alias("invalid"))


FLAGGED = f"""SELECT *, value IS NULL OR isnan(value) AS m,
    dt > 0 AND value < 5 AS lo, dt > 0 AND NOT isnan(value) AND value > 200 AS hi
  FROM ({LEAD.format(src=GAPPY)})"""


@query(
    "c5_violation_report",
    f"""WITH a AS ({FLAGGED})
    SELECT DISTINCT user_id, c AS "column", r AS reason FROM (
      SELECT user_id, 'value' AS c, 'missing' AS r FROM a WHERE m
      UNION ALL SELECT user_id, 't', 'duplicate time steps' FROM a WHERE dup
      UNION ALL SELECT user_id, 'dt', 'big time diff' FROM a WHERE dt > {BIG}
      UNION ALL SELECT user_id, 'value', 'below column minimum' FROM a WHERE lo
      UNION ALL SELECT user_id, 'value', 'above column maximum' FROM a WHERE hi)""",
)
def violation_report(spark, d):
    return checked(spark, d).violations()


@query(
    "c6_strict_reject",
    f"""WITH a AS ({LEAD.format(src=E)}),
      bad AS (SELECT DISTINCT user_id FROM a WHERE dup OR dt > 200000 OR (dt > 0 AND value > 300)),
      kept AS (SELECT * FROM a WHERE dt > 0 AND user_id NOT IN (SELECT user_id FROM bad))
    SELECT user_id, event_id, round(dt, 6) AS dt,
      round(sum(dt) OVER (PARTITION BY user_id ORDER BY t, event_id) - dt, 5) AS time FROM kept""",
)
def strict_reject(spark, d):
    checks = [TimeCheck("t", "dt", 200_000.0), BoundsCheck.of({"value": (None, 300.0)})]
    rows = run_checks(ordered(events(spark, d)), checks).strict()
    return rows.select("user_id", "event_id", rounded("dt").alias("dt"), rounded("t", 5).alias("time"))


@query(
    "c8_c9_annotated_rows",
    f"""SELECT user_id, event_id, nullif(concat_ws(';',
        CASE WHEN m THEN 'value:missing' END, CASE WHEN dup THEN 't:duplicate time steps' END,
        CASE WHEN dt > {BIG} THEN 'dt:big time diff' END,
        CASE WHEN lo THEN 'value:below column minimum' END,
        CASE WHEN hi THEN 'value:above column maximum' END), '') AS reasons
      FROM ({FLAGGED}) WHERE dt > 0""",
)
def annotated_rows(spark, d):
    rows = checked(spark, d).annotated()
    return rows.select("user_id", "event_id", reason_text(F.col("annotations")).alias("reasons"))


@query(
    "c10_annotation_catalogue",
    f"""WITH a AS (SELECT * FROM ({FLAGGED}) WHERE dt > 0)
    SELECT DISTINCT c AS "column", r AS reason FROM (
      SELECT 'value' AS c, 'missing' AS r FROM a WHERE m
      UNION ALL SELECT 't', 'duplicate time steps' FROM a WHERE dup
      UNION ALL SELECT 'dt', 'big time diff' FROM a WHERE dt > {BIG}
      UNION ALL SELECT 'value', 'below column minimum' FROM a WHERE lo
      UNION ALL SELECT 'value', 'above column maximum' FROM a WHERE hi)""",
)
def catalogue(spark, d):
    return annotation_catalogue(checked(spark, d).annotated())


RUNS = f"""SELECT user_id, event_id, t, value, hi AS k,
      coalesce(lag(hi) OVER w, false) AS b, coalesce(lead(hi) OVER w, false) AS n
    FROM (SELECT *, coalesce(NOT isnan(value) AND value > 60, false) AS hi FROM {GAPPY})
    WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)"""


@query(
    "c11_c12_annotation_boundaries",
    f"""SELECT user_id, round(t, 6) AS t, value FROM ({RUNS}) WHERE k AND (NOT b OR NOT n)""",
)
def boundaries(spark, d):
    frame = ordered(gappy(events(spark, d)))
    rows = run_checks(frame, [BoundsCheck.of({"value": (None, 60.0)})]).annotated()
    found = annotation_boundaries(ordered(rows), "t", "value", ["value"], C.REASON_ABOVE)
    return found.select("user_id", rounded("t").alias("t"), "value")


@query(
    "c13_annotated_aliases",
    f"""WITH a AS (SELECT * FROM ({FLAGGED}) WHERE dt > 0)
    SELECT r AS reason, string_agg(DISTINCT c, ',' ORDER BY c) AS columns FROM (
      SELECT 'value' AS c, 'missing' AS r FROM a WHERE m
      UNION ALL SELECT 'dt', 'big time diff' FROM a WHERE dt > {BIG}
      UNION ALL SELECT 'value', 'below column minimum' FROM a WHERE lo
      UNION ALL SELECT 'value', 'above column maximum' FROM a WHERE hi) GROUP BY r""",
)
def aliases(spark, d):
    spec = ColumnSpec("signal", T.DoubleType(), ("value", "dt"))
    found = annotated_aliases(annotation_catalogue(checked(spark, d).annotated()), spec)
    return found.select("reason", F.array_join("columns", ",").alias("columns"))


@query(
    "p15_impedance_polar",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS re, l_tax AS im,
      round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS magnitude,
      round(degrees(atan2(l_tax, l_quantity)), 6) AS phase FROM lineitem""",
)
def impedance_polar(spark, d):
    spec = ImpedanceComponents("re", "im", "magnitude", "phase")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("re"), F.col("l_tax").alias("im")
    )
    return spec(rows).withColumns({"magnitude": rounded("magnitude"), "phase": rounded("phase")})


@query(
    "p15_impedance_rectangular",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS magnitude, l_discount * 100 AS phase,
      round(CASE WHEN l_linenumber > 3 THEN coalesce(l_tax, 0)
        ELSE l_quantity * cos(radians(l_discount * 100)) END, 6) AS re,
      round(l_quantity * sin(radians(l_discount * 100)), 6) AS im FROM lineitem""",
)
def impedance_rectangular(spark, d):
    spec = ImpedanceComponents("re", "im", "magnitude", "phase")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").alias("magnitude"),
        (F.col("l_discount") * 100).alias("phase"),
        F.when(F.col("l_linenumber") > 3, F.col("l_tax")).alias("re"),
    )
    return spec(rows).withColumns({"re": rounded("re"), "im": rounded("im")})


@query(
    "p13_p14_c_rate",
    """SELECT event_id, -value AS current, round(coalesce(CASE WHEN event_id % 5 = 0 THEN value END,
      -value / 2.5), 6) AS rate FROM events""",
)
def c_rate(spark, d):
    rows = table(spark, d, "events").select(
        "event_id",
        F.col("value").alias("current"),
        F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("rate"),
    )
    return CRate(2.5, "current", "rate")(negate(rows, "current")).withColumn("rate", rounded("rate"))


@query(
    "p16_p17_axis_values",
    """SELECT l_orderkey, l_linenumber, l_partkey,
      -(CASE WHEN l_tax = 0 THEN 1e-7 ELSE l_tax END) AS tax FROM lineitem""",
)
def axis_values(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_tax").alias("tax")
    )
    return negate(replace_zero(rows, "tax", 1e-7), "tax")


@query(
    "p1_p7_u1_alias_coalesce",
    """SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_acctbal AS balance,
        c_nationkey::BIGINT AS nation, c_mktsegment AS segment FROM customer
      UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, s_nationkey::BIGINT, 'none' FROM supplier""",
)
def alias_coalesce(spark, d):
    specs = [
        ColumnSpec("id", T.LongType(), ("c_custkey", "s_suppkey")),
        ColumnSpec("name", T.StringType(), ("c_name", "s_name")),
        ColumnSpec("balance", T.DoubleType(), ("C_ACCTBAL", "S_ACCTBAL")),
        ColumnSpec("nation", T.LongType(), ("c_nationkey", "s_nationkey")),
    ]
    parts = []
    for kind in ("customer", "supplier"):
        raw = table(spark, d, kind)
        picked = [
            s.expression(s.matching_name(raw.columns)) if s.name == "balance" else coalesced(s, raw.columns)
            for s in specs
        ]
        extra = [F.col("c_mktsegment").alias("segment")] if kind == "customer" else []
        parts.append(raw.select(F.lit(kind).alias("kind"), *picked, *extra))
    return union_relaxed(parts).withColumn("segment", F.coalesce("segment", F.lit("none")))


@query(
    "p8_p10_resolved_columns",
    """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, event_id::DOUBLE)
      AS signal, 2.5 AS capacity, 'unit-7' AS "cell id", NULL::DOUBLE AS absent FROM events""",
)
def resolved_columns(spark, d):
    rows = table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("first"),
        F.col("event_id").cast("double").alias("second"),
    )
    specs = [
        ColumnSpec("signal", T.DoubleType(), ("first", "second")),
        ColumnSpec("capacity", T.DoubleType()),
        C.CELL_ID,
        ColumnSpec("absent", T.DoubleType()),
    ]
    return with_resolved_columns(
        rows, specs, metadata={"capacity": 2.5, "cell id": "unit-7"}, null_for_missing=True
    ).drop("first", "second")


@query(
    "p12_datetime_parse",
    """SELECT event_id, date_trunc('millisecond', ts) AS parsed FROM events""",
)
def datetime_parse(spark, d):
    from streamloom.functions.values import parse_datetime

    text = table(spark, d, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("Date_Time")
    )
    spec = C.DATE_TIME.with_alias("Date_Time").with_parser(parse_datetime())
    return text.select("event_id", spec.expression("Date_Time").alias("parsed"))


@query(
    "label_task_ids",
    """SELECT DISTINCT event_type || '_user_id-' || user_id || '_event_type-' || event_type AS task,
      regexp_replace(event_type || '/' || user_id, '[^a-zA-Z0-9]', '_', 'g') AS safe FROM events""",
)
def label_task_ids(spark, d):
    rows = table(spark, d, "events")
    path = F.concat_ws("/", "event_type", F.col("user_id").cast("string"))
    task = task_id(F.col("event_type"), ["user_id", "event_type"])
    return rows.select(task.alias("task"), safe_name(path).alias("safe")).distinct()
