"""Resampling, viewport and overlay queries on event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenarios.common import E, events, query, rounded, table
from scenarios.quality import HOURLY, KEY, LEAD, ordered
from streamloom.columns import TIME, ColumnSpec
from streamloom.functions.values import epoch_seconds
from streamloom.operators.explore import (
    overlay_trace,
    selected_page,
    selection_total,
    trace_budget,
    viewport_counts,
    viewport_sample,
    with_data_index,
)
from streamloom.operators.ordered import OrderedFrame, position
from streamloom.operators.resample import (
    GridResampling,
    MinMaxLTTB,
    compensated,
    last_per_axis_value,
)
from streamloom.operators.select import viewport_condition
from pyspark.sql import types as T


@query(
    "r1_point_budget",
    """SELECT user_id, count(*) AS n, least(count(*), greatest(3, 16)) AS by_points,
      least(count(*), greatest(3, ceil(count(*) * 0.1)))::BIGINT AS by_ratio FROM events GROUP BY user_id""",
)
def point_budget(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    points, ratio = MinMaxLTTB("t", "value", points=16), MinMaxLTTB("t", "value", points_ratio=0.1)
    return n.withColumns({"by_points": points.budget(F.col("n")), "by_ratio": ratio.budget(F.col("n"))})


@query(
    "r2_tiny_budget",
    f"""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS a,
      row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS b FROM {E})
    WHERE a = 1 OR b = 1""",
)
def tiny_budget(spark, d):
    spec = MinMaxLTTB("t", "value", points=2, min_points=1)
    rows = events(spark, d).select("user_id", "event_id", "t", "value")
    return spec.apply(rows, KEY, ["event_id"]).select("user_id", "event_id")


POINTS = 4
def candidates_sql(points: int) -> str:
    return f"""
  s AS (SELECT user_id, count(*) AS n, min(t) AS lo, max(t) AS hi,
      least(count(*), {points}) AS budget FROM {E} GROUP BY user_id),
  b AS (SELECT e.*, s.n, s.budget, floor(s.n / s.budget) > 4 AS binned,
      row_number() OVER (PARTITION BY e.user_id ORDER BY t, event_id) AS rn,
      least(s.budget * 2 - 1, floor((t - lo) / ((hi - lo) / (s.budget * 2)))) AS bin0
    FROM {E} e JOIN s USING (user_id)),
  c AS (SELECT *, CASE WHEN rn = 1 THEN -1 WHEN rn = n THEN budget * 2 ELSE bin0 END AS bin FROM b),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, bin ORDER BY value, t, event_id) AS a,
      row_number() OVER (PARTITION BY user_id, bin ORDER BY -value, t, event_id) AS z FROM c),
  cand AS (SELECT * FROM r WHERE NOT binned OR a = 1 OR z = 1)"""


@query("r3_minmax_candidates", f"WITH {candidates_sql(POINTS)} SELECT user_id, event_id FROM cand")
def minmax_candidates(spark, d):
    rows = events(spark, d).select("user_id", "event_id", "t", "value")
    spec = MinMaxLTTB("t", "value", points=POINTS)
    return spec.candidates(rows, KEY, ["event_id"]).select("user_id", "event_id")


# The triangle pass as a recursive query: one bucket per step, all users at once.
def lttb_sql(points: int) -> str:
    return f"""WITH RECURSIVE {candidates_sql(points)},
  k AS (SELECT user_id, event_id, t, value, budget,
      row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS ci,
      count(*) OVER (PARTITION BY user_id) AS m FROM cand),
  f AS (SELECT *, CASE WHEN ci = 0 THEN -1 WHEN ci = m - 1 THEN budget - 2
      ELSE len(list_filter(range(0, budget - 2), lambda i: floor((m - 2) / (budget - 2) * i) + 1 <= ci)) - 1
      END AS b FROM k WHERE m > budget),
  avgs AS (SELECT user_id, b, avg(t) AS ax, avg(value) AS ay FROM f GROUP BY user_id, b),
  walk AS (
    SELECT user_id, -1 AS b, event_id, t, value FROM f WHERE ci = 0
    UNION ALL
    SELECT user_id, b, event_id, t, value FROM (
      SELECT f.user_id, f.b, f.event_id, f.t, f.value, row_number() OVER (
          PARTITION BY f.user_id ORDER BY abs((walk.t - ax) * (f.value - walk.value)
            - (walk.t - f.t) * (ay - walk.value)) DESC, f.ci) AS pick
      FROM walk JOIN f ON f.user_id = walk.user_id AND f.b = walk.b + 1 AND f.b <= f.budget - 3
      JOIN avgs ON avgs.user_id = f.user_id AND avgs.b = f.b + 1) WHERE pick = 1)
  SELECT user_id, event_id FROM walk
  UNION ALL SELECT user_id, event_id FROM f WHERE ci = m - 1
  UNION ALL SELECT user_id, event_id FROM k WHERE m <= budget"""


def lttb(spark, d, points):
    rows = events(spark, d).select("user_id", "event_id", "t", "value")
    spec = MinMaxLTTB("t", "value", points=points)
    return spec.apply(rows, KEY, ["event_id"]).select("user_id", "event_id")


@query("r3_lttb_downsample", lttb_sql(POINTS))
def lttb_downsample(spark, d):
    return lttb(spark, d, POINTS)


@query("r3_lttb_without_preselection", lttb_sql(30))
def lttb_without_preselection(spark, d):
    return lttb(spark, d, 30)


COMPENSATED = f"""WITH p AS (SELECT *, row_number() OVER w - 1 AS pos, coalesce(lead(t) OVER w - t, 0) AS dt
        FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
      k AS (SELECT *, sum((pos % 7 = 2)::INT) OVER (PARTITION BY user_id ORDER BY pos) AS iv FROM p),
      g AS (SELECT user_id, iv, arg_min(event_id, pos) AS event_id, sum(dt) AS dt,
        CASE WHEN sum(dt) > 0 THEN sum(value * dt) / sum(dt) ELSE 0 END AS signal FROM k WHERE iv > 0 GROUP BY ALL)
    SELECT user_id, event_id, round(dt, 4) AS dt,
      round(sum(dt) OVER (PARTITION BY user_id ORDER BY iv) - dt, 4) AS time, round(signal, 4) AS signal FROM g"""


def compensated_rows(spark, d, max_rows=None):
    from streamloom.operators.ordered import lead

    source = events(spark, d).select("user_id", "event_id", "t", "value")
    frame = OrderedFrame.of(source, KEY, "t", ["event_id"], max_rows=max_rows)
    frame = frame.scan({"pos": position(), "__next": lead(F.col("t"))})
    frame = frame.with_columns(dt=F.coalesce(F.col("__next") - F.col("t"), F.lit(0.0)), time=F.col("t"))
    rows = compensated(frame, F.pmod("pos", F.lit(7)) == 2, "dt", "time", "value")
    return rows.select(
        "user_id",
        "event_id",
        rounded("dt", 4).alias("dt"),
        rounded("time", 4).alias("time"),
        rounded("value", 4).alias("signal"),
    )


@query("r5_a7_compensated_resample", COMPENSATED)
def compensated_resample(spark, d):
    return compensated_rows(spark, d)


@query("w3_w10_cut_streams", COMPENSATED)
def compensated_in_chunks(spark, d):
    """The same over streams that are cut into chunks of a few rows."""
    return compensated_rows(spark, d, max_rows=8)


GRID = """
  g AS (SELECT user_id, j, CASE WHEN j = 0 THEN lo WHEN j = {last} THEN hi ELSE {inner} END AS x
    FROM (SELECT user_id, min(t) AS lo, max(t) AS hi FROM src GROUP BY user_id), range({n}) r(j)),
  l AS (SELECT g.*, s.t AS lx, s.value AS ly, s.event_type AS lt FROM g ASOF JOIN src s
    ON g.user_id = s.user_id AND g.x >= s.t),
  b AS (SELECT l.*, s.t AS rx, s.value AS ry, s.event_type AS rt FROM l ASOF JOIN src s
    ON l.user_id = s.user_id AND l.x <= s.t)
  SELECT user_id, round(x, 5) AS x, round(CASE WHEN rx = x THEN ry ELSE ly + (ry - ly) / (rx - lx) * (x - lx) END, 4)
    AS value, CASE WHEN rx = x THEN rt WHEN x - lx <= rx - x THEN lt ELSE rt END AS nearest FROM b"""


def gridded(spark, d, spec):
    rows = events(spark, d).select("user_id", "event_id", F.col("t").alias("x"), "value", "event_type")
    rows = rows.withColumn("x", F.col("x") - 1_704_067_200.0 + 1.0)
    out = spec.apply(rows, KEY, ["event_id"])
    return out.select(
        "user_id", rounded("x", 5).alias("x"), rounded("value", 4).alias("value"), F.col("event_type").alias("nearest")
    )


SRC = f"""src AS (SELECT user_id, t - 1704067200.0 + 1.0 AS t, arg_max(value, event_id) AS value,
    arg_max(event_type, event_id) AS event_type FROM {E} GROUP BY 1, 2),"""


@query(
    "r6_r7_r8_linear_resample",
    "WITH " + SRC + GRID.format(n=24, last=23, inner="lo + j * ((hi - lo) / 23.0)"),
)
def linear_resample(spark, d):
    return gridded(spark, d, GridResampling("x", 24))


@query(
    "r6_r7_r8_log_resample",
    "WITH " + SRC + GRID.format(n=24, last=23, inner="pow(10.0, log10(lo) + j / 23.0 * (log10(hi) - log10(lo)))"),
)
def log_resample(spark, d):
    return gridded(spark, d, GridResampling("x", 24, "log"))


@query(
    "r7_fixed_range_extrapolation",
    f"""WITH {SRC} o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS a,
        row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS z FROM src),
      e AS (SELECT user_id, max(t) FILTER (a = 1) AS x1, max(value) FILTER (a = 1) AS y1,
        max(t) FILTER (a = 2) AS x2, max(value) FILTER (a = 2) AS y2,
        max(t) FILTER (z = 1) AS e1, max(value) FILTER (z = 1) AS f1,
        max(t) FILTER (z = 2) AS e2, max(value) FILTER (z = 2) AS f2 FROM o GROUP BY user_id)
    SELECT user_id, -1000.0 AS x, round(y1 + (y2 - y1) / (x2 - x1) * (-1000.0 - x1), 3) AS value FROM e
    UNION ALL SELECT user_id, 3000000.0, round(f1 + (f1 - f2) / (e1 - e2) * (3000000.0 - e1), 3) FROM e""",
)
def fixed_range_extrapolation(spark, d):
    rows = events(spark, d).select("user_id", "event_id", F.col("t").alias("x"), "value")
    rows = rows.withColumn("x", F.col("x") - 1_704_067_200.0 + 1.0)
    out = GridResampling("x", 2, value_range=(-1000.0, 3_000_000.0)).apply(rows, KEY, ["event_id"])
    return out.select("user_id", "x", rounded("value", 3).alias("value"))


@query(
    "a8_last_per_axis_value",
    f"SELECT user_id, t, max(event_id) AS event_id FROM {HOURLY} GROUP BY user_id, t",
)
def last_per_axis(spark, d):
    hourly = events(spark, d).withColumn("t", epoch_seconds(F.date_trunc("hour", "ts")))
    rows = last_per_axis_value(hourly.select("user_id", "event_id", "t"), KEY, "t", ["event_id"])
    return rows.select("user_id", "t", "event_id")


X_RANGE, Y_RANGE = (1_705_000_000.0, 1_704_300_000.0), (5.0, 80.0)
INSIDE = f"t BETWEEN {min(X_RANGE)} AND {max(X_RANGE)} AND value BETWEEN {Y_RANGE[0]} AND {Y_RANGE[1]}"


@query("f4_viewport_filter", f"SELECT event_id FROM {E} WHERE {INSIDE}")
def viewport_filter(spark, d):
    rows = events(spark, d).filter(viewport_condition("t", "value", X_RANGE, Y_RANGE))
    return rows.select("event_id")


@query(
    "r11_a15_viewport_counts",
    f"""SELECT user_id, count(*) AS "rows in range", least(count(*), 6) AS "shown points",
      count(*) > 6 AS downsampled FROM {E} WHERE {INSIDE} GROUP BY user_id""",
)
def viewport_shown(spark, d):
    rows = events(spark, d)
    sample = viewport_sample(rows, KEY, "t", "value", 6, ["event_id"], X_RANGE, Y_RANGE, ["event_type"])
    return viewport_counts(rows, sample, KEY, "t", "value", X_RANGE, Y_RANGE)


@query(
    "r12_trace_budget",
    """SELECT event_type, greatest(1, least(1000, floor(5000 / count(DISTINCT user_id))))::BIGINT AS budget
    FROM events GROUP BY event_type""",
)
def budget_per_trace(spark, d):
    visible = table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))
    return visible.select("event_type", trace_budget(1000, 5000, F.col("n")).alias("budget"))


@query(
    "r14_overlay_time",
    f"""WITH a AS ({LEAD.format(src=E)}), b AS (SELECT * FROM a WHERE dt > 0)
    SELECT user_id, round(sum(dt) OVER (PARTITION BY user_id ORDER BY t, event_id) - dt, 5) AS time,
      value AS signal FROM b""",
)
def overlay_time(spark, d):
    rows = events(spark, d).select("user_id", "event_id", F.col("t").alias("secs"), F.col("value").alias("volts"))
    out = overlay_trace(
        rows, KEY, TIME.with_alias("secs"), ColumnSpec("signal", T.DoubleType(), ("volts",)), ties=["event_id"]
    )
    return out.select("user_id", rounded("`Time [s]`", 5).alias("time"), "signal")


@query(
    "w8_w9_data_index",
    f"""SELECT event_id, event_type AS trace,
      row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS "data index" FROM {E}""",
)
def data_index(spark, d):
    return indexed(spark, d).select("event_id", "trace", "data index")


def indexed(spark, d):
    rows = events(spark, d).withColumn("trace", F.col("event_type"))
    return with_data_index(OrderedFrame.of(rows, ["trace"], "t", ["event_id"])).result


@query(
    "o5_o7_selected_page",
    f"""WITH i AS (SELECT event_id, event_type AS trace,
        row_number() OVER (ORDER BY event_type = 'click', t, event_id) - 1 AS "row number"
        FROM {E} WHERE event_type IN ('view', 'click'))
    SELECT event_id, trace, "row number" FROM i WHERE "row number" >= 700 AND "row number" < 2700""",
)
def page(spark, d):
    rows = selected_page(indexed(spark, d), ["view", "click"], offset=700, limit=2000)
    return rows.select("event_id", "trace", "row number")


@query(
    "a15_selection_total",
    "SELECT count(*) AS rows FROM events WHERE event_type IN ('view', 'click')",
)
def page_total(spark, d):
    return selection_total(table(spark, d, "events").withColumn("trace", F.col("event_type")), ["view", "click"])
