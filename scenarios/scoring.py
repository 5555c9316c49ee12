"""Encodings, losses, metrics, suffix schedules and rollout queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scenarios.common import E, INDEX, events, query, rounded, stream_index, table
from scenarios.training import STREAM
from streamloom.columns import col
from streamloom.functions.encodings import gaussian_bins, two_hot
from streamloom.functions.scaling import Scale
from streamloom.operators import evaluate as V
from streamloom.operators.explore import window_overlay
from streamloom.operators.ordered import OrderedFrame, lead, position
from streamloom.plans.scoring import check_selectors, run_scoring
from streamloom.session import checkpoint_dir

BINS = 8


def binned(spark, d, encode):
    rows = table(spark, d, "events").select("event_id", encode(F.col("value")).alias("w"))
    cells = rows.select("event_id", F.posexplode("w").alias("bin", "weight"))
    return cells.select("event_id", F.col("bin").cast("long").alias("bin"), rounded("weight").alias("weight"))


SHARE = "(greatest(least(value, 100.0), 5.0) - 5.0) / 95.0"


@query(
    "m20_two_hot",
    f"""SELECT event_id, i AS bin, round(CASE WHEN i = floor(p) THEN 1 - (p - floor(p)) ELSE 0 END
        + CASE WHEN i = ceil(p) THEN p - floor(p) ELSE 0 END, 6) AS weight
      FROM (SELECT event_id, {SHARE} * {BINS - 1} AS p FROM events), range({BINS}) r(i)""",
)
def hot(spark, d):
    return binned(spark, d, lambda v: two_hot(v, F.lit(5.0), F.lit(100.0), BINS))


@query(
    "m21_gaussian_bins",
    f"""WITH g AS (SELECT event_id, i, exp(-pow({SHARE} - i / {float(BINS - 1)}, 2) / (2 * 0.1 * 0.1)) AS w
        FROM events, range({BINS}) r(i))
      SELECT event_id, i AS bin, round(w / sum(w) OVER (PARTITION BY event_id), 6) AS weight FROM g""",
)
def bell(spark, d):
    return binned(spark, d, lambda v: gaussian_bins(v, F.lit(5.0), F.lit(100.0), BINS, 0.1))


RANGES = {"class": (0.0, 9.0), "level": (-1.0, 1.0)}
K = 64


def predictions(spark, d):
    """Two features per vector: its label, and a level that is missing now and then."""
    rows = table(spark, d, "embeddings").select(
        "vec_id",
        (F.col("vec_id") % 5 != 0).alias("mask"),
        F.transform("embedding", lambda v: v * F.lit(20.0)).alias("logits"),
        F.col("label").cast("double").alias("class"),
        F.when(F.col("vec_id") % 7 != 0, F.sin(F.col("vec_id").cast("double"))).otherwise(float("nan")).alias("level"),
    )
    return rows.unpivot(["vec_id", "mask", "logits"], ["class", "level"], "feature", "target")


LOSSES = f"""p AS (SELECT vec_id, vec_id % 5 <> 0 AS mask, embedding AS e, 'class' AS feature, label::DOUBLE AS target,
      0.0::DOUBLE AS lo, 9.0::DOUBLE AS hi FROM embeddings
    UNION ALL SELECT vec_id, vec_id % 5 <> 0, embedding, 'level',
      CASE WHEN vec_id % 7 <> 0 THEN sin(vec_id) ELSE 'nan'::DOUBLE END, -1.0, 1.0 FROM embeddings),
  x AS (SELECT vec_id, feature, mask AND NOT isnan(target) AS valid, target, lo, hi,
      unnest(e)::DOUBLE * 20 AS z, generate_subscripts(e, 1) - 1 AS i FROM p),
  s AS (SELECT *, z - max(z) OVER w - ln(sum(exp(z - mx)) OVER w) AS lp FROM
      (SELECT *, max(z) OVER (PARTITION BY vec_id, feature) AS mx FROM x) WINDOW w AS (PARTITION BY vec_id, feature)),
  l AS (SELECT vec_id, feature, any_value(valid) AS valid, any_value(target) AS target,
      any_value(lo) + sum(exp(lp) * i / {K - 1}.0) * (any_value(hi) - any_value(lo)) AS prediction,
      -sum(lp * greatest(0, 1 - abs((greatest(least(target, hi), lo) - lo) / (hi - lo) * {K - 1} - i))) AS ce
      FROM s GROUP BY vec_id, feature),
  r AS (SELECT *, CASE WHEN valid THEN pow(prediction - target, 2) END AS se FROM l)"""


@query(
    "m22_m23_m24_losses",
    f"""WITH {LOSSES} SELECT vec_id, feature, valid, round(prediction, 4) AS prediction,
      round(CASE WHEN valid THEN ce END, 4) AS ce, round(se, 4) AS se FROM r""",
)
def losses(spark, d):
    rows = V.with_losses(predictions(spark, d), RANGES, K)
    return rows.select(
        "vec_id",
        "feature",
        "valid",
        rounded("prediction", 4).alias("prediction"),
        rounded("ce", 4).alias("ce"),
        rounded("se", 4).alias("se"),
    )


def sums(spark, d):
    rows = V.with_losses(V.first_batches(predictions(spark, d), None), RANGES, K)
    # Partial sums per batch of 50 vectors, merged afterwards.
    named = rows.withColumns(
        {
            "batch": F.floor(F.col("vec_id") / 50),
            "checkpoint": F.concat(F.lit("ck"), (F.col("vec_id") % 2).cast("string")),
            "suffix steps": F.when(F.col("vec_id") % 3 == 0, 4).otherwise(0),
        }
    )
    return V.loss_sums(named, ["batch", "checkpoint", "suffix steps"])


@query(
    "a11_a12_a13_merged_metrics",
    f"""WITH {LOSSES} SELECT feature, round(sum(ce) FILTER (valid) / count(*) FILTER (valid), 4) AS loss,
      round(sqrt(sum(se) / count(*) FILTER (valid)), 4) AS rmse, count(*) FILTER (valid) AS "count"
      FROM r GROUP BY feature
    UNION ALL SELECT 'all', round(sum(ce) FILTER (valid) / count(*) FILTER (valid), 4),
      round(sqrt(sum(se) / count(*) FILTER (valid)), 4), count(*) FILTER (valid) FROM r""",
)
def metrics(spark, d):
    overall, per_feature = V.merge_metrics(sums(spark, d))
    both = per_feature.unionByName(overall.withColumn("feature", F.lit("all")))
    return both.withColumns({"loss": rounded("loss", 4), "rmse": rounded("rmse", 4)})


@query(
    "a13_first_batches",
    f"""WITH {LOSSES} SELECT feature, count(*) FILTER (valid) AS "count" FROM r WHERE vec_id // 50 < 3 GROUP BY feature""",
)
def first_batches(spark, d):
    rows = predictions(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 50))
    scored = V.with_losses(V.first_batches(rows, 3), RANGES, K)
    return V.loss_sums(scored).select("feature", "count")


@query(
    "a14_metrics_table",
    f"""WITH {LOSSES}, n AS (SELECT *, 'ck' || (vec_id % 2) AS checkpoint,
        CASE WHEN vec_id % 3 = 0 THEN 4 ELSE 0 END AS ss FROM r WHERE valid)
    SELECT checkpoint, ss AS "suffix steps", CASE WHEN ss = 0 THEN 'classic' ELSE 'masked_suffix' END AS strategy,
      round(sum(ce) / count(*), 4) AS loss_ce, round(sqrt(sum(se) / count(*)), 4) AS rmse,
      round(avg(ce) FILTER (feature = 'class'), 4) AS "loss_ce/class", round(avg(ce) FILTER (feature = 'level'), 4) AS "loss_ce/level",
      round(sqrt(avg(se) FILTER (feature = 'class')), 4) AS "rmse/class", round(sqrt(avg(se) FILTER (feature = 'level')), 4) AS "rmse/level"
    FROM n GROUP BY checkpoint, ss""",
)
def metric_table(spark, d):
    out = V.metrics_table(sums(spark, d), ["class", "level"])
    return out.withColumns(
        {c: rounded(f"`{c}`", 4) for c in out.columns if c.startswith(("loss", "rmse"))}
    )


@query(
    "q7_scoring_job",
    f"""WITH {LOSSES}, n AS (SELECT *, 'ck' || (vec_id % 2) AS checkpoint,
        CASE WHEN vec_id % 3 = 0 THEN 4 ELSE 0 END AS ss FROM r WHERE valid)
    SELECT checkpoint, ss AS "suffix steps", CASE WHEN ss = 0 THEN 'classic' ELSE 'masked_suffix' END AS strategy,
      round(sum(ce) / count(*), 4) AS loss_ce, round(sqrt(sum(se) / count(*)), 4) AS rmse,
      round(avg(ce) FILTER (feature = 'class'), 4) AS "loss_ce/class", round(avg(ce) FILTER (feature = 'level'), 4) AS "loss_ce/level",
      round(sqrt(avg(se) FILTER (feature = 'class')), 4) AS "rmse/class", round(sqrt(avg(se) FILTER (feature = 'level')), 4) AS "rmse/level"
    FROM n GROUP BY checkpoint, ss""",
)
def scoring_job(spark, d):
    """A first run scores the early batches, a second one those and all later ones into the same sums."""
    rows = predictions(spark, d).withColumns(
        {
            "batch": F.floor(F.col("vec_id") / 50),
            "checkpoint": F.concat(F.lit("ck"), (F.col("vec_id") % 2).cast("string")),
            "suffix steps": F.when(F.col("vec_id") % 3 == 0, 4).otherwise(0),
        }
    )
    streams = stream_index(spark, d)
    selectors = streams.select(*[col(c) for c in STREAM]).withColumn("selector", F.concat_ws("/", *[col(c) for c in STREAM]))
    check_selectors(streams, selectors, STREAM)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/scoring-{uuid.uuid4().hex}"
    run_scoring(rows, folder, RANGES, K, batches=3)
    out = run_scoring(rows, folder, RANGES, K).table(["class", "level"])
    return out.withColumns({c: rounded(f"`{c}`", 4) for c in out.columns if c.startswith(("loss", "rmse"))})


# Suffix settings, one per part size and line number.
SETTINGS = """(SELECT p_partkey AS id, p_size % 7 + 1 AS s, p_size % 23 AS r, 12 + p_size % 5 AS c FROM part)"""


def settings(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        (size % 7 + 1).cast("long").alias("suffix steps"),
        (size % 23).cast("long").alias("roll forward"),
        (size % 5 + 12).cast("long").alias("context"),
    )


@query(
    "m25_suffix_schedule",
    f"""WITH RECURSIVE w AS (
        SELECT id, s, r, c, 0 AS "window", 0 AS start, least(s, c) AS steps, least(s, r) AS nxt, r AS left_over FROM {SETTINGS}
        UNION ALL SELECT id, s, r, c, "window" + 1, start + nxt, least(nxt, c), least(s, left_over - nxt), left_over - nxt
        FROM w WHERE left_over > 0)
    SELECT id, "window"::BIGINT AS "window", start::BIGINT AS start, steps::BIGINT AS steps, nxt::BIGINT AS "next shift",
      (c - steps)::BIGINT AS "input start", (c - steps - 1)::BIGINT AS "prediction start", (c - 1)::BIGINT AS "prediction stop",
      (start + c - steps)::BIGINT AS "write start", (start + c)::BIGINT AS "write stop",
      (start + c - steps - 1)::BIGINT AS "target start", (start + c - 1)::BIGINT AS "target stop" FROM w""",
)
def schedule(spark, d):
    rows = V.suffix_schedule(settings(spark, d))
    names = ["start", "steps", "next shift", "input start", "prediction start", "prediction stop"]
    names += ["write start", "write stop", "target start", "target stop"]
    return rows.select("id", F.col("window").cast("long").alias("window"), *names)


def line_positions(spark, d):
    """Rows of one long batch: position from the order key, two features."""
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 40).alias("position"),
        F.col("l_partkey"),
        (F.col("l_linenumber") != 2).alias("mask"),
        F.col("l_quantity").alias("volt"),
        F.when(F.col("l_discount") > 0.02, F.col("l_tax")).otherwise(float("nan")).alias("temp"),
    )
    return rows.unpivot(["position", "l_partkey", "mask"], ["volt", "temp"], "feature", "target")


@query(
    "m26_suffix_scored",
    """WITH w(k, a, b) AS (VALUES (0, 25, 29), (1, 29, 33), (2, 33, 37), (3, 37, 38)),
      p AS (SELECT l_orderkey % 40 AS pos, l_linenumber <> 2 AS mask, l_discount > 0.02 AS ok FROM lineitem)
    SELECT k AS "window", count(*) AS scored FROM p JOIN w ON pos >= a AND pos < b WHERE mask GROUP BY k""",
)
def suffix_scored(spark, d):
    one = spark.range(1).select(
        F.lit(4).cast("long").alias("suffix steps"), F.lit(9).cast("long").alias("roll forward"), F.lit(30).cast("long").alias("context")
    )
    rows = V.suffix_scored(line_positions(spark, d), V.suffix_schedule(one), ["volt"])
    return rows.groupBy("window").agg(F.count(F.lit(1)).alias("scored"))


def user_rows(spark, d):
    rows = events(spark, d).withColumn("kind", F.col("event_type"))
    scanned = OrderedFrame.of(rows, ["user_id"], "t", ["event_id"]).scan(
        {"position": position(), "next": lead(F.col("value")), "later": lead(F.col("t"))}
    )
    return scanned.result.select("user_id", "position", "value", "next", "t", "later")


POS = f"""SELECT user_id, value, t, row_number() OVER w - 1 AS pos, lead(value) OVER w AS nxt, lead(t) OVER w AS later
    FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)"""


@query(
    "m27_rollout_windows",
    """WITH n AS (SELECT user_id, count(*) AS n, user_id % 80 AS anchor FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN anchor >= 9 AND anchor + 20 < n THEN anchor - 9 ELSE -1 END AS "window offset",
      CASE WHEN anchor < 9 THEN 'incomplete context' WHEN anchor + 20 >= n THEN 'not enough future rows' ELSE 'none' END AS problem
    FROM n""",
)
def rollout_windows(spark, d):
    anchors = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("row count"))
    anchors = anchors.withColumn("anchor", F.col("user_id") % 80)
    good, bad = V.rollout_windows(anchors, context=10, steps=20)
    good = good.withColumn("problem", F.lit("none"))
    bad = bad.withColumn("window offset", F.lit(-1).cast("long"))
    names = ["user_id", "window offset", "problem"]
    return good.select(*names).unionByName(bad.select(*names))


def all_steps(spark, d):
    return user_rows(spark, d).select(
        "user_id",
        "position",
        "value",
        (F.col("later") - F.col("t")).alias("dt"),
        F.col("next").alias("target value"),
        F.lit(True).alias("mask"),
    )


@query(
    "m28_rollout_extension",
    f"""WITH p AS ({POS}), w AS (SELECT user_id, pos, value, nxt, pos < 14 AS mask FROM p WHERE pos < 15)
    SELECT user_id, pos AS position, value, 0.25 AS control, coalesce(round(nxt, 4), -1) AS target, mask FROM w
    UNION ALL SELECT user_id, 15 + k, value, 0.75, -1, false FROM w, range(5) r(k) WHERE pos = 14""",
)
def extension(spark, d):
    rows = all_steps(spark, d).filter("position < 15").drop("dt").withColumn("control", F.lit(0.25))
    rule = Scale("control", (0.0, 20.0), (0.0, 1.0))
    out = V.extended_rollout(
        rows, ["user_id"], ["value", "control"], ["value"], {"control": 15.0}, 10, 5, 5, [rule]
    )
    target = F.when(F.isnan("target value"), -1.0).otherwise(F.coalesce(rounded("`target value`", 4), F.lit(-1.0)))
    return out.select("user_id", "position", "value", "control", target.alias("target"), "mask")


ALIGNED = f"""p AS ({POS}), n AS (SELECT user_id, count(*) AS n, 4 + user_id % 5 AS ts FROM p GROUP BY user_id),
    a AS (SELECT p.user_id, p.pos, CASE WHEN pos >= ts AND pos < least(ts + 6, n) THEN (pos - ts) * 1.0
      ELSE value END AS v FROM p JOIN n USING (user_id))"""


def aligned(spark, d):
    rows = user_rows(spark, d)
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total steps"))
    windows = sizes.withColumn("target start", F.col("user_id") % 5 + 4)
    context = rows.select("user_id", "position", F.col("value").alias("v"))
    rollout = sizes.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("step"))
    rollout = rollout.withColumn("v", F.col("step").cast("double"))
    return V.aligned_predictions(context, rollout, windows, ["user_id"], ["v"])


@query("m29_aligned_predictions", f"""WITH {ALIGNED} SELECT user_id, pos AS position, coalesce(v, -1)::DOUBLE AS v FROM a""")
def alignment(spark, d):
    out = aligned(spark, d)
    return out.withColumn("v", F.when(F.isnan("v"), -1.0).otherwise(F.col("v")))


@query(
    "m30_target_time_axis",
    f"""WITH p AS ({POS}), w AS (SELECT *, greatest(coalesce(later - t, 0), 0) AS dt FROM p),
      e AS (SELECT *, sum(dt) OVER (PARTITION BY user_id ORDER BY pos) - first(dt) OVER (PARTITION BY user_id ORDER BY pos) AS el FROM w)
    SELECT user_id, pos AS position, round(coalesce(lead(el) OVER (PARTITION BY user_id ORDER BY pos), el + dt), 4) AS "target time" FROM e""",
)
def target_time(spark, d):
    rows = all_steps(spark, d).withColumn("dt", F.coalesce("dt", F.lit(0.0)))
    out = V.target_time_axis(rows, ["user_id"], "dt")
    return out.select("user_id", "position", rounded("`target time`", 4).alias("target time"))


@query(
    "m31_comparison_frame",
    f"""WITH {ALIGNED}, q AS (SELECT user_id, pos, v, CASE WHEN pos < 9 THEN value END AS shown, nxt FROM a JOIN p USING (user_id, pos))
    SELECT user_id, pos AS position, coalesce(shown, -1) AS "input::value", coalesce(nxt, -1) AS "target::value",
      coalesce(nxt, -1) AS "base::value", coalesce(v, -1)::DOUBLE AS "prediction::ck::4::value" FROM q""",
)
def comparison(spark, d):
    preds = aligned(spark, d).select(
        "user_id",
        "position",
        F.lit("ck").alias("alias"),
        F.lit(4).alias("suffix steps"),
        F.lit("value").alias("feature"),
        F.col("v").alias("prediction"),
    )
    out = V.comparison_frame(
        all_steps(spark, d), preds, ["user_id"], ["value"], ["value"], [("ck", 4)], ["value"], 9
    )
    shown = [c for c in out.columns if "::" in c]
    return out.withColumns({c: F.coalesce(col(c), F.lit(-1.0)) for c in shown})


@query(
    "m32_common_horizon",
    f"""SELECT least(min("row count" - 3) FILTER ("row count" > 3), 40)::BIGINT AS horizon,
      min("row count" - 3) FILTER ("row count" > 3) < 40 AS clipped, count(*) FILTER ("row count" <= 3) AS "too short" FROM {INDEX}""",
)
def horizon(spark, d):
    return V.common_horizon(stream_index(spark, d), 2, 40, strict=False)


@query(
    "m33_window_overlay",
    f"""WITH p AS ({POS}) SELECT 'input' AS role, user_id, pos AS position, value FROM p WHERE pos >= 5 AND pos < 15
      UNION ALL SELECT 'target', user_id, pos, value FROM p WHERE pos >= 6 AND pos < 16""",
)
def overlay(spark, d):
    rows = user_rows(spark, d)
    parts = [window_overlay(rows, "position", 5, 10, ["user_id", "value"], r) for r in ("input", "target")]
    return parts[0].unionByName(parts[1])
