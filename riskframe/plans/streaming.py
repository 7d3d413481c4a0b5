"""Bound streaming jobs (X1-X6): each runs to completion on staged files and
returns its sink read back as a batch DataFrame, so batch SQL can check it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators import ml as L
from riskframe.operators.drift_state import DriftState
from riskframe.plans.checks import EVENT_TYPES
from riskframe.plans.drift import LIVE_CAT, LIVE_NUM, reference_profile, report_sql
from riskframe.plans.registry import register
from riskframe.sources import bindings as B
from riskframe.sources.bindings import oracle
from riskframe.streaming import jobs as X

DELAY = "2 days"  # far shorter than the data (30 days): windows close, and the rows held back to the last drop are late
DROPS, FILES = 6, 4  # a trigger reads the files of one drop
TRIGGERS = 4  # of the scoring stream, however many files its requests lie in


def _events_stream(spark, sf, name):
    ev = B.table(spark, sf, "events")
    path = X.stage_event_files(spark, ev, X.scratch(spark, f"{name}-src"), DROPS, files_per_drop=FILES)
    schema = T.StructType([*ev.schema.fields, T.StructField("drop", T.IntegerType())])
    return X.read_stream(spark, path, schema, FILES, event_time="ts").drop("drop")


def _on_time_stream(spark, sf, name):
    """(stream of the rows that are on time, folder of the late ones)."""
    src = _events_stream(spark, sf, name)
    on_time, late = X.scratch(spark, f"{name}-on-time"), X.scratch(spark, f"{name}-late")
    X.split_late(src, "ts", DELAY, on_time, late, X.scratch(spark, f"{name}-marks"), X.scratch(spark, f"{name}-split-ckpt"))
    return spark.readStream.schema(src.schema).option("maxFilesPerTrigger", FILES).parquet(on_time), late


def _run(spark, df, name, mode="append"):
    out = X.scratch(spark, f"{name}-out")
    X.run_available(df, out, X.scratch(spark, f"{name}-ckpt"), mode)
    return out


_WITH_DUPS = "SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 50 = 0 AND event_id % 97 <> 0"
# The staging rule, and the rule of lateness by drop: s holds the rows that are on time, wm the last watermark.
_STAGED = {
    "sl": f"""SELECT *, least(CAST(floor((CAST(epoch_us(ts) AS DOUBLE) - (SELECT min(CAST(epoch_us(ts) AS DOUBLE)) FROM events))
  / ((SELECT max(CAST(epoch_us(ts) AS DOUBLE)) FROM events) - (SELECT min(CAST(epoch_us(ts) AS DOUBLE)) FROM events) + 1.0) * {DROPS}.0) AS INTEGER), {DROPS - 1}) AS slice
FROM events""",
    "st": f"""SELECT * EXCLUDE (slice), CASE WHEN event_id % 97 = 0 THEN {DROPS - 1} ELSE slice END AS d FROM sl
UNION ALL SELECT * EXCLUDE (slice), least(slice + 1, {DROPS - 1}) AS d FROM sl WHERE event_id % 50 = 0 AND event_id % 97 <> 0""",
    "mk": f"SELECT r.d, (SELECT max(ts) FROM st WHERE st.d < r.d) - INTERVAL {DELAY} AS edge FROM (SELECT DISTINCT d FROM st) r",
    "s": "SELECT st.* FROM st JOIN mk ON mk.d = st.d WHERE mk.edge IS NULL OR st.ts >= mk.edge",
    "wm": f"SELECT max(ts) - INTERVAL {DELAY} AS t FROM st",
}


@register(
    "X2_hourly_counts_stream",
    oracle("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS count "
           "FROM s GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT t FROM wm)", extra=_STAGED),
)
def q_x2(spark, sf):
    """Closed hours; an hour closes when the watermark passes its end."""
    src, _ = _on_time_stream(spark, sf, "x2")
    out = _run(spark, X.hourly_counts(src, "ts", DELAY), "x2")
    return X.wall_clock(spark.read.parquet(out).drop("batch_id"), "window_start", "window_end")


@register("X2_late_rows", oracle("SELECT st.event_id, st.ts, CAST(st.d AS INTEGER) AS batch_id FROM st JOIN mk ON mk.d = st.d WHERE st.ts < mk.edge", extra=_STAGED))
def q_x2_late(spark, sf):
    """The side output: rows that came too late, with the batch they came in."""
    _, late = _on_time_stream(spark, sf, "x2l")
    return X.wall_clock(spark.read.parquet(late).select("event_id", "ts", F.col("batch_id").cast("int").alias("batch_id")), "ts")


@register("X3_dedupe_stream", oracle("SELECT DISTINCT event_id, ts FROM s", extra=_STAGED))
def q_x3(spark, sf):
    src, _ = _on_time_stream(spark, sf, "x3")
    out = _run(spark, X.dedupe(src, "event_id", "ts", DELAY).select("event_id", "ts"), "x3")
    return X.wall_clock(spark.read.parquet(out).drop("batch_id"), "ts")


@register(
    "X5_running_scores_stream",
    oracle("""SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, CAST(count(*) FILTER (WHERE value / 500.0 >= 0.16) AS BIGINT) AS n_pred_1
FROM (SELECT value, (SELECT count(*) FROM range(1, 30) r(i) WHERE CAST(i AS DOUBLE) * (1.0 / 30) <= value / 500.0) AS bin FROM s
      WHERE value / 500.0 >= 0 AND value / 500.0 <= 1) x GROUP BY bin""", extra={"s": _WITH_DUPS}),
)
def q_x5(spark, sf):
    src = _events_stream(spark, sf, "x5").withColumn("prob", F.col("value") / F.lit(500.0))
    out = _run(spark, X.running_scores(src, "prob", 30, B.LOG_THRESHOLD).filter(F.col("bin").isNotNull()), "x5", "complete")
    return X.last_batch(spark, out).withColumn("bin", F.col("bin").cast("int"))


@register(
    "X6_sliding_counts_stream",
    oracle("""SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, count(*) AS count FROM (
  SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS ws FROM s, range(0, 4) r(k)) x
GROUP BY ws HAVING ws + INTERVAL 1 HOUR <= (SELECT t FROM wm)""", extra=_STAGED),
)
def q_x6(spark, sf):
    src, _ = _on_time_stream(spark, sf, "x6")
    out = _run(spark, X.sliding_counts(src, "ts", "1 hour", "15 minutes", DELAY), "x6")
    return X.wall_clock(spark.read.parquet(out).drop("batch_id"), "window_start", "window_end")


@register(
    "X6_sessions_stream",
    oracle("""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS count
FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                            OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new
            FROM s) a) b GROUP BY user_id, sid HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT t FROM wm)""", extra=_STAGED),
)
def q_sessions(spark, sf):
    src, _ = _on_time_stream(spark, sf, "x6s")
    out = _run(spark, X.sessions(src, "user_id", "ts", "30 minutes", DELAY), "x6s")
    return X.wall_clock(spark.read.parquet(out).drop("batch_id"), "session_start", "session_end")


def _card_sql(feats):
    med = " UNION ALL ".join(f"SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median FROM tr" for c in feats)
    card = " UNION ALL ".join(f"""SELECT '{c}' AS feature, m.median, avg(coalesce(CAST(t.{c} AS DOUBLE), m.median)) AS mean,
  CASE WHEN stddev_pop(coalesce(CAST(t.{c} AS DOUBLE), m.median)) = 0 THEN 1.0 ELSE stddev_pop(coalesce(CAST(t.{c} AS DOUBLE), m.median)) END AS std,
  coalesce(corr(coalesce(CAST(t.{c} AS DOUBLE), m.median), CAST(t.target AS DOUBLE)), 0) AS weight
FROM tr t, med m WHERE m.feature = '{c}' GROUP BY m.median""" for c in feats)
    contrib = " UNION ALL ".join(f"""SELECT l.request_id AS id, c.weight * (coalesce(CAST(l.{c} AS DOUBLE), c.median) - c.mean) / c.std AS value
FROM lv l, card c WHERE c.feature = '{c}'""" for c in feats)
    return {"tr": "SELECT * FROM labelled WHERE split = 'train'", "med": med, "card": card,
            "lv": "SELECT * FROM logs WHERE NOT (request_id % 89 = 0 OR request_id % 97 = 0 OR request_id % 83 = 0 OR request_id % 79 = 0)",
            "contrib": contrib}


SCORE_FEATS = ["loan_amnt", "annual_inc", "dti", "mths_since_last_delinq"]


@register(
    "X1_scoring_stream",
    oracle("SELECT id AS request_id, round(1 / (1 + exp(-sum(value))), 6) AS p, CAST(1 / (1 + exp(-sum(value))) >= 0.5 AS INTEGER) AS pred "
           "FROM contrib GROUP BY id", "labelled", "logs", extra=_card_sql(SCORE_FEATS)),
)
def q_x1(spark, sf):
    from riskframe.operators import checks as V
    from riskframe.plans.checks import requests
    from riskframe.plans.common import r6

    lab = B.labelled(spark, sf)
    card = L.fit_scorecard(lab.filter(F.col("split") == "train"), SCORE_FEATS)
    req = requests(spark, sf)
    src_path = X.scratch(spark, "x1-src")
    req.withColumn("__d", F.col("request_id") % 4).write.partitionBy("__d").parquet(src_path)
    schema = "request_id long, payload string, __d int"
    files = len(spark.read.schema(schema).parquet(src_path).inputFiles())  # one task of the write leaves up to 4
    stream = X.read_stream(spark, src_path, schema, X.files_per_trigger(files, TRIGGERS))

    def validate(batch):
        return V.validate_requests(batch, "payload", SCORE_FEATS, nullable=["mths_since_last_delinq"], dates=["earliest_cr_line"],
                                   enums={"term": [" 36 months", " 60 months"], "purpose": EVENT_TYPES})

    def score(valid):
        s = L.scorecard_scores(L.scorecard_rows(valid, card, "request_id", SCORE_FEATS))
        return s.select(F.col("id").alias("request_id"), "p", (F.col("p") >= F.lit(0.5)).cast("int").alias("pred"))

    scores, log = X.scratch(spark, "x1-scores"), X.scratch(spark, "x1-log")
    X.score_stream(stream, validate, score, scores, log, X.scratch(spark, "x1-q"), X.scratch(spark, "x1-status"), X.scratch(spark, "x1-ckpt"))
    return r6(spark.read.parquet(scores).drop("batch_id"))


@register(
    "X4_drift_snapshot_stream",
    report_sql("SELECT * FROM labelled WHERE split = 'train'", "SELECT *, 'live' AS target_label FROM logs", LIVE_NUM, LIVE_CAT,
               needs=("labelled", "logs")),
)
def q_x4(spark, sf):
    from riskframe.plans.common import r6

    logs = B.prediction_logs(spark, sf)
    src_path = X.scratch(spark, "x4-src")
    logs.withColumn("__d", F.dayofmonth("logged_at") % 3).write.partitionBy("__d").parquet(src_path)
    stream = spark.readStream.schema(spark.read.parquet(src_path).schema).option("maxFilesPerTrigger", 2).parquet(src_path)
    log_path, snaps = X.scratch(spark, "x4-log"), X.scratch(spark, "x4-snap")
    state = DriftState(spark, X.scratch(spark, "x4-state")).fit(reference_profile(spark, sf).of(LIVE_NUM, LIVE_CAT))
    X.snapshot_stream(stream, state, log_path, snaps, X.scratch(spark, "x4-ckpt"), compact_every=2)
    s = spark.read.parquet(snaps)
    last = s.agg(F.max("batch_id")).scalar()
    return r6(s.filter(F.col("batch_id") == last).select("feature", "PSI", "drift_level", "target_label"))
