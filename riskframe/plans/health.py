"""Bound log health, traffic and paging queries (H1-H9, O2, O3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import specs
from riskframe.operators import health as H
from riskframe.plans.common import r6
from riskframe.plans.registry import register
from riskframe.sources import bindings as B
from riskframe.sources.bindings import oracle

CAT = list(B.LOG_ROLES.categorical)
NULLABLE = ["mths_since_last_delinq", "mths_since_last_record"]
# Payload = every log column except the excluded ones (reason_codes is excluded; props is its raw text).
PAYLOAD = ["issue_d", "loan_amnt", "annual_inc", "dti", "revol_util", "pub_rec", "delinq_2yrs", "mths_since_last_delinq",
           "mths_since_last_record", "fico_range_low", "fico_range_high", "earliest_cr_line", "term", "purpose", "addr_state",
           "emp_length", "home_ownership"]


def _logs(spark, sf):
    return B.prediction_logs(spark, sf)


@register(
    "H1_null_rates",
    oracle(" UNION ALL ".join(f"SELECT '{c}' AS column, round(1 - count({c}) / count(*), 6) AS null_rate FROM logs" for c in NULLABLE), "logs"),
)
def q_h1(spark, sf):
    return r6(H.null_rates(_logs(spark, sf), NULLABLE))


@register(
    "H2_rare_categories",
    oracle(" UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS category, count(*) AS count FROM logs WHERE {c} IS NOT NULL "
        f"GROUP BY {c} HAVING count(*) <= {specs.SINGLETON_COUNT_THRESHOLD}" for c in CAT), "logs"),
)
def q_h2(spark, sf):
    return H.rare_categories(_logs(spark, sf), CAT)


_DUP = f"""SELECT CAST(count(*) AS BIGINT) AS duplicate_payload_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_payload_extra_rows
FROM (SELECT count(*) AS n FROM logs GROUP BY {", ".join(PAYLOAD)} HAVING count(*) > 1) g"""


@register("H3_duplicate_payloads", oracle(_DUP, "logs"))
def q_h3(spark, sf):
    return H.duplicate_payloads(_logs(spark, sf).drop("prob", "pred"))


_SHARED = """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_logged_at_count
FROM (SELECT count(*) AS n FROM logs GROUP BY logged_at HAVING count(*) > 1) g"""


@register("H4_shared_timestamps", oracle(_SHARED, "logs"))
def q_h4(spark, sf):
    return H.shared_timestamps(_logs(spark, sf))


_BURST = """SELECT CAST(count(DISTINCT date_trunc('hour', logged_at)) AS BIGINT) AS distinct_hours,
  CAST(floor((epoch_us(max(logged_at)) - epoch_us(min(logged_at))) / 3600000000) + 1 AS BIGINT) AS span_hours,
  round(count(DISTINCT date_trunc('hour', logged_at)) / (floor((epoch_us(max(logged_at)) - epoch_us(min(logged_at))) / 3600000000) + 1), 6) AS active_ratio,
  coalesce(count(*) > 0 AND count(DISTINCT date_trunc('hour', logged_at)) / (floor((epoch_us(max(logged_at)) - epoch_us(min(logged_at))) / 3600000000) + 1) < 0.5, false) AS scripted_traffic
FROM logs"""


@register("H6_burst_ratio", oracle(_BURST, "logs"))
def q_h6(spark, sf):
    return r6(H.burst_ratio(_logs(spark, sf)))


@register("H6_burst_ratio_daily_batches", oracle(
    _BURST.replace("FROM logs", "FROM (SELECT date_trunc('day', logged_at) + INTERVAL 3 HOUR AS logged_at FROM logs) b"), "logs"))
def q_h6_sparse(spark, sf):
    # All records, as a nightly batch would log them (03:00 of their day): one active hour a day.
    return r6(H.burst_ratio(_nightly(_logs(spark, sf))))


def _nightly(logs):
    return logs.withColumn("logged_at", (F.date_trunc("day", F.col("logged_at")).cast("timestamp_ntz") + F.expr("INTERVAL 3 HOUR")))


def _outlier_count_sql() -> str:
    arms = " UNION ALL ".join(
        f"SELECT request_id, logged_at, '{f}' AS feature FROM logs WHERE {f} > {b}" for f, b in specs.OUTLIER_RULES.items())
    return (f"(SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY feature ORDER BY logged_at, request_id) AS rn "
            f"FROM ({arms}) u) t WHERE rn <= {specs.OUTLIER_LIST_LIMIT})")


_RARE_COUNT = "(SELECT count(*) FROM (" + " UNION ALL ".join(
    f"SELECT {c} FROM logs WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) <= {specs.SINGLETON_COUNT_THRESHOLD}" for c in CAT) + ") r)"


@register(
    "H7_data_health",
    oracle(f"""SELECT (SELECT count(*) FROM logs) AS n_rows, d.duplicate_payload_groups, d.duplicate_payload_extra_rows,
  s.duplicate_logged_at_count, b.distinct_hours, b.span_hours, b.scripted_traffic,
  {_RARE_COUNT} AS n_rare_categories, {_outlier_count_sql()} AS n_outliers_listed
FROM ({_DUP}) d, ({_SHARED}) s, ({_BURST}) b""", "logs"),
)
def q_h7(spark, sf):
    return H.data_health(_logs(spark, sf).drop("prob", "pred"), CAT)


@register(
    "H8_J8_hourly_traffic",
    oracle("""SELECT h.hour_start, CAST(count(l.logged_at) AS BIGINT) AS count
FROM (SELECT unnest(range(TIMESTAMP '2024-01-29 01:00:00', TIMESTAMP '2024-01-31 00:00:00' + INTERVAL 1 SECOND, INTERVAL 1 HOUR)) AS hour_start) h
LEFT JOIN logs l ON date_trunc('hour', l.logged_at) = h.hour_start
  AND l.logged_at >= TIMESTAMP '2024-01-29 01:00:00' AND l.logged_at <= TIMESTAMP '2024-01-31 01:00:00'
GROUP BY h.hour_start""", "logs"),
)
def q_h8(spark, sf):
    buckets, _flag = H.hourly_traffic(_logs(spark, sf), B.LOG_AS_OF, 48)
    return buckets


@register(
    "H8_hourly_traffic",
    oracle("""SELECT count(*) AS n_hours, count(*) FILTER (WHERE c > 0) AS nonzero_hours, count(*) > 0 AND count(*) FILTER (WHERE c > 0) / count(*) < 0.3 AS is_bursty
FROM (SELECT h.hour_start, count(l.logged_at) AS c
FROM (SELECT unnest(range(TIMESTAMP '2024-01-01 01:00:00', TIMESTAMP '2024-01-31 00:00:00' + INTERVAL 1 SECOND, INTERVAL 1 HOUR)) AS hour_start) h
LEFT JOIN (SELECT date_trunc('day', logged_at) + INTERVAL 3 HOUR AS logged_at FROM logs) l ON date_trunc('hour', l.logged_at) = h.hour_start
  AND l.logged_at >= TIMESTAMP '2024-01-01 01:00:00' AND l.logged_at <= TIMESTAMP '2024-01-31 01:00:00'
GROUP BY h.hour_start) x""", "logs"),
)
def q_h8_flag(spark, sf):
    _buckets, flag = H.hourly_traffic(_nightly(_logs(spark, sf)), B.LOG_AS_OF, 720)
    return flag.withColumn("n_hours", F.col("n_hours").cast("bigint"))


@register(
    "H9_O2_list_predictions_page",
    oracle("""SELECT request_id, logged_at, prob, (SELECT count(*) FROM logs WHERE pred = 1 AND purpose = 'view') AS total
FROM logs WHERE pred = 1 AND purpose = 'view' ORDER BY logged_at DESC, request_id DESC LIMIT 25 OFFSET 50""", "logs"),
)
def q_h9(spark, sf):
    return H.list_predictions(_logs(spark, sf), offset=50, limit=25, pred=1, purpose="view").select(
        "request_id", "logged_at", "prob", "total")


@register(
    "O3_latest_record",
    oracle("SELECT request_id, logged_at, prob, pred FROM logs ORDER BY logged_at DESC, request_id DESC LIMIT 1", "logs"),
)
def q_o3(spark, sf):
    return H.latest(_logs(spark, sf).select("request_id", "logged_at", "prob", "pred"))
