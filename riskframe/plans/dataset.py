"""Bound dataset-build and log-filter queries (P1-P20, A3 flagship, S2, S8)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from riskframe import specs
from riskframe.functions import exprs
from riskframe.operators import prep
from riskframe.plans.registry import register
from riskframe.sources import bindings as B
from riskframe.sources.bindings import oracle

LOAN_COLS = [
    "loan_id", "issue_d", "loan_status", "term", "loan_amnt", "annual_inc", "dti", "revol_util",
    "mths_since_last_delinq", "earliest_cr_line", "fico_range_low", "fico_range_high", "purpose",
    "addr_state", "verification_status", "emp_length",
]


@register(
    "A3_split_default_rates",
    oracle(
        "SELECT split, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS n_bad, "
        "round(avg(target), 6) AS default_rate FROM labelled GROUP BY split",
        "labelled",
    ),
)
def split_default_rates(spark, sf):
    from riskframe.operators.profile import class_balance

    return class_balance(B.labelled(spark, sf), "target", by="split")


@register("S3_dataset_build", oracle("SELECT * FROM labelled", "labelled"))
def q_build(spark, sf):
    """The full dataset build (window, label, split, derived columns) computed from the raw tables."""
    return B.build_labelled(spark, sf)


@register("P1_snapshot_date", oracle("SELECT max(issue_d) AS snapshot_date FROM loans", "loans"))
def q_snapshot(spark, sf):
    return prep.snapshot_frame(B.loans(spark, sf), "issue_d")


@register("P2_observation_window", oracle("SELECT * FROM windowed", "windowed"))
def q_window(spark, sf):
    return prep.observation_window(B.loans(spark, sf), "issue_d", B.WINDOW_MONTHS)


@register(
    "P3_loan_age_months",
    oracle(
        "SELECT loan_id, (SELECT year(max(issue_d)) * 12 + month(max(issue_d)) FROM loans) "
        "- (year(issue_d) * 12 + month(issue_d)) AS loan_age_months FROM loans",
        "loans",
    ),
)
def q_loan_age(spark, sf):
    return prep.loan_age_months(B.loans(spark, sf), "issue_d").select("loan_id", "loan_age_months")


@register("P4_drop_leakage", oracle("SELECT * EXCLUDE (last_pymnt_d) FROM loans", "loans"))
def q_drop_leakage(spark, sf):
    return prep.drop_leakage(B.loans(spark, sf), specs.LEAKAGE_COLUMNS)


_LABEL_SQL = (
    "SELECT loan_id, CASE WHEN loan_status IN ({bad}) THEN 1 ELSE 0 END AS target FROM windowed "
    "WHERE NOT coalesce(loan_status IN ({amb}), false)"
).format(
    bad=", ".join(f"'{s}'" for s in specs.LabelSpec().bad),
    amb=", ".join(f"'{s}'" for s in specs.LabelSpec().ambiguous),
)


@register("P5_label_loans", oracle(_LABEL_SQL, "windowed"))
def q_label(spark, sf):
    df = prep.observation_window(B.loans(spark, sf), "issue_d", B.WINDOW_MONTHS)
    return prep.label_loans(df).select("loan_id", "target")


@register(
    "P6_label_resolved_only",
    oracle(
        "SELECT loan_id, CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS target FROM windowed "
        "WHERE loan_status IN ('Fully Paid', 'Charged Off')",
        "windowed",
    ),
)
def q_label_resolved(spark, sf):
    df = prep.observation_window(B.loans(spark, sf), "issue_d", B.WINDOW_MONTHS)
    return prep.label_resolved_only(df).select("loan_id", "target")


@register("P7_temporal_split", oracle("SELECT loan_id, split FROM labelled", "labelled"))
def q_split(spark, sf):
    return B.labelled(spark, sf).select("loan_id", "split")


_PREPARED_SELECT = (
    "SELECT loan_id, term, loan_amnt, annual_inc, dti, revol_util, mths_since_last_delinq, purpose, "
    "addr_state, verification_status, emp_length, last_pymnt_d, target, split, "
    "CAST(date_diff('day', CAST(earliest_cr_line AS DATE), CAST(issue_d AS DATE)) AS DOUBLE) / 365.25 AS credit_age_yrs, "
    "CAST(fico_range_low + fico_range_high AS DOUBLE) / 2 AS fico_mid FROM labelled"
)

PREP_DROP = ("issue_d", "earliest_cr_line", "fico_range_low", "fico_range_high")


@register("P8_drop_unused", oracle(
    "SELECT * EXCLUDE (issue_d, earliest_cr_line, fico_range_low, fico_range_high) FROM labelled", "labelled"))
def q_drop_unused(spark, sf):
    return prep.drop_unused(B.labelled(spark, sf), PREP_DROP + ("not_a_column",))


@register("P9_split_target", oracle("SELECT loan_id, target FROM labelled", "labelled"))
def q_split_xy(spark, sf):
    _x, y = prep.split_xy(B.labelled(spark, sf), "loan_id", "target")
    return y


@register("P9_split_features", oracle("SELECT loan_id, loan_amnt, annual_inc, term, purpose FROM labelled", "labelled"))
def q_split_x(spark, sf):
    lab = B.labelled(spark, sf).select("loan_id", "loan_amnt", "annual_inc", "term", "purpose", "target")
    x, _y = prep.split_xy(lab, "loan_id", "target")
    return x


@register("P10_prepare_split", oracle(_PREPARED_SELECT, "labelled"))
def q_prepare(spark, sf):
    roles = B.LOAN_ROLES.__class__(**{**B.LOAN_ROLES.__dict__, "drop": PREP_DROP})
    return prep.prepare_split(B.labelled(spark, sf), roles)


@register("P11_regime_b_columns", oracle(_PREPARED_SELECT.replace("loan_amnt, ", "").replace("revol_util, ", ""), "labelled"))
def q_regime(spark, sf):
    # Regime B removes the lender-side columns; on the binding those are loan_amnt and revol_util.
    roles = B.LOAN_ROLES.__class__(**{**B.LOAN_ROLES.__dict__, "drop": PREP_DROP})
    rb = prep.regime(roles, "B", lender_cols=("loan_amnt", "revol_util"))
    return prep.prepare_split(B.labelled(spark, sf), rb)


@register(
    "P12_all_null_columns",
    oracle(
        "SELECT column_name AS column FROM (SELECT 'annual_inc' AS column_name, count(annual_inc) AS n FROM labelled WHERE split = 'train' "
        "UNION ALL SELECT 'income_in_test', count(annual_inc) FILTER (WHERE split = 'test') FROM labelled WHERE split = 'train' "
        "UNION ALL SELECT 'emp_length', count(emp_length) FROM labelled WHERE split = 'train' "
        "UNION ALL SELECT 'purpose', count(purpose) FROM labelled WHERE split = 'train') t WHERE n = 0",
        "labelled",
    ),
)
def q_all_null(spark, sf):
    # income_in_test is filled in the test split only, so all of train has NULL there.
    df = _with_test_only_column(B.labelled(spark, sf)).filter(F.col("split") == "train")
    return prep.all_null_columns(df, ["annual_inc", "income_in_test", "emp_length", "purpose"])


def _with_test_only_column(df):
    return df.withColumn("income_in_test", F.when(F.col("split") == "test", F.col("annual_inc")))


@register(
    "P12_drop_all_null",
    oracle("SELECT split, loan_id, annual_inc, purpose FROM labelled", "labelled"),
)
def q_drop_all_null(spark, sf):
    # The column that is all-NULL in train goes from every split, also from test, where it has values.
    lab = _with_test_only_column(B.labelled(spark, sf)).select("split", "loan_id", "annual_inc", "purpose", "income_in_test")
    parts, _gone = prep.drop_all_null(*[lab.filter(F.col("split") == s) for s in ("train", "val", "test")])
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LOG_FILTER = dict(pred=1, min_prob=0.2, max_prob=0.9, purpose="click",
                   date_from=datetime(2024, 1, 5), date_to=datetime(2024, 1, 20, 12))


@register(
    "P14_filter_log",
    oracle(
        "SELECT request_id, logged_at, prob FROM logs WHERE pred = 1 AND prob >= 0.2 AND prob <= 0.9 "
        "AND purpose = 'click' AND logged_at >= TIMESTAMP '2024-01-05 00:00:00' AND logged_at <= TIMESTAMP '2024-01-20 12:00:00'",
        "logs",
    ),
)
def q_filter_log(spark, sf):
    return prep.filter_log(B.prediction_logs(spark, sf), **_LOG_FILTER).select("request_id", "logged_at", "prob")


@register(
    "P15_get_prediction",
    oracle(
        "SELECT request_id, logged_at, pred, prob, loan_amnt, annual_inc, dti, mths_since_last_delinq, purpose "
        "FROM logs WHERE request_id = 42",
        "logs",
    ),
)
def q_get_prediction(spark, sf):
    inputs = ["loan_amnt", "annual_inc", "dti", "mths_since_last_delinq", "purpose"]
    return prep.get_prediction(B.prediction_logs(spark, sf), 42, inputs).select(
        "request_id", "logged_at", "pred", "prob", "raw_input.*")


def _outlier_sql() -> str:
    arms = " UNION ALL ".join(
        f"SELECT request_id, logged_at, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM logs WHERE {f} > {b}"
        for f, b in specs.OUTLIER_RULES.items()
    )
    return (
        f"SELECT request_id, logged_at, feature, value FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY feature ORDER BY logged_at, request_id) AS rn FROM ({arms}) u) t WHERE rn <= {specs.OUTLIER_LIST_LIMIT}"
    )


@register("P16_outlier_rows", oracle(_outlier_sql(), "logs"))
def q_outliers(spark, sf):
    return prep.flag_outliers(B.prediction_logs(spark, sf))


@register(
    "P17_status_counts",
    oracle(
        "SELECT loan_status, count(*) AS n FROM loans WHERE issue_d > TIMESTAMP '1996-01-01 00:00:00' "
        "AND issue_d < TIMESTAMP '1996-12-31 00:00:00' GROUP BY loan_status",
        "loans",
    ),
)
def q_status_counts(spark, sf):
    return prep.status_counts(B.loans(spark, sf), datetime(1996, 1, 1), datetime(1996, 12, 31))


@register(
    "P18_complete_cases",
    oracle("SELECT loan_id, annual_inc, dti, emp_length FROM loans WHERE annual_inc IS NOT NULL "
           "AND dti IS NOT NULL AND emp_length IS NOT NULL", "loans"),
)
def q_complete(spark, sf):
    return prep.complete_cases(B.loans(spark, sf).select("loan_id", "annual_inc", "dti", "emp_length"),
                               ["annual_inc", "dti", "emp_length"])


@register(
    "P19_recent_counts",
    oracle(
        "SELECT count(*) FILTER (WHERE logged_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR) AS last_24h, "
        "count(*) FILTER (WHERE logged_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 HOUR) AS last_1h FROM logs",
        "logs",
    ),
)
def q_recent(spark, sf):
    return prep.recent_counts(B.prediction_logs(spark, sf), B.LOG_AS_OF)


@register(
    "P20_inspect",
    oracle("SELECT loan_id, loan_amnt, addr_state FROM loans WHERE purpose = 'BUILDING' ORDER BY loan_amnt DESC, loan_id LIMIT 10",
           "loans"),
)
def q_inspect(spark, sf):
    df = B.loans(spark, sf).orderBy(F.desc("loan_amnt"), "loan_id")
    return prep.inspect(df, F.col("purpose") == "BUILDING", ["loan_id", "loan_amnt", "addr_state"], 10)


@register(
    "S2_parse_month_dates",
    oracle(
        "SELECT loan_id, CAST(strptime(strftime(issue_d, '%b-%Y'), '%b-%Y') AS TIMESTAMP) AS issue_month, "
        "strftime(issue_d, '%b-%Y') AS issue_label FROM loans",
        "loans",
    ),
)
def q_parse_dates(spark, sf):
    df = B.loans(spark, sf).select("loan_id", exprs.month_label("issue_d").alias("issue_label"))
    return df.select("loan_id", exprs.parse_month("issue_label").alias("issue_month"), "issue_label")
