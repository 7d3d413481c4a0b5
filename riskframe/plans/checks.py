"""Bound table checks (V1-V20) on the labelled splits and the prediction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import specs
from riskframe.operators import checks as V
from riskframe.operators import ml as L
from riskframe.operators import prep
from riskframe.operators import relational as R
from riskframe.operators.profile import class_balance
from riskframe.plans.registry import register
from riskframe.plans.relational import _CARD_CTES, _TOP5, NUM, SEGMENT_DOMAIN
from riskframe.sources import bindings as B
from riskframe.sources.bindings import oracle

RANGES = {"loan_amnt": (500.0, 50000.0), "fico_range_low": (300.0, 850.0), "fico_range_high": (300.0, 850.0), "annual_inc": (0.0, None)}
DOMAINS = {"term": [" 36 months", " 60 months"], "emp_length": specs.EMP_LENGTH_LEVELS, "purpose": SEGMENT_DOMAIN}
ORDERED = [("fico_range_low", "fico_range_high")]
EXTREME = ("dti", 100.0, 0.01)
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _data_checks_sql() -> str:
    arms = [
        "SELECT 'V3_target_not_null' AS check, split, 'target' AS column, count(*) FILTER (WHERE target IS NULL) AS n FROM labelled GROUP BY split",
        "SELECT 'V5_target_binary', split, 'target', count(*) FILTER (WHERE target IS NOT NULL AND target NOT IN (0, 1)) FROM labelled GROUP BY split",
    ]
    for c, (lo, hi) in RANGES.items():
        cond = " OR ".join(x for x in [f"{c} < {lo}" if lo is not None else "", f"{c} > {hi}" if hi is not None else ""] if x)
        arms.append(f"SELECT 'V8_numeric_range', split, '{c}', count(*) FILTER (WHERE {c} IS NOT NULL AND ({cond})) FROM labelled GROUP BY split")
    for c, vals in DOMAINS.items():
        lst = ", ".join(f"'{v}'" for v in vals)
        arms.append(f"SELECT 'V9_categorical_domain', split, '{c}', count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({lst})) FROM labelled GROUP BY split")
    for a, b in ORDERED:
        arms.append(f"SELECT 'V10_row_order', split, '{a}<={b}', count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {a} > {b}) FROM labelled GROUP BY split")
    c, bound, share = EXTREME
    arms.append(f"SELECT 'V11_extreme_share', split, '{c}', CASE WHEN coalesce(avg(CASE WHEN {c} IS NOT NULL THEN CAST({c} > {bound} AS DOUBLE) END) < {share}, true) THEN 0 ELSE 1 END FROM labelled GROUP BY split")
    arms.append("SELECT 'V12_default_rate_range', split, 'target', CASE WHEN avg(target) >= 0.1 AND avg(target) <= 0.25 THEN 0 ELSE 1 END FROM labelled GROUP BY split")
    body = " UNION ALL ".join(arms)
    return f"SELECT \"check\", split, \"column\", CAST(n AS BIGINT) AS n_violations, n = 0 AS ok FROM ({body}) u"


@register("V3_V5_V8_V12_data_checks", oracle(_data_checks_sql(), "labelled"))
def q_data_checks(spark, sf):
    return V.data_checks(B.labelled(spark, sf), "split", "target", RANGES, DOMAINS, ORDERED, EXTREME)


# purpose is text, so the required kind "number" is violated; not_recorded is absent; term stands for a leakage column that is there.
_REQUIRED = {"loan_id": "number", "issue_d": "datetime", "target": "number", "term": "string", "annual_inc": "number",
             "earliest_cr_line": "datetime", "purpose": "number", "not_recorded": "string"}
_LEAKS = [*specs.LEAKAGE_COLUMNS, "term"]
_PRESENT = {"loan_id", "issue_d", "target", "term", "annual_inc", "earliest_cr_line", "purpose", "last_pymnt_d"}


def _schema_sql() -> str:
    value = lambda c: f"(SELECT count({c}) FROM labelled)" if c in _PRESENT else "0"
    row = lambda k, c, bad: (f"SELECT '{k}' AS check, CAST(NULL AS VARCHAR) AS split, '{c}' AS column, "  # noqa: E731
                             f"CAST({int(bad)} AS BIGINT) AS n_violations, {str(not bad).lower()} AS ok, CAST({value(c)} AS BIGINT) AS n_values")
    rows = [row("V1_required_column", c, c not in _PRESENT) for c in _REQUIRED]
    rows += [row("V2_logical_type", c, c in ("purpose", "not_recorded")) for c in _REQUIRED]
    rows += [row("V6_no_leakage", c, c in _PRESENT) for c in _LEAKS]
    return " UNION ALL ".join(rows)


@register("V1_V2_V6_schema_checks", oracle(_schema_sql(), "labelled"))
def q_schema(spark, sf):
    return V.schema_checks(B.labelled(spark, sf), _REQUIRED, _LEAKS)


@register(
    "V4_row_count_receipt",
    oracle("""SELECT 'V4_row_count' AS check, coalesce(a.split, r.split) AS split, CAST(NULL AS VARCHAR) AS column,
  CAST(abs(coalesce(a.n, 0) - coalesce(r.n, 0)) AS BIGINT) AS n_violations, coalesce(a.n = r.n, false) AS ok
FROM (SELECT split, count(*) AS n FROM labelled GROUP BY split) a FULL JOIN (
  SELECT CASE WHEN split = 'test' THEN 'old' ELSE split END AS split, count(*) + CASE WHEN split = 'val' THEN 3 ELSE 0 END AS n
  FROM labelled GROUP BY split) r USING (split)""", "labelled"),
)
def q_row_count(spark, sf):
    # The receipt is out of date on purpose: three rows too many for val, and a split "old" in place of test.
    lab = B.labelled(spark, sf)
    receipt = class_balance(lab, "target", by="split").select(
        F.when(F.col("split") == "test", F.lit("old")).otherwise(F.col("split")).alias("split"),
        (F.col("n_rows") + F.when(F.col("split") == "val", 3).otherwise(0)).alias("rows"))
    return V.row_count_matches(lab, receipt)


@register(
    "V7_unexpected_all_null",
    oracle("""SELECT 'V7_unexpected_all_null' AS check, split, c AS column, CAST(1 AS BIGINT) AS n_violations, false AS ok FROM (
  SELECT split, 'income_in_test' AS c, count(annual_inc) FILTER (WHERE split = 'test') AS n FROM labelled GROUP BY split
  UNION ALL SELECT split, 'dti', count(dti) FROM labelled GROUP BY split
  UNION ALL SELECT split, 'annual_inc', count(annual_inc) FROM labelled GROUP BY split) u
WHERE n = 0 AND NOT (split = 'train' AND c = 'income_in_test')""", "labelled"),
)
def q_all_null(spark, sf):
    # income_in_test is filled in the test split only: all-NULL in train, where that is allowed, and in val, where it is not.
    lab = B.labelled(spark, sf).withColumn("income_in_test", F.when(F.col("split") == "test", F.col("annual_inc")))
    allowed = {"train": ["income_in_test"]}
    return V.unexpected_null_columns(lab.select("split", "annual_inc", "dti", "income_in_test"), "split", allowed)


@register(
    "V13_temporal_order",
    oracle("""SELECT 'V13_temporal_order' AS check, a.split || '<' || b.split AS split, 'issue_d' AS column,
  CAST(CASE WHEN a.hi < b.lo THEN 0 ELSE 1 END AS BIGINT) AS n_violations, a.hi < b.lo AS ok
FROM (SELECT split, max(issue_d) AS hi FROM labelled GROUP BY split) a, (SELECT split, min(issue_d) AS lo FROM labelled GROUP BY split) b
WHERE (a.split = 'train' AND b.split = 'val') OR (a.split = 'val' AND b.split = 'test')""", "labelled"),
)
def q_temporal(spark, sf):
    return V.temporal_order(B.labelled(spark, sf), "issue_d", "split", ["train", "val", "test"])


@register(
    "V15_rows_conserved",
    oracle(f"""SELECT 'V15_rows_conserved' AS check, CAST(NULL AS VARCHAR) AS split, CAST(NULL AS VARCHAR) AS column,
  CAST(abs((SELECT count(*) FROM windowed WHERE NOT coalesce(loan_status IN ('In Grace Period', 'Late (16-30 days)'), false)
     AND issue_d >= TIMESTAMP '1995-01-01' AND issue_d <= TIMESTAMP '1999-12-31') - (SELECT count(*) FROM labelled)) AS BIGINT) AS n_violations,
  (SELECT count(*) FROM windowed WHERE NOT coalesce(loan_status IN ('In Grace Period', 'Late (16-30 days)'), false)
     AND issue_d >= TIMESTAMP '1995-01-01' AND issue_d <= TIMESTAMP '1999-12-31') = (SELECT count(*) FROM labelled) AS ok""", "labelled"),
)
def q_conserved(spark, sf):
    w = prep.observation_window(B.loans(spark, sf), "issue_d", B.WINDOW_MONTHS)
    before = prep.label_loans(w).withColumn("__s", prep.split_column(B.SPLITS)).filter(F.col("__s").isNotNull())
    return V.rows_conserved(before, B.labelled(spark, sf))


@register(
    "V16_segment_ordering",
    oracle("""SELECT 'V16_segment_ordering' AS check, split, 'term' AS column,
  CAST(CASE WHEN coalesce(avg(CASE WHEN term = ' 36 months' THEN target END) < avg(CASE WHEN term = ' 60 months' THEN target END), false) THEN 0 ELSE 1 END AS BIGINT) AS n_violations,
  coalesce(avg(CASE WHEN term = ' 36 months' THEN target END) < avg(CASE WHEN term = ' 60 months' THEN target END), false) AS ok
FROM labelled GROUP BY split""", "labelled"),
)
def q_segment_order(spark, sf):
    return V.segment_ordering(B.labelled(spark, sf), "split", "term", " 36 months", " 60 months")


@register(
    "V18_sorted_dates",
    oracle("""SELECT 'V18_sorted_dates' AS check, CAST(NULL AS VARCHAR) AS split, 'issue_d' AS column, CAST(count(*) AS BIGINT) AS n_violations,
  count(*) = 0 AS ok FROM (SELECT issue_d, lead(issue_d) OVER (ORDER BY loan_id) AS nxt FROM labelled) x WHERE issue_d > nxt""", "labelled"),
)
def q_sorted(spark, sf):
    # Taken by loan id, the table is not in date order: the check must count the descents.
    return V.sorted_by(B.labelled(spark, sf), "issue_d", "loan_id")


@register(
    "V18_sorted_dates_after_sort",
    oracle("""SELECT 'V18_sorted_dates' AS check, CAST(NULL AS VARCHAR) AS split, 'issue_d' AS column, CAST(count(*) AS BIGINT) AS n_violations,
  count(*) = 0 AS ok FROM (SELECT issue_d, lead(issue_d) OVER (ORDER BY issue_d, loan_id) AS nxt FROM labelled) x WHERE issue_d > nxt""", "labelled"),
)
def q_sorted_after(spark, sf):
    lab = B.labelled(spark, sf).select("issue_d", "loan_id")
    return V.sorted_by(R.global_position(lab, "issue_d", "loan_id"), "issue_d", "position")


LOG_SPEC = ["request_id", "logged_at", "issue_d", "loan_amnt", "annual_inc", "dti", "revol_util", "pub_rec", "delinq_2yrs",
            "mths_since_last_delinq", "mths_since_last_record", "fico_range_low", "fico_range_high", "earliest_cr_line", "term",
            "purpose", "addr_state", "emp_length", "home_ownership", "pred", "prob", "reason_codes"]


def _order_sql() -> str:
    swapped = {"pred", "prob"}
    row = lambda c: (f"SELECT 'V19_column_order' AS check, CAST(NULL AS VARCHAR) AS split, '{c}' AS column, "  # noqa: E731
                     f"CAST({int(c in swapped)} AS BIGINT) AS n_violations, {str(c not in swapped).lower()} AS ok, "
                     f"CAST((SELECT count({c}) FROM logs) AS BIGINT) AS n_values")
    return " UNION ALL ".join([row(c) for c in LOG_SPEC if c != "reason_codes"] + [
        "SELECT 'V19_column_order', NULL, 'reason_codes', 1, false, 0", "SELECT 'V19_column_count', NULL, NULL, 1, false, 0"])


@register("V19_log_column_order", oracle(_order_sql(), "logs"))
def q_col_order(spark, sf):
    # The table under test has pred and prob swapped and lacks its last column.
    cols = [{"pred": "prob", "prob": "pred"}.get(c, c) for c in LOG_SPEC if c != "reason_codes"]
    return V.column_order(B.prediction_logs(spark, sf).select(*cols), LOG_SPEC)


def requests(spark, sf):
    """JSON requests built from the log, with deterministic corruptions for the validator."""
    logs = B.prediction_logs(spark, sf)
    k = F.col("request_id")
    m = F.create_map(
        F.lit("loan_amnt"), F.col("loan_amnt").cast("string"),
        F.lit("annual_inc"), F.when(k % 97 == 0, F.lit("not a number")).otherwise(F.col("annual_inc").cast("string")),
        F.lit("dti"), F.when(k % 83 == 0, F.lit("None")).otherwise(F.col("dti").cast("string")),
        F.lit("mths_since_last_delinq"), F.col("mths_since_last_delinq").cast("string"),
        F.lit("earliest_cr_line"), F.date_format("earliest_cr_line", "yyyy-MM-dd"),
        F.lit("term"), F.when(k % 79 == 0, F.lit(" 48 months")).otherwise(F.col("term")),
        F.lit("purpose"), F.col("purpose"),
    )
    m = F.map_filter(m, lambda key, _v: ~((key == "annual_inc") & (k % 89 == 0)))
    return logs.select("request_id", F.to_json(m).alias("payload"))


def _validate(spark, sf):
    return V.validate_requests(requests(spark, sf), "payload", ["loan_amnt", "annual_inc", "dti", "mths_since_last_delinq"],
                               nullable=["mths_since_last_delinq"], dates=["earliest_cr_line"],
                               enums={"term": [" 36 months", " 60 months"], "purpose": EVENT_TYPES})


@register(
    "V17_request_quarantine",
    oracle("""SELECT request_id, errors FROM (SELECT request_id, concat_ws(';',
    CASE WHEN request_id % 89 = 0 THEN 'annual_inc: missing' WHEN request_id % 97 = 0 THEN 'annual_inc: not a number' END,
    CASE WHEN request_id % 83 = 0 THEN 'dti: not a number' END,
    CASE WHEN request_id % 79 = 0 THEN 'term: not allowed' END) AS errors FROM logs) x WHERE errors <> ''""", "logs"),
)
def q_quarantine(spark, sf):
    _valid, bad = _validate(spark, sf)
    return bad.select("request_id", F.array_join("errors", ";").alias("errors"))


@register(
    "V17_request_valid_count",
    oracle("SELECT count(*) AS n_valid FROM logs WHERE NOT (request_id % 89 = 0 OR request_id % 97 = 0 OR request_id % 83 = 0 OR request_id % 79 = 0)",
           "logs"),
)
def q_valid(spark, sf):
    valid, _bad = _validate(spark, sf)
    return valid.agg(F.count(F.lit(1)).alias("n_valid"))


@register(
    "V20_response_contract",
    oracle("""SELECT 'V20_response_contract' AS check, CAST(NULL AS VARCHAR) AS split, CAST(NULL AS VARCHAR) AS column,
  CAST(count(*) AS BIGINT) AS n_violations, count(*) = 0 AS ok
FROM (SELECT id, count(*) AS n FROM top5 GROUP BY id) t WHERE n <> 5 OR id % 11 = 0 OR id % 13 = 0""",
           "labelled", extra={**_CARD_CTES, "top5": _TOP5}),
)
def q_contract(spark, sf):
    lab = B.labelled(spark, sf)
    card = L.fit_scorecard(lab.filter(F.col("split") == "train"), NUM)
    rows = L.scorecard_rows(lab.filter(F.col("split") == "test"), card, "loan_id", NUM)
    pred = (F.col("p") >= F.lit(0.5)).cast("int")
    # Faults for the check to find: every 11th id has the wrong class, every 13th lacks its weakest reason.
    answers = R.top_reason_rows(L.scorecard_scores(rows, with_contributions=True), 5)
    answers = answers.withColumns({"pred": F.when(F.col("id") % 11 == 0, 1 - pred).otherwise(pred),
                                   "reasons": F.when(F.col("id") % 13 == 0, F.slice("reasons", 1, 4)).otherwise(F.col("reasons"))})
    return V.response_contract(answers, 0.5)


_OPTIONAL = ["annual_inc", "dti", "revol_util"]


def _sanity_sql() -> str:
    arms = [f"""SELECT 'V21_null_optional_scored' AS check, '{c}' AS column, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_rows,
  CAST(count(*) FILTER (WHERE {c} IS NULL AND p IS NULL) AS BIGINT) AS n_violations, count(*) FILTER (WHERE {c} IS NULL AND p IS NULL) = 0 AS ok FROM sc"""
            for c in _OPTIONAL]
    arms.append("""SELECT 'V21_risk_order', 'target', count(*), CAST(CASE WHEN avg(p) FILTER (WHERE target = 1) > avg(p) FILTER (WHERE target = 0) THEN 0 ELSE 1 END AS BIGINT),
  coalesce(avg(p) FILTER (WHERE target = 1) > avg(p) FILTER (WHERE target = 0), false) FROM sc""")
    return " UNION ALL ".join(arms)


@register(
    "V21_scoring_sanity",
    oracle(_sanity_sql(), "labelled", extra={**_CARD_CTES, "sc": """SELECT te.*, s.p FROM te LEFT JOIN (
  SELECT id, 1 / (1 + exp(-sum(value))) AS p FROM contrib GROUP BY id) s ON s.id = te.loan_id"""}),
)
def q_sanity(spark, sf):
    lab = B.labelled(spark, sf)
    card = L.fit_scorecard(lab.filter(F.col("split") == "train"), NUM)
    test = lab.filter(F.col("split") == "test")
    scores = L.scorecard_scores(L.scorecard_rows(test, card, "loan_id", NUM)).select(F.col("id").alias("loan_id"), "p")
    return V.scoring_sanity(test.join(scores, "loan_id", "left"), _OPTIONAL)
