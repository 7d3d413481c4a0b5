"""Bound scalar-function queries (F3-F23) and profile expansion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from riskframe.functions import exprs as X
from riskframe.operators import features as M
from riskframe.operators import prep
from riskframe.operators.scenarios import expand_profile, full_application
from riskframe.plans.common import r6
from riskframe.plans.registry import register
from riskframe.sources import bindings as B
from riskframe.sources.bindings import oracle
from riskframe import specs


def _term_months(col="term"):
    return F.when(F.col(col) == " 60 months", F.lit(60)).otherwise(F.lit(36))


_APR_SQL = "CAST(CASE " + " ".join(f"WHEN fico_range_low >= {b} THEN {a}" for b, a in specs.APR_BY_FICO) + f" ELSE {specs.APR_FLOOR} END AS DOUBLE)"


def _inst_sql(principal: str, apr: str, months: str) -> str:
    r = f"({apr} / 100.0 / 12.0)"
    f = f"power(1.0 + {r}, CAST({months} AS DOUBLE))"
    return f"(floor({principal} * {r} * {f} / ({f} - 1.0) * 100.0 + 0.5) / 100.0)"


@register(
    "F3_F4_F10_F11_payment_ratios",
    oracle(f"""SELECT loan_id, apr, installment, round(loan_amnt / (annual_inc + 1.0), 6) AS loan_to_income,
  round(12.0 * installment / (annual_inc + 1.0), 6) AS ins_to_income
FROM (SELECT *, {_inst_sql('loan_amnt', 'apr', 'term_months')} AS installment
      FROM (SELECT *, {_APR_SQL} AS apr, CASE WHEN term = ' 60 months' THEN 60 ELSE 36 END AS term_months FROM loans) a) b""", "loans"),
)
def q_payments(spark, sf):
    df = B.loans(spark, sf).withColumns({"apr": X.apr_bucket(), "term_months": _term_months()})
    df = df.withColumn("installment", X.amortised_payment("loan_amnt", F.col("apr"), "term_months"))
    return r6(df.select("loan_id", "apr", "installment", X.loan_to_income().alias("loan_to_income"),
                        X.ins_to_income().alias("ins_to_income")))


_SUB_GRADE_SQL = "chr(CAST(65 + loan_id % 7 AS INTEGER)) || CAST(1 + loan_id % 5 AS VARCHAR)"


@register(
    "F5_grade_ranks",
    oracle(f"""SELECT loan_id, sub_grade, CAST(ascii(substr(sub_grade, 1, 1)) - 64 AS INTEGER) AS grade_rank,
  CAST(ascii(substr(sub_grade, 1, 1)) - 64 AS DOUBLE) + CAST(substr(sub_grade, 2, 1) AS INTEGER) / 10.0 AS sub_grade_rank
FROM (SELECT loan_id, {_SUB_GRADE_SQL} AS sub_grade FROM loans) s""", "loans"),
)
def q_grades(spark, sf):
    k = F.col("loan_id")
    df = B.loans(spark, sf).select("loan_id", F.concat(F.char(F.lit(65) + k % 7), (F.lit(1) + k % 5).cast("string")).alias("sub_grade"))
    return df.select("loan_id", "sub_grade", X.grade_rank("sub_grade").alias("grade_rank"), X.sub_grade_rank("sub_grade").alias("sub_grade_rank"))


_INPUTS_SQL = """SELECT request_id AS id, loan_amnt, CASE WHEN term = ' 60 months' THEN 60 ELSE 36 END AS term_months, annual_inc, dti,
  fico_range_low, revol_util, CAST(floor(date_diff('day', earliest_cr_line, issue_d) / 365.25) AS INTEGER) AS credit_history_years,
  delinq_2yrs, CAST(request_id % 7 AS DOUBLE) AS inq_last_6mths, CAST(3 + request_id % 20 AS INTEGER) AS open_acc FROM logs"""


def _c(x, lo, hi):
    return f"least(greatest({x}, {lo}), {hi})"


_RISK_SQL = _c(
    f"0.35 * {_c('(820.0 - fico_range_low) / 220.0', '0.0', '1.0')} + 0.25 * {_c('dti / 40.0', '0.0', '1.0')}"
    f" + 0.2 * {_c('revol_util / 100.0', '0.0', '1.0')} + 0.12 * {_c('delinq_2yrs / 5.0', '0.0', '1.0')}"
    f" + 0.08 * {_c('inq_last_6mths / 10.0', '0.0', '1.0')}", "0.0", "1.0")


def _jr(x):
    return f"floor({x} + 0.5)"


_PROFILE_SQL = f"""SELECT id, fico_range_low + 4 AS fico_range_high, round(risk_score, 6) AS risk_score, apr,
  CAST(CAST('2024-01-31' AS DATE) - to_years(credit_history_years) AS DATE) AS earliest_cr_line,
  installment, total_rev_hi_lim, bc_util, revol_bal, total_bc_limit, percent_bc_gt_75, total_acc,
  greatest(0.0, {_jr('total_bc_limit - bc_util / 100.0 * total_bc_limit')}) AS bc_open_to_buy,
  least(total_acc, {_jr('total_acc * (1.0 - risk_score * 0.15)')}) AS num_sats,
  greatest(1.0, {_jr('total_acc * 0.55')}) AS num_rev_accts,
  least(CAST(open_acc AS DOUBLE), greatest(1.0, {_jr('total_acc * 0.55')})) AS num_op_rev_tl
FROM (SELECT *, {_jr('revol_util / 100.0 * total_rev_hi_lim')} AS revol_bal, {_jr('total_rev_hi_lim * 0.6')} AS total_bc_limit,
             {_c('(bc_util - 50.0) * 2.0', '0.0', '100.0')} AS percent_bc_gt_75,
             greatest(CAST(open_acc AS DOUBLE), {_jr('open_acc + credit_history_years * 0.6 + risk_score * 2.0')}) AS total_acc
      FROM (SELECT *, {_inst_sql('loan_amnt', 'apr', 'term_months')} AS installment,
                   {_jr(_c('annual_inc * 0.22 * (1.0 - 0.4 * risk_score)', '2000.0', '250000.0'))} AS total_rev_hi_lim,
                   {_c('revol_util * 1.05', '0.0', '100.0')} AS bc_util
            FROM (SELECT *, {_RISK_SQL} AS risk_score, {_APR_SQL} AS apr FROM inp) a) b) c"""


@register("F9_F12_F13_F14_expand_profile", oracle(_PROFILE_SQL, "logs", extra={"inp": _INPUTS_SQL}))
def q_profile(spark, sf):
    logs = B.prediction_logs(spark, sf)
    k = F.col("request_id")
    inputs = logs.select(
        k.alias("id"), "loan_amnt", _term_months().alias("term_months"), "annual_inc", "dti", "fico_range_low", "revol_util",
        F.floor(F.datediff("issue_d", "earliest_cr_line") / F.lit(365.25)).cast("int").alias("credit_history_years"),
        "delinq_2yrs", (k % 7).cast("double").alias("inq_last_6mths"), (F.lit(3) + k % 20).cast("int").alias("open_acc"))
    out = expand_profile(inputs, B.LOG_AS_OF)
    cols = ["id", "fico_range_high", "risk_score", "apr", "earliest_cr_line", "installment", "total_rev_hi_lim", "bc_util", "revol_bal",
            "total_bc_limit", "percent_bc_gt_75", "total_acc", "bc_open_to_buy", "num_sats", "num_rev_accts", "num_op_rev_tl"]
    return out.select(*cols).withColumn("risk_score", X.round6(F.col("risk_score")))


_APP_INPUTS_SQL = _INPUTS_SQL.replace(" FROM logs", ", term, emp_length, home_ownership, purpose FROM logs")
_LATE = "delinq_2yrs > 0"


def _when(cond, then, other="NULL"):
    return f"CASE WHEN {cond} THEN {then} ELSE {other} END"


# The form's rules once more, one level of names at a time.
_APP_LEVELS = [
    f"""*, {_RISK_SQL} AS r, {_APR_SQL} AS apr""",
    f"""*, {_inst_sql('loan_amnt', 'apr', 'term_months')} AS installment, {_c('revol_util * 1.05', '0.0', '100.0')} AS bcu,
  {_jr(_c('annual_inc * 0.22 * (1.0 - 0.4 * r)', '2000.0', '250000.0'))} AS total_rev_hi_lim,
  greatest(CAST(open_acc AS DOUBLE), {_jr('open_acc + credit_history_years * 0.6 + r * 2.0')}) AS total_acc,
  {_when("home_ownership = 'MORTGAGE'", _jr('1.0 + (1.0 - r) * 2.0'), '0.0')} AS mort_acc, {_jr(_c('24.0 - r * 20.0', '1.0', '60.0'))} AS mo_sin_rcnt_tl,
  {_jr('annual_inc * 0.15 * (1.0 - r * 0.3)')} AS total_il_high_credit_limit, {_jr('1.0 + 3.0 * r')} AS num_tl_op_past_12m""",
    f"""*, {_jr('revol_util / 100.0 * total_rev_hi_lim')} AS revol_bal, {_jr('total_rev_hi_lim * 0.6')} AS total_bc_limit,
  greatest(1.0, {_jr('total_acc * 0.55')}) AS num_rev_accts, mo_sin_rcnt_tl + {_jr('r * 3.0')} AS mo_sin_rcnt_rev_tl_op""",
    f"""*, least(CAST(open_acc AS DOUBLE), num_rev_accts) AS num_op_rev_tl, {_jr('revol_bal + total_il_high_credit_limit * 0.3')} AS total_bal_ex_mort""",
    f"""*, greatest(1.0, {_jr('num_op_rev_tl * 0.8')}) AS num_actv_rev_tl, {_jr('total_bal_ex_mort + ' + _when('mort_acc > 0', 'annual_inc * 1.5', '0.0'))} AS tot_cur_bal""",
    f"""*, greatest(0.0, {_jr('num_actv_rev_tl * 0.5')}) AS num_actv_bc_tl""",
    f"""*, greatest(num_actv_bc_tl, {_jr('num_rev_accts * 0.4')}) AS num_bc_tl""",
]
_APP_OWN = {
    "pub_rec": _when("r > 0.75", "1.0", "0.0"), "tax_liens": _when("r > 0.9", "1.0", "0.0"),
    "collections_12_mths_ex_med": _when("r > 0.7", "1.0", "0.0"), "chargeoff_within_12_mths": _when("r > 0.8", "1.0", "0.0"),
    "acc_now_delinq": _when("delinq_2yrs >= 4", "1.0", "0.0"), "num_accts_ever_120_pd": _when("delinq_2yrs >= 2", "1.0", "0.0"),
    "num_tl_90g_dpd_24m": _when("delinq_2yrs >= 3", "1.0", "0.0"), "num_tl_30dpd": _when("delinq_2yrs >= 1 AND r > 0.7", "1.0", "0.0"),
    "delinq_amnt": _when("delinq_2yrs >= 4", _jr("200.0 + 800.0 * r"), "0.0"), "tot_coll_amt": _when("r > 0.6", _jr("500.0 * r"), "0.0"),
    "acc_open_past_24mths": _jr("num_tl_op_past_12m * 1.5"), "avg_cur_bal": _jr("tot_cur_bal / greatest(1.0, total_acc)"),
    "bc_open_to_buy": f"greatest(0.0, {_jr('total_bc_limit - bcu / 100.0 * total_bc_limit')})", "bc_util": _jr("bcu"),
    "mo_sin_old_il_acct": f"greatest(12.0, {_jr('credit_history_years * 12.0 * 0.8')})",
    "mo_sin_old_rev_tl_op": "greatest(12.0, credit_history_years * 12.0 - mo_sin_rcnt_rev_tl_op)",
    "num_bc_sats": f"greatest(0.0, {_jr('num_bc_tl * (1.0 - r * 0.1)')})", "num_il_tl": f"greatest(0.0, {_jr('total_acc - num_rev_accts - mort_acc')})",
    "num_rev_tl_bal_gt_0": f"greatest(0.0, {_jr('num_actv_rev_tl * 0.85')})", "num_sats": f"least(total_acc, {_jr('total_acc * (1.0 - r * 0.15)')})",
    "num_tl_120dpd_2m": "0.0", "pct_tl_nvr_dlq": _jr(_c("100.0 - r * 35.0", "60.0", "100.0")), "percent_bc_gt_75": _jr(_c("(bcu - 50.0) * 2.0", "0.0", "100.0")),
    "pub_rec_bankruptcies": _when("r > 0.75", "1.0", "0.0"),
    "tot_hi_cred_lim": _jr("total_rev_hi_lim + total_il_high_credit_limit + " + _when("mort_acc > 0", "annual_inc * 2.0", "0.0")),
    "fico_range_high": "fico_range_low + 4", "mths_since_last_delinq": _when(_LATE, _jr("greatest(1.0, 24.0 - delinq_2yrs * 4.0)")),
    "mths_since_last_record": _when("r > 0.75", _jr("30.0 + 20.0 * r")), "mths_since_last_major_derog": _when("r > 0.75", _jr("20.0 - 10.0 * r")),
    "mths_since_recent_bc": _jr("6.0 + 30.0 * (1.0 - r)"), "mths_since_recent_bc_dlq": _when(f"{_LATE} AND r > 0.5", _jr("12.0 + 20.0 * r")),
    "mths_since_recent_inq": _when("inq_last_6mths > 0", _jr("1.0 + greatest(0.0, 6.0 - inq_last_6mths)"), _jr("12.0 + (1.0 - r) * 20.0")),
    "mths_since_recent_revol_delinq": _when(f"{_LATE} AND r > 0.5", _jr("15.0 + 25.0 * r")),
    "earliest_cr_line": "CAST(CAST('2024-01-31' AS DATE) - to_years(credit_history_years) AS DATE)",
    "verification_status": "CASE WHEN r < 0.3 THEN 'Verified' WHEN r < 0.6 THEN 'Source Verified' ELSE 'Not Verified' END",
    "addr_state": "'CA'", "initial_list_status": "'w'",
}
_APP_TEXT = {"earliest_cr_line", "term", "emp_length", "home_ownership", "verification_status", "purpose", "addr_state", "initial_list_status"}
_APP_FROM = "inp"
for _level in _APP_LEVELS:
    _APP_FROM = f"(SELECT {_level} FROM {_APP_FROM}) x"
APPLICATION_SQL = "SELECT id, " + ", ".join(
    f"{_APP_OWN.get(f, f)} AS {f}" if f in _APP_TEXT else f"CAST({_APP_OWN.get(f, f)} AS DOUBLE) AS {f}" for f in specs.APPLICATION_FIELDS) + f" FROM {_APP_FROM}"


def application_inputs(logs):
    """The form's inputs as the prediction log has them."""
    k = F.col("request_id")
    return logs.select(
        k.alias("id"), "loan_amnt", _term_months().alias("term_months"), "annual_inc", "dti", "fico_range_low", "revol_util",
        F.floor(F.datediff("issue_d", "earliest_cr_line") / F.lit(365.25)).cast("int").alias("credit_history_years"),
        "delinq_2yrs", (k % 7).cast("double").alias("inq_last_6mths"), (F.lit(3) + k % 20).cast("int").alias("open_acc"),
        "term", "emp_length", "home_ownership", "purpose")


@register("F13_full_application", oracle(APPLICATION_SQL, "logs", extra={"inp": _APP_INPUTS_SQL}))
def q_application(spark, sf):
    return full_application(application_inputs(B.prediction_logs(spark, sf)), B.LOG_AS_OF)


@register("S9_log_full_records", oracle(
    f"SELECT a.* EXCLUDE (id), l.request_id, l.logged_at, l.issue_d, l.pred, round(l.prob, 6) AS prob, CAST(l.logged_at AS DATE) AS log_date "
    f"FROM ({APPLICATION_SQL}) a JOIN logs l ON l.request_id = a.id", "logs", extra={"inp": _APP_INPUTS_SQL}))
def q_log_records(spark, sf):
    """Log records of all 66 inputs in their fixed order, appended by two runs (one of them repeated) and read back."""
    from riskframe.sources import io as IO
    from riskframe.streaming.jobs import scratch

    logs = B.prediction_logs(spark, sf)
    full = full_application(application_inputs(logs), B.LOG_AS_OF).withColumnRenamed("id", "request_id")
    records = full.join(logs.select("request_id", "logged_at", "issue_d", "pred", "prob"), "request_id")
    spec, path = ["request_id", "logged_at", "issue_d", *specs.APPLICATION_FIELDS, "pred", "prob"], scratch(spark, "full-log")
    for run, part in (("even", 0), ("odd", 1), ("odd", 1)):
        IO.append_log(records.filter(F.col("request_id") % 2 == part), path, spec, run)
    back = IO.read_runs(spark, path)
    if back.columns != [*spec, "log_date"]:
        raise ValueError("the log table has lost its column order")
    return back.withColumn("prob", X.round6(F.col("prob")))


_NAMES_SQL = """SELECT DISTINCT 'cat__emp_length_' || coalesce(emp_length, 'missing') AS name FROM labelled WHERE split = 'train'
UNION SELECT DISTINCT 'cat__purpose_' || coalesce(purpose, 'missing') FROM labelled WHERE split = 'train'
UNION SELECT 'num__' || f FROM (VALUES ('annual_inc'), ('dti'), ('loan_amnt')) v(f)"""


@register(
    "F15_F16_feature_names",
    oracle("""SELECT name, regexp_replace(name, '^(num|cat)__', '') AS base,
  array_to_string(list_transform(string_split(replace(regexp_replace(name, '^(num|cat)__', ''), '_', ' '), ' '),
                  lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS label,
  regexp_replace(replace(name, '<', 'lt'), '[\\[\\]]', '_', 'g') AS safe_name FROM names""", "labelled", extra={"names": _NAMES_SQL}),
)
def q_names(spark, sf):
    lab = B.labelled(spark, sf)
    stats = M.fit(lab.filter(F.col("split") == "train"), ["annual_inc", "dti", "loan_amnt"], ["emp_length", "purpose"])
    names = M.transform_long(lab.filter(F.col("split") == "train"), stats, "loan_id", ["annual_inc", "dti", "loan_amnt"],
                             ["emp_length", "purpose"]).select("name").distinct()
    return names.select("name", X.strip_prefix("name").alias("base"), X.humanise("name").alias("label"), X.safe_name("name").alias("safe_name"))


PAYLOAD_SCHEMA = StructType([
    StructField("request_id", LongType()), StructField("loan_amnt", DoubleType()), StructField("annual_inc", DoubleType()),
    StructField("mths_since_last_delinq", DoubleType()), StructField("earliest_cr_line", DateType()), StructField("term", StringType()),
    StructField("purpose", StringType()),
])


@register(
    "F19_F20_payload_round_trip",
    oracle("SELECT request_id, loan_amnt, annual_inc, mths_since_last_delinq, earliest_cr_line, term, purpose FROM logs", "logs"),
)
def q_payload(spark, sf):
    cols = [f.name for f in PAYLOAD_SCHEMA.fields]
    js = B.prediction_logs(spark, sf).select(X.to_payload(*cols).alias("payload"))
    return js.select(X.from_payload("payload", PAYLOAD_SCHEMA).alias("r")).select("r.*")


@register(
    "F22_S8_load_prediction_log",
    oracle("""SELECT request_id, CASE WHEN request_id % 11 = 0 THEN NULL ELSE mths_since_last_delinq END AS mths_since_last_delinq,
  CAST(issue_d AS TIMESTAMP) AS issue_d, CAST(NULL AS INTEGER) AS target FROM logs""", "logs"),
)
def q_load_log(spark, sf):
    from riskframe.sources.io import load_prediction_log

    raw = B.prediction_logs(spark, sf).select(
        "request_id",
        F.when(F.col("request_id") % 11 == 0, F.lit("n/a")).otherwise(F.col("mths_since_last_delinq").cast("string")).alias("mths_since_last_delinq"),
        F.date_format("issue_d", "yyyy-MM-dd").alias("issue_d"))
    return load_prediction_log(raw, ["mths_since_last_delinq"], ["issue_d"]).select("request_id", "mths_since_last_delinq", "issue_d", "target")


_KINDS = {"number": ["loan_id", "loan_amnt", "annual_inc", "dti", "target"], "string": ["term", "purpose", "emp_length"],
          "datetime": ["issue_d", "last_pymnt_d"]}


@register("P13_columns_by_kind", oracle(" UNION ALL ".join(
    f"SELECT '{k}' AS kind, '{c}' AS column, count({c}) AS n_values FROM labelled" for k, cs in _KINDS.items() for c in cs), "labelled"))
def q_kinds(spark, sf):
    return prep.kind_counts(B.labelled(spark, sf).select(*[c for cs in _KINDS.values() for c in cs]))


@register("F6_decide", oracle("SELECT id, CAST(p >= 0.16 AS INTEGER) AS pred, CAST(p2 >= p AS INTEGER) AS p2_at_least_p FROM scored", "scored"))
def q_decide(spark, sf):
    return B.scored(spark, sf).select("id", X.decide("p", 0.16).alias("pred"), X.decide("p2", F.col("p")).alias("p2_at_least_p"))


@register("F18_days_between", oracle(
    "SELECT loan_id, CAST(date_diff('day', CAST(earliest_cr_line AS DATE), CAST(issue_d AS DATE)) AS INTEGER) AS credit_days, "
    "CAST(date_diff('day', CAST(issue_d AS DATE), CAST(last_pymnt_d AS DATE)) AS INTEGER) AS paid_days FROM loans", "loans"))
def q_days(spark, sf):
    return B.loans(spark, sf).select("loan_id", X.days_between("issue_d", "earliest_cr_line").alias("credit_days"), X.days_between("last_pymnt_d", "issue_d").alias("paid_days"))
