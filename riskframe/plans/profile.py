"""Bound profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import specs
from riskframe.operators import profile as A
from riskframe.plans.common import r6
from riskframe.plans.registry import register
from riskframe.sources import bindings as B
from riskframe.sources.bindings import oracle

NUM = ["loan_amnt", "annual_inc", "dti", "revol_util", "mths_since_last_delinq", "fico_range_low", "credit_age_yrs"]
NULLABLE = ["annual_inc", "dti", "revol_util", "mths_since_last_delinq", "emp_length", "last_pymnt_d"]


def _u(template: str, cols) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in cols)


@register(
    "A1_null_rates",
    oracle(_u("SELECT '{c}' AS column, round(100.0 * (count(*) - count({c})) / count(*), 6) AS null_pct FROM loans",
              NULLABLE + ["loan_amnt", "purpose"]), "loans"),
)
def q_null_rates(spark, sf):
    return r6(A.null_rates(B.loans(spark, sf), NULLABLE + ["loan_amnt", "purpose"]))


@register(
    "A2_value_counts",
    oracle("SELECT emp_length, count(*) AS n, round(count(*) / (SELECT count(emp_length) FROM loans), 6) AS share "
           "FROM loans WHERE emp_length IS NOT NULL GROUP BY emp_length", "loans"),
)
def q_value_counts(spark, sf):
    return r6(A.value_counts(B.loans(spark, sf), "emp_length", dropna=True))


@register(
    "A2_value_counts_with_nulls",
    oracle("SELECT emp_length, count(*) AS n, round(count(*) / (SELECT count(*) FROM loans), 6) AS share "
           "FROM loans GROUP BY emp_length", "loans"),
)
def q_value_counts_na(spark, sf):
    return r6(A.value_counts(B.loans(spark, sf), "emp_length", dropna=False))


@register(
    "A3_class_balance_overall",
    oracle("SELECT count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS n_bad, round(avg(target), 6) AS default_rate FROM labelled",
           "labelled"),
)
def q_balance(spark, sf):
    return A.class_balance(B.labelled(spark, sf), "target")


@register(
    "A4_rate_by_category",
    oracle("SELECT purpose, round(avg(target) * 100, 6) AS default_rate_pct, count(*) AS n FROM labelled "
           "WHERE purpose IS NOT NULL GROUP BY purpose", "labelled"),
)
def q_rate_by(spark, sf):
    return r6(A.rate_by(B.labelled(spark, sf), "target", "purpose"))


@register(
    "A5_rate_by_month",
    oracle("SELECT CAST(date_trunc('month', issue_d) AS DATE) AS month, round(avg(target), 6) AS default_rate, count(*) AS n "
           "FROM labelled GROUP BY 1", "labelled"),
)
def q_rate_month(spark, sf):
    return r6(A.rate_by_month(B.labelled(spark, sf), "target", "issue_d"))


_RATES = "SELECT addr_state, avg(target) * 100 AS r FROM labelled WHERE addr_state IS NOT NULL GROUP BY addr_state"
_RATE_BINS = """SELECT addr_state, (SELECT count(*) FROM range(1, 10) q(i)
    WHERE CAST(i AS DOUBLE) * ((mx - mn) / 10.0) + mn < r) AS bin
  FROM rates, (SELECT min(r) AS mn, max(r) AS mx FROM rates) s"""


@register(
    "A6_rate_histogram",
    oracle("SELECT CAST(g.i AS INTEGER) AS bin, CAST(count(b.bin) AS BIGINT) AS n_categories FROM range(0, 10) g(i) "
           "LEFT JOIN rb b ON b.bin = g.i GROUP BY g.i", "labelled", extra={"rates": _RATES, "rb": _RATE_BINS}),
)
def q_rate_hist(spark, sf):
    hist, _members = A.rate_histogram(B.labelled(spark, sf), "target", "addr_state", 10)
    return hist


@register(
    "A6_rate_histogram_members",
    oracle("SELECT CAST(bin AS INTEGER) AS bin, addr_state AS member FROM rb", "labelled", extra={"rates": _RATES, "rb": _RATE_BINS}),
)
def q_rate_members(spark, sf):
    _hist, members = A.rate_histogram(B.labelled(spark, sf), "target", "addr_state", 10)
    return members


@register(
    "A7_describe",
    oracle(_u("""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM labelled""", NUM), "labelled"),
)
def q_describe(spark, sf):
    return r6(A.describe(B.labelled(spark, sf), NUM))


_QS = [0.01, 0.05, 0.5, 0.95, 0.99]


@register(
    "A8_quantiles",
    oracle(" UNION ALL ".join(
        f"SELECT '{c}' AS column, {q!r}::DOUBLE AS q, round(quantile_cont(CAST({c} AS DOUBLE), {q!r}), 6) AS value FROM labelled"
        for c in ["annual_inc", "dti"] for q in _QS), "labelled"),
)
def q_quantiles(spark, sf):
    return r6(A.quantiles(B.labelled(spark, sf), ["annual_inc", "dti"], _QS))


_CUT_STATS = _u("SELECT '{c}' AS column, min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM labelled", NUM)
_CUT_VALS = _u("SELECT '{c}' AS column, CAST({c} AS DOUBLE) AS v FROM labelled WHERE {c} IS NOT NULL", NUM)


@register(
    "A9_equal_width_cuts",
    oracle("""SELECT s.column, CAST(g.i AS INTEGER) AS bin,
  round(CASE WHEN g.i = 0 THEN s.lo - (s.hi - s.lo) * 0.001 ELSE CAST(g.i AS DOUBLE) * ((s.hi - s.lo) / 10.0) + s.lo END, 6) AS lower,
  round(CASE WHEN g.i = 9 THEN s.hi ELSE CAST(g.i + 1 AS DOUBLE) * ((s.hi - s.lo) / 10.0) + s.lo END, 6) AS upper,
  CAST((SELECT count(*) FROM vals v WHERE v.column = s.column AND
        (SELECT count(*) FROM range(1, 10) q(j) WHERE CAST(j AS DOUBLE) * ((s.hi - s.lo) / 10.0) + s.lo < v.v) = g.i) AS BIGINT) AS n
FROM stats s, range(0, 10) g(i) WHERE s.lo < s.hi""", "labelled", extra={"stats": _CUT_STATS, "vals": _CUT_VALS}),
)
def q_cuts(spark, sf):
    return r6(A.equal_width_cuts(B.labelled(spark, sf), NUM, 10).withColumn("bin", F.col("bin").cast("int")))


@register(
    "A10_income_brackets",
    oracle("""SELECT CASE WHEN annual_inc > 0 AND annual_inc <= 40000 THEN '<40k' WHEN annual_inc > 40000 AND annual_inc <= 80000 THEN '40-80k'
  WHEN annual_inc > 80000 AND annual_inc <= 120000 THEN '80-120k' WHEN annual_inc > 120000 THEN '>120k' END AS bracket, count(*) AS n
FROM loans GROUP BY 1""", "loans"),
)
def q_brackets(spark, sf):
    return A.bracket_counts(B.loans(spark, sf), "annual_inc", specs.INCOME_EDGES, specs.INCOME_LABELS)


@register(
    "A11_density_histogram",
    oracle("""SELECT s.target, CAST(g.i AS INTEGER) AS bin, round(CAST(g.i AS DOUBLE) * ((s.hi - s.lo) / 50.0) + s.lo, 6) AS lower,
  CAST(count(b.bin) AS BIGINT) AS n, round(count(b.bin) / (s.total * ((s.hi - s.lo) / 50.0)), 6) AS density
FROM st s CROSS JOIN range(0, 50) g(i)
LEFT JOIN (SELECT l.target, (SELECT count(*) FROM range(1, 50) q(j) WHERE CAST(j AS DOUBLE) * ((s2.hi - s2.lo) / 50.0) + s2.lo <= l.annual_inc) AS bin
           FROM labelled l JOIN st s2 ON l.target = s2.target WHERE l.annual_inc IS NOT NULL) b ON b.target = s.target AND b.bin = g.i
GROUP BY s.target, g.i, s.lo, s.hi, s.total""", "labelled",
           extra={"st": "SELECT target, min(annual_inc) AS lo, max(annual_inc) AS hi, count(*) AS total FROM labelled WHERE annual_inc IS NOT NULL GROUP BY target"}),
)
def q_density(spark, sf):
    return r6(A.density_hist(B.labelled(spark, sf), "annual_inc", 50, by="target").withColumn("bin", F.col("bin").cast("int")))


_SQRT_2PI = (2 * 3.141592653589793) ** 0.5


@register(
    "A12_kde",
    oracle(f"""SELECT s.target, CAST(g.i AS INTEGER) AS gi, round(CAST(g.i AS DOUBLE) * ((s.hi - s.lo) / 49.0) + s.lo, 6) AS x,
  round(sum(exp(-0.5 * ((CAST(g.i AS DOUBLE) * ((s.hi - s.lo) / 49.0) + s.lo - l.loan_amnt) / s.h)
                     * ((CAST(g.i AS DOUBLE) * ((s.hi - s.lo) / 49.0) + s.lo - l.loan_amnt) / s.h))) / (s.total * s.h * {_SQRT_2PI!r}), 6) AS density
FROM st s CROSS JOIN range(0, 50) g(i) JOIN labelled l ON l.target = s.target AND l.loan_amnt IS NOT NULL
GROUP BY s.target, g.i, s.lo, s.hi, s.h, s.total""", "labelled",
           extra={"st": "SELECT target, min(loan_amnt) AS lo, max(loan_amnt) AS hi, count(*) AS total, "
                        "stddev_samp(loan_amnt) * power(CAST(count(*) AS DOUBLE), -0.2) AS h FROM labelled "
                        "WHERE loan_amnt IS NOT NULL GROUP BY target"}),
)
def q_kde(spark, sf):
    return r6(A.kde(B.labelled(spark, sf), "loan_amnt", 50, by="target").withColumn("gi", F.col("gi").cast("int")))


@register(
    "A13_box_stats",
    oracle(_u("""SELECT '{c}' AS column, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round((SELECT min({c}) FROM labelled WHERE {c} >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
  round((SELECT max({c}) FROM labelled WHERE {c} <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
  (SELECT count(*) FROM labelled WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med,
             quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM labelled) q""", ["annual_inc", "dti", "loan_amnt"]), "labelled"),
)
def q_box(spark, sf):
    return r6(A.box_stats(B.labelled(spark, sf), ["annual_inc", "dti", "loan_amnt"]))


@register(
    "A14_A15_corr_with_target",
    oracle(_u("SELECT '{c}' AS column, round(corr(CAST({c} AS DOUBLE), CAST(target AS DOUBLE)), 6) AS corr FROM labelled", NUM),
           "labelled"),
)
def q_corr_target(spark, sf):
    return r6(A.corr_with_target(B.labelled(spark, sf), NUM, "target"))


_PAIRS = [("loan_amnt", "annual_inc"), ("dti", "revol_util"), ("fico_range_low", "credit_age_yrs")]


@register(
    "A16_corr_pairs",
    oracle(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM labelled"
                              for a, b in _PAIRS), "labelled"),
)
def q_corr_pairs(spark, sf):
    return r6(A.corr_pairs(B.labelled(spark, sf), _PAIRS))


@register(
    "A17_W1_default_timing",
    oracle("""SELECT months, n, round(sum(n) OVER (ORDER BY months ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    / (SELECT count(*) FROM loans WHERE loan_status = 'Charged Off' AND last_pymnt_d IS NOT NULL), 6) AS cum_share
FROM (SELECT (year(last_pymnt_d) * 12 + month(last_pymnt_d)) - (year(issue_d) * 12 + month(issue_d)) AS months, count(*) AS n
      FROM loans WHERE loan_status = 'Charged Off' AND last_pymnt_d IS NOT NULL GROUP BY 1) h WHERE months BETWEEN 0 AND 72""", "loans"),
)
def q_timing(spark, sf):
    return r6(A.default_timing(B.loans(spark, sf), "issue_d", "last_pymnt_d", "loan_status", ("Charged Off",), 72))


@register(
    "A18_distinct_counts",
    oracle(_u("SELECT '{c}' AS column, count(DISTINCT CAST({c} AS VARCHAR)) AS n_distinct FROM loans",
              ["purpose", "addr_state", "emp_length", "verification_status", "term"]), "loans"),
)
def q_distinct(spark, sf):
    return A.distinct_counts(B.loans(spark, sf), ["purpose", "addr_state", "emp_length", "verification_status", "term"])


@register(
    "A19_fully_null_by_split",
    oracle(_u("SELECT split, '{c}' AS column FROM labelled GROUP BY split HAVING count({c}) = 0",
              ["annual_inc", "dti", "emp_length", "purpose"])
           + " UNION ALL SELECT split, 'income_in_test' AS column FROM labelled GROUP BY split HAVING count(annual_inc) FILTER (WHERE split = 'test') = 0",
           "labelled"),
)
def q_fully_null(spark, sf):
    df = B.labelled(spark, sf).withColumn("income_in_test", F.when(F.col("split") == "test", F.col("annual_inc")))
    return A.fully_null(df.select("split", "annual_inc", "dti", "emp_length", "purpose", "income_in_test"), "split")


_PAT = ["annual_inc", "dti", "emp_length", "mths_since_last_delinq"]


@register(
    "A20_null_patterns",
    oracle("SELECT " + " || ".join(f"CAST(CAST({c} IS NULL AS INTEGER) AS VARCHAR)" for c in _PAT)
           + " AS pattern, count(*) AS n FROM loans GROUP BY 1", "loans"),
)
def q_null_patterns(spark, sf):
    return A.null_patterns(B.loans(spark, sf), _PAT)


@register("A20_same_null_rows", oracle("SELECT bool_and((dti IS NULL) = (revol_util IS NULL)) AS same_null_rows FROM loans", "loans"))
def q_same_null(spark, sf):
    return A.same_null_rows(B.loans(spark, sf), "dti", "revol_util")


@register(
    "A22_A23_overview",
    oracle("""SELECT count(*) AS total_logged,
  count(*) FILTER (WHERE logged_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR) AS requests_last_24h,
  count(*) FILTER (WHERE logged_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 HOUR) AS requests_last_1h,
  count(*) FILTER (WHERE pred = 0) AS n_pred_0, count(*) FILTER (WHERE pred = 1) AS n_pred_1,
  round(quantile_cont(prob, 0.5), 6) AS p50, round(quantile_cont(prob, 0.9), 6) AS p90, round(quantile_cont(prob, 0.95), 6) AS p95,
  round(quantile_cont(prob, 0.99), 6) AS p99, round(max(prob), 6) AS p_max, min(logged_at) AS first_logged, max(logged_at) AS last_logged,
  round(100.0 * count(*) FILTER (WHERE pred = 1) / greatest(1, count(*) FILTER (WHERE pred IN (0, 1))), 6) AS predicted_default_rate
FROM logs""", "logs"),
)
def q_overview(spark, sf):
    return r6(A.overview(B.prediction_logs(spark, sf), B.LOG_AS_OF))


@register(
    "A24_score_distribution",
    oracle("""SELECT CAST(b.i AS INTEGER) AS bin, round(CAST(b.i AS DOUBLE) * (1.0 / 30), 6) AS range_start,
  round(CASE WHEN b.i = 29 THEN 1.0 ELSE CAST(b.i + 1 AS DOUBLE) * (1.0 / 30) END, 6) AS range_end, CAST(count(h.bin) AS BIGINT) AS n
FROM range(0, 30) b(i) LEFT JOIN (SELECT (SELECT count(*) FROM range(1, 30) r(i) WHERE CAST(i AS DOUBLE) * (1.0 / 30) <= s.prob) AS bin
  FROM logs s WHERE s.prob >= 0 AND s.prob <= 1) h ON h.bin = b.i GROUP BY b.i""", "logs"),
)
def q_score_dist(spark, sf):
    hist, _s = A.score_hist(B.prediction_logs(spark, sf), 30, "prob")
    return r6(hist)


@register(
    "A24_score_summary",
    oracle("SELECT round(avg(prob), 6) AS mean, round(quantile_cont(prob, 0.5), 6) AS median FROM logs WHERE prob IS NOT NULL", "logs"),
)
def q_score_summary(spark, sf):
    _h, summary = A.score_hist(B.prediction_logs(spark, sf), 30, "prob")
    return r6(summary)


@register(
    "A25_positives_by_segment",
    oracle("SELECT purpose, count(*) AS n, CAST(sum(target) AS BIGINT) AS n_pos FROM labelled GROUP BY purpose", "labelled"),
)
def q_positives(spark, sf):
    return A.positives_by(B.labelled(spark, sf), "target", "purpose")


@register("A26_date_span", oracle("SELECT split, min(issue_d) AS first_date, max(issue_d) AS last_date FROM labelled GROUP BY split",
                                  "labelled"))
def q_span(spark, sf):
    return A.date_span(B.labelled(spark, sf), "issue_d", "split")

