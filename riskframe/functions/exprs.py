"""Column -> Column expressions.

All built from ``pyspark.sql.functions`` so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import specs


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_lit(value) -> Column:
    """A wall-clock TIMESTAMP_NTZ literal built from text, so it means the same instant
    whatever the session time zone (a plain ``lit(datetime)`` is zone-dependent)."""
    from datetime import date, datetime

    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    if isinstance(value, date):
        return F.lit(value.isoformat()).cast("timestamp_ntz")
    return F.lit(str(value)).cast("timestamp_ntz")


def round6(x, digits: int = 6) -> Column:
    """Half-up rounding as floor(x * 10^d + 0.5) / 10^d: plain IEEE steps, so two engines
    that hold the same double produce the same rounded double."""
    scale = float(10 ** digits)
    return F.floor(_c(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def credit_age_yrs(issue_d="issue_d", earliest="earliest_cr_line") -> Column:
    """F1: whole days between the two dates / 365.25."""
    return F.datediff(F.to_date(_c(issue_d)), F.to_date(_c(earliest))).cast("double") / F.lit(365.25)


def fico_mid(low="fico_range_low", high="fico_range_high") -> Column:
    """midpoint of the FICO range."""
    return (_c(low).cast("double") + _c(high).cast("double")) / F.lit(2.0)


def loan_to_income(loan="loan_amnt", income="annual_inc") -> Column:
    """loan / (income + 1); a zero denominator gives NULL, not infinity."""
    return F.try_divide(_c(loan).cast("double"), _c(income).cast("double") + F.lit(1.0))


def ins_to_income(installment="installment", income="annual_inc") -> Column:
    """12 * installment / (income + 1)."""
    return F.try_divide(F.lit(12.0) * _c(installment).cast("double"), _c(income).cast("double") + F.lit(1.0))


def grade_rank(grade="grade") -> Column:
    """A..G -> 1..7."""
    return (F.ascii(F.upper(F.substring(_c(grade), 1, 1))) - F.lit(64)).cast("int")


def sub_grade_rank(sub_grade="sub_grade") -> Column:
    """letter rank + digit / 10 (A1 -> 1.1, G5 -> 7.5)."""
    return grade_rank(sub_grade).cast("double") + F.substring(_c(sub_grade), 2, 1).cast("int") / F.lit(10.0)


def decide(p="p", threshold=0.5) -> Column:
    """decision = p >= threshold as 0/1."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_c(p) >= t).cast("int")


def drift_level(psi="psi") -> Column:
    """stable / moderate / significant; NULL or NaN falls to significant."""
    v = _c(psi)
    return (
        F.when(v.isNull() | F.isnan(v), F.lit("significant"))
        .when(v < F.lit(specs.DRIFT_STABLE_BELOW), F.lit("stable"))
        .when(v < F.lit(specs.DRIFT_MODERATE_BELOW), F.lit("moderate"))
        .otherwise(F.lit("significant"))
    )


def sigmoid(margin="margin") -> Column:
    """F8: logistic function of a margin."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(margin)))


def clamp(x, lo, hi) -> Column:
    """least(greatest(x, lo), hi)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.least(F.greatest(_c(x), lo_c), hi_c)


def apr_bucket(fico_low="fico_range_low") -> Column:
    """APR in percent by FICO bucket."""
    v = _c(fico_low)
    expr = None
    for bound, apr in specs.APR_BY_FICO:
        expr = F.when(v >= F.lit(bound), F.lit(apr)) if expr is None else expr.when(v >= F.lit(bound), F.lit(apr))
    return expr.otherwise(F.lit(specs.APR_FLOOR))


def js_round(x: Column) -> Column:
    """JavaScript Math.round: floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5)).cast("double")


def amortised_payment(principal="loan_amnt", apr=None, months="term_months") -> Column:
    """monthly payment of an amortised loan, rounded to cents (half up)."""
    r = _c(apr) / F.lit(100.0) / F.lit(12.0)
    factor = F.pow(F.lit(1.0) + r, _c(months).cast("double"))
    payment = _c(principal) * r * factor / (factor - F.lit(1.0))
    return js_round(payment * F.lit(100.0)) / F.lit(100.0)


def risk_score(fico_low="fico_range_low", dti="dti", util="revol_util", delinq="delinq_2yrs", inq="inq_last_6mths") -> Column:
    """composite 0..1 risk score from five clamped components."""
    w = specs.RISK_WEIGHTS
    parts = (
        F.lit(w["fico"]) * clamp((F.lit(specs.RISK_FICO_TOP) - _c(fico_low)) / F.lit(specs.RISK_FICO_SPAN), 0, 1)
        + F.lit(w["dti"]) * clamp(_c(dti) / F.lit(specs.RISK_DTI_SCALE), 0, 1)
        + F.lit(w["util"]) * clamp(_c(util) / F.lit(specs.RISK_UTIL_SCALE), 0, 1)
        + F.lit(w["delinq"]) * clamp(_c(delinq) / F.lit(specs.RISK_DELINQ_SCALE), 0, 1)
        + F.lit(w["inq"]) * clamp(_c(inq) / F.lit(specs.RISK_INQ_SCALE), 0, 1)
    )
    return clamp(parts, 0, 1)


def years_ago(as_of, n) -> Column:
    """date n years before ``as_of`` (29 Feb clamps to 28 Feb)."""
    n_c = n if isinstance(n, Column) else F.lit(int(n))
    return F.add_months(F.to_date(_c(as_of)), -n_c * F.lit(12))


def strip_prefix(feature="feature") -> Column:
    """drop the ``num__`` / ``cat__`` transformer prefix."""
    return F.regexp_replace(_c(feature), r"^(num|cat)__", "")


def humanise(feature="feature") -> Column:
    """``num__annual_inc`` -> ``Annual Inc`` (word-initial capitals, rest kept)."""
    words = F.split(F.regexp_replace(strip_prefix(feature), "_", " "), " ", -1)
    cap = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    return F.array_join(cap, " ")


def safe_name(name="feature") -> Column:
    """F16: feature-name sanitising, ``<`` -> ``lt``, ``[`` and ``]`` -> ``_``."""
    return F.regexp_replace(F.regexp_replace(_c(name), "<", "lt"), r"[\[\]]", "_")


def hour(ts="logged_at") -> Column:
    """truncate a timestamp to its hour."""
    return F.date_trunc("hour", _c(ts))


def month_ordinal(d="issue_d") -> Column:
    """calendar-month ordinal year*12 + month (not ``months_between``)."""
    return F.year(_c(d)).cast("bigint") * F.lit(12) + F.month(_c(d)).cast("bigint")


def days_between(later, earlier) -> Column:
    """whole days later - earlier."""
    return F.datediff(F.to_date(_c(later)), F.to_date(_c(earlier)))


def to_payload(*cols: str) -> Column:
    """row -> JSON object keeping nulls, dates as ISO strings."""
    return F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"})


def from_payload(json_col, schema) -> Column:
    """JSON payload -> typed struct (malformed fields become NULL)."""
    return F.from_json(_c(json_col), schema, {"mode": "PERMISSIVE"})


def mean_score(*cols) -> Column:
    """mean ensemble of several probability columns."""
    total = None
    for c in cols:
        total = _c(c) if total is None else total + _c(c)
    return total / F.lit(float(len(cols)))


def to_double(c) -> Column:
    """coerce to double, unparseable -> NULL."""
    return F.expr(f"try_cast(`{c}` AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")


def month_label(d="issue_d") -> Column:
    """format as ``MMM-yyyy`` (inverse of the raw-date parser)."""
    return F.date_format(_c(d), "MMM-yyyy")


def parse_month(c) -> Column:
    """``MMM-yyyy`` -> first-of-month timestamp; bad input -> NULL."""
    return F.to_timestamp_ntz(F.try_to_timestamp(F.concat(F.lit("01-"), _c(c)), F.lit("dd-MMM-yyyy")))


def bracket(x, edges, labels) -> Column:
    """A10: right-closed fixed-edge brackets; values at or below the first edge -> NULL."""
    v = _c(x)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (v > F.lit(lo)) & (v <= F.lit(hi)) if hi != float("inf") else (v > F.lit(lo))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def reason_strength(ratio) -> Column:
    """Strongly / moderately / slightly by ratio to the strongest code."""
    r = _c(ratio)
    return (
        F.when(r > F.lit(specs.STRENGTH_STRONG_ABOVE), F.lit("strongly"))
        .when(r > F.lit(specs.STRENGTH_MODERATE_ABOVE), F.lit("moderately"))
        .otherwise(F.lit("slightly"))
    )


def keyed_normal(key: Column, name: str, seed: int) -> Column:
    """Standard normal number of (key, name, seed): two 32-bit numbers of an MD5, turned by Box-Muller.

    It depends on nothing else, so partitioning, order and retries do not change it, and any SQL engine can repeat it.
    """
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(name), F.lit(str(seed))).cast("binary"))
    number = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("double")
    u1, u2 = (number(1) + F.lit(1.0)) / F.lit(2.0 ** 32), number(9) / F.lit(2.0 ** 32)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)
