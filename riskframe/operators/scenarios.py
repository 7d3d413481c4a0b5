"""expand a few curated applicant inputs into a fuller, internally consistent application.

Every derived field is a column expression over the inputs table (one
``select``), driven by the composite risk score (F12): credit limits shrink and
account counts shift as risk grows. ``as_of`` is an explicit parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import specs
from riskframe.functions.exprs import amortised_payment, apr_bucket, clamp, js_round, risk_score, ts_lit, years_ago


def expand_profile(inputs: DataFrame, as_of, key: str = "id") -> DataFrame:
    """Inputs: key, loan_amnt, term_months, annual_inc, dti, fico_range_low, revol_util,
    credit_history_years, delinq_2yrs, inq_last_6mths, open_acc."""
    c = F.col
    risk = risk_score("fico_range_low", "dti", "revol_util", "delinq_2yrs", "inq_last_6mths")
    apr = apr_bucket("fico_range_low")
    step1 = inputs.select(
        key, "loan_amnt", "term_months", "annual_inc", "dti", "fico_range_low", "revol_util", "credit_history_years",
        "delinq_2yrs", "inq_last_6mths", "open_acc",
        (c("fico_range_low") + F.lit(4)).alias("fico_range_high"),
        risk.alias("risk_score"),
        apr.alias("apr"),
        years_ago(ts_lit(as_of), c("credit_history_years")).alias("earliest_cr_line"),
    )
    step2 = step1.withColumns({
        "installment": amortised_payment("loan_amnt", c("apr"), "term_months"),
        "total_rev_hi_lim": js_round(clamp(c("annual_inc") * F.lit(0.22) * (F.lit(1.0) - F.lit(0.4) * c("risk_score")), 2000, 250000)),
        "bc_util": clamp(c("revol_util") * F.lit(1.05), 0, 100),
    })
    step3 = step2.withColumns({
        "revol_bal": js_round(c("revol_util") / F.lit(100.0) * c("total_rev_hi_lim")),
        "total_bc_limit": js_round(c("total_rev_hi_lim") * F.lit(0.6)),
        "percent_bc_gt_75": clamp((c("bc_util") - F.lit(50.0)) * F.lit(2.0), 0, 100),
        "total_acc": F.greatest(c("open_acc").cast("double"),
                                js_round(c("open_acc") + c("credit_history_years") * F.lit(0.6) + c("risk_score") * F.lit(2.0))),
    })
    step4 = step3.withColumns({
        "bc_open_to_buy": F.greatest(F.lit(0.0), js_round(c("total_bc_limit") - c("bc_util") / F.lit(100.0) * c("total_bc_limit"))),
        "num_sats": F.least(c("total_acc"), js_round(c("total_acc") * (F.lit(1.0) - c("risk_score") * F.lit(0.15)))),
        "num_rev_accts": F.greatest(F.lit(1.0), js_round(c("total_acc") * F.lit(0.55))),
    })
    return step4.withColumn("num_op_rev_tl", F.least(c("open_acc").cast("double"), c("num_rev_accts")))


def full_application(inputs: DataFrame, as_of, key: str = "id") -> DataFrame:
    """key and the 66 fields of an application (``specs.APPLICATION_FIELDS``), from the inputs of ``expand_profile`` plus
    term, emp_length, home_ownership and purpose. One projection: a record is expanded where it lies.
    """
    c, lit, r = F.col, F.lit, F.col("risk_score")
    kept = ["term", "emp_length", "home_ownership", "purpose"]
    wide = expand_profile(inputs.withColumn(key, F.struct(c(key).alias("k"), *kept)), as_of, key)
    df = wide.withColumns({k: c(f"{key}.{k}") for k in kept}).withColumn(key, c(f"{key}.k"))
    share = lambda of, part: F.greatest(lit(0.0), js_round(c(of) * part))
    line = {f: js_round(lit(base) + lit(a) * r + lit(b) * (lit(1.0) - r)) for f, (base, a, b) in specs.RISK_LINES.items()}
    flag = lambda cond: F.when(cond, lit(1.0)).otherwise(lit(0.0))
    late, months = c("delinq_2yrs") > 0, c("credit_history_years") * lit(12.0)
    df = df.withColumns({f: flag(r > lit(bound)) for f, bound in specs.FLAGS_ABOVE_RISK.items()} | {
        f: flag(c("delinq_2yrs") >= lit(n)) for f, n in specs.FLAGS_FROM_DELINQ.items()} | {
        "num_actv_rev_tl": F.greatest(lit(1.0), js_round(c("num_op_rev_tl") * lit(0.8))),
        "mort_acc": F.when(c("home_ownership") == "MORTGAGE", js_round(lit(1.0) + (lit(1.0) - r) * lit(2.0))).otherwise(lit(0.0)),
        "mo_sin_rcnt_tl": js_round(clamp(lit(24.0) - r * lit(20.0), 1, 60)),
        "total_il_high_credit_limit": js_round(c("annual_inc") * lit(0.15) * (lit(1.0) - r * lit(0.3))),
        "num_tl_op_past_12m": line["num_tl_op_past_12m"],
    })
    df = df.withColumns({
        "num_actv_bc_tl": share("num_actv_rev_tl", 0.5),
        "num_il_tl": F.greatest(lit(0.0), js_round(c("total_acc") - c("num_rev_accts") - c("mort_acc"))),
        "num_rev_tl_bal_gt_0": share("num_actv_rev_tl", 0.85),
        "acc_open_past_24mths": js_round(c("num_tl_op_past_12m") * lit(1.5)),
        "mo_sin_rcnt_rev_tl_op": c("mo_sin_rcnt_tl") + js_round(r * lit(3.0)),
        "total_bal_ex_mort": js_round(c("revol_bal") + c("total_il_high_credit_limit") * lit(0.3)),
    })
    owned = lambda years: F.when(c("mort_acc") > 0, c("annual_inc") * lit(years)).otherwise(lit(0.0))
    df = df.withColumns({
        "num_bc_tl": F.greatest(c("num_actv_bc_tl"), js_round(c("num_rev_accts") * lit(0.4))),
        "tot_cur_bal": js_round(c("total_bal_ex_mort") + owned(1.5)),
        "tot_hi_cred_lim": js_round(c("total_rev_hi_lim") + c("total_il_high_credit_limit") + owned(2.0)),
    })
    status = F.lit(specs.VERIFICATION_ELSE)
    for bound, name in reversed(specs.VERIFICATION_BY_RISK):
        status = F.when(r < lit(bound), lit(name)).otherwise(status)
    asked = c("inq_last_6mths") > 0
    out = df.withColumns({
        "num_bc_sats": share("num_bc_tl", lit(1.0) - r * lit(0.1)),
        "avg_cur_bal": js_round(c("tot_cur_bal") / F.greatest(lit(1.0), c("total_acc"))),
        "mo_sin_old_rev_tl_op": F.greatest(lit(12.0), months - c("mo_sin_rcnt_rev_tl_op")),
        "mo_sin_old_il_acct": F.greatest(lit(12.0), js_round(months * lit(0.8))),
        "delinq_amnt": F.when(c("acc_now_delinq") > 0, line["delinq_amnt"]).otherwise(lit(0.0)),
        "tot_coll_amt": F.when(r > 0.6, line["tot_coll_amt"]).otherwise(lit(0.0)),
        "num_tl_30dpd": flag((c("delinq_2yrs") >= 1) & (r > 0.7)),
        "num_tl_120dpd_2m": lit(0.0),
        "pct_tl_nvr_dlq": js_round(clamp(lit(100.0) - r * lit(35.0), 60, 100)),
        "percent_bc_gt_75": js_round(c("percent_bc_gt_75")),
        "bc_util": js_round(c("bc_util")),
        "pub_rec_bankruptcies": c("pub_rec"),
        "mths_since_last_delinq": F.when(late, js_round(F.greatest(lit(1.0), lit(24.0) - c("delinq_2yrs") * lit(4.0)))),
        "mths_since_last_record": F.when(c("pub_rec") > 0, line["mths_since_last_record"]),
        "mths_since_last_major_derog": F.when(r > 0.75, line["mths_since_last_major_derog"]),
        "mths_since_recent_bc": line["mths_since_recent_bc"],
        "mths_since_recent_bc_dlq": F.when(late & (r > 0.5), line["mths_since_recent_bc_dlq"]),
        "mths_since_recent_inq": F.when(asked, js_round(lit(1.0) + F.greatest(lit(0.0), lit(6.0) - c("inq_last_6mths")))).otherwise(
            js_round(lit(12.0) + (lit(1.0) - r) * lit(20.0))),
        "mths_since_recent_revol_delinq": F.when(late & (r > 0.5), line["mths_since_recent_revol_delinq"]),
        "verification_status": status,
        **{f: lit(v) for f, v in specs.APPLICATION_CONSTANTS.items()},
    })
    text = {"earliest_cr_line", "term", "emp_length", "home_ownership", "verification_status", "purpose", "addr_state", "initial_list_status"}
    return out.select(key, *[c(f) if f in text else c(f).cast("double").alias(f) for f in specs.APPLICATION_FIELDS])
