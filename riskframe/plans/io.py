"""Bound source/sink round trips (S1, S4-S7, S9-S11, S15) and the drift detail view.

Each writes into a fresh folder under the shared checkpoint folder and reads
the result back, so the returned rows are what a downstream job would see.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from riskframe.operators import drift as D
from riskframe.operators import profile as A
from riskframe.plans.common import r6
from riskframe.plans.drift import CAT, LIVE_CAT, LIVE_NUM, NUM, _REF, _VALTEST, _valtest_report, reference_profile, report_sql
from riskframe.plans.features import MATRIX_SQL, matrix_cells
from riskframe.plans.profile import _CUT_STATS, _CUT_VALS
from riskframe.plans.profile import NUM as PROFILE_NUM
from riskframe.plans.registry import register
from riskframe.session import cut_lineage
from riskframe.sources import bindings as B
from riskframe.sources import io as IO
from riskframe.sources.bindings import oracle
from riskframe.streaming.jobs import scratch

CSV_COLS = ["loan_id", "issue_d", "term", "loan_amnt", "annual_inc", "dti", "emp_length", "purpose"]


@register(
    "S1_S2_csv_round_trip",
    oracle("""SELECT CAST(loan_id AS DOUBLE) AS loan_id, CAST(date_trunc('month', issue_d) AS TIMESTAMP) AS issue_d, term,
  round(loan_amnt, 2) AS loan_amnt, round(annual_inc, 2) AS annual_inc, dti, emp_length, purpose FROM loans""", "loans"),
)
def q_csv(spark, sf):
    """Raw CSV written from the loans view with thousands separators, null tokens and ``MMM-yyyy`` dates, then read back."""
    df = B.loans(spark, sf)
    text = df.select(
        F.col("loan_id").cast("string").alias("loan_id"),
        F.date_format("issue_d", "MMM-yyyy").alias("issue_d"),
        "term",
        F.format_number("loan_amnt", 2).alias("loan_amnt"),
        F.when(F.col("annual_inc").isNull(), F.lit("NA")).otherwise(F.format_number("annual_inc", 2)).alias("annual_inc"),
        F.when(F.col("dti").isNull(), F.lit("")).otherwise(F.col("dti").cast("string")).alias("dti"),
        F.coalesce(F.col("emp_length"), F.lit("N/A")).alias("emp_length"),
        "purpose",
    )
    path = scratch(spark, "loans-csv")
    text.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return IO.read_loans_csv(spark, path, CSV_COLS, numeric=["loan_id", "loan_amnt", "annual_inc", "dti"], dates=["issue_d"])


@register("S3_S4_S5_build_and_load_splits", oracle("SELECT loan_id, split FROM labelled", "labelled"))
def q_build_load(spark, sf):
    path = scratch(spark, "dataset")
    checks = {"target is 0 or 1": F.col("target").isin(0, 1), "loan_id is known": F.col("loan_id").isNotNull()}
    train, val, test, receipt = IO.build_dataset(spark, lambda: B.build_labelled(spark, sf), path, checks=checks)
    # second call finds every output and skips the build
    again = IO.build_dataset(spark, lambda: B.build_labelled(spark, sf), path)
    assert again[3].count() == receipt.count()
    return train.unionByName(val).unionByName(test).select("loan_id", "split")


@register("S6_feature_matrix_store", MATRIX_SQL)
def q_features_store(spark, sf):
    """Sparse matrix and fitted stats published together, read back and unpacked to cells."""
    from riskframe.operators import features as M

    lab = B.labelled(spark, sf)
    stats = M.fit(lab.filter(F.col("split") == "train"), NUM, CAT)
    matrix = M.transform_sparse(lab, stats, M.feature_index(stats, NUM), ["loan_id", "split", "target"], NUM, CAT)
    path = scratch(spark, "features")
    IO.write_features(matrix, stats, path)
    return matrix_cells(IO.load_features(spark, path)[0])


@register("S7_report_csv", report_sql(_REF, _VALTEST, NUM, CAT))
def q_report_csv(spark, sf):
    path = scratch(spark, "drift-report")
    IO.write_report_csv(_valtest_report(spark, sf), path)
    back = spark.read.schema("feature string, PSI double, drift_level string, target_label string").option("header", True).csv(path)
    return r6(back)


_LOG_COLS = ["request_id", "logged_at", "issue_d", "loan_amnt", "annual_inc", "dti", "revol_util", "pub_rec", "delinq_2yrs",
             "mths_since_last_delinq", "mths_since_last_record", "fico_range_low", "fico_range_high", "earliest_cr_line", "term",
             "purpose", "addr_state", "emp_length", "home_ownership", "pred", "prob"]


@register("S9_append_log", oracle(
    "SELECT request_id, logged_at, issue_d, loan_amnt, annual_inc, dti, term, purpose, addr_state, pred, round(prob, 6) AS prob, "
    "CAST(logged_at AS DATE) AS log_date, "
    "'{\"annual_inc\":' || CAST(pred AS VARCHAR) || ',\"dti\":' || CAST(1 - pred AS VARCHAR) || '}' AS reason_codes FROM logs", "logs"))
def q_append_log(spark, sf):
    # Every input of the log in its fixed order, and the reason codes as JSON; two appends make one table.
    reasons = F.to_json(F.create_map(F.lit("annual_inc"), F.col("pred"), F.lit("dti"), 1 - F.col("pred")))
    logs = B.prediction_logs(spark, sf).withColumn("reason_codes", reasons)
    path = scratch(spark, "log-table")
    spec = [*_LOG_COLS, "reason_codes"]
    IO.append_log(logs.filter(F.col("request_id") % 2 == 0), path, spec, "even")
    for _ in range(2):  # the second run is repeated, as after a failure
        IO.append_log(logs.filter(F.col("request_id") % 2 == 1), path, spec, "odd")
    back = IO.read_runs(spark, path)
    if back.columns != [*spec, "log_date"]:
        raise ValueError("the log table has lost its column order")
    return r6(back.select("request_id", "logged_at", "issue_d", "loan_amnt", "annual_inc", "dti", "term", "purpose", "addr_state", "pred",
                          "prob", "log_date", "reason_codes"))


@register(
    "S10_append_snapshot",
    report_sql("SELECT * FROM labelled WHERE split = 'train'", "SELECT *, 'live' AS target_label FROM logs", LIVE_NUM, LIVE_CAT,
               needs=("labelled", "logs"),
               select="""SELECT feature, round(PSI, 6) AS psi, drift_level, target_label, (SELECT count(*) FROM ref) AS reference_size,
  (SELECT count(*) FROM logs) AS live_size, TIMESTAMP '2024-01-31 00:00:00' AS computed_at FROM rep"""),
)
def q_snapshot(spark, sf):
    profile = reference_profile(spark, sf).of(LIVE_NUM, LIVE_CAT)
    counts = cut_lineage(profile.counts(B.prediction_logs(spark, sf)).withColumn("target_label", F.lit("live")))  # the log is read once
    path = scratch(spark, "snapshots")
    sizes = [F.lit(D.population(c)) for c in (profile.buckets, counts)]
    for _ in range(2):  # a repeated run replaces its rows
        IO.append_snapshot(D.report_of_counts(profile, counts), path, datetime(2024, 1, 31), *sizes)
    back = IO.read_runs(spark, path).drop("snapshot_date")
    return r6(back)


@register("S11_load_reference", oracle("SELECT loan_id, target FROM labelled WHERE split = 'train'", "labelled"))
def q_reference(spark, sf):
    path = scratch(spark, "reference")
    B.labelled(spark, sf).filter(F.col("split") == "train").write.parquet(path)
    return IO.load_reference(spark, path).select("loan_id", "target")


@register(
    "S15_store_cuts",
    oracle("""SELECT s.column, CAST(g.i AS INTEGER) AS bin,
  round(CASE WHEN g.i = 0 THEN s.lo - (s.hi - s.lo) * 0.001 ELSE CAST(g.i AS DOUBLE) * ((s.hi - s.lo) / 10.0) + s.lo END, 6) AS lower,
  round(CASE WHEN g.i = 9 THEN s.hi ELSE CAST(g.i + 1 AS DOUBLE) * ((s.hi - s.lo) / 10.0) + s.lo END, 6) AS upper,
  CAST((SELECT count(*) FROM vals v WHERE v.column = s.column AND
        (SELECT count(*) FROM range(1, 10) q(j) WHERE CAST(j AS DOUBLE) * ((s.hi - s.lo) / 10.0) + s.lo < v.v) = g.i) AS BIGINT) AS n
FROM stats s, range(0, 10) g(i) WHERE s.lo < s.hi""", "labelled", extra={"stats": _CUT_STATS, "vals": _CUT_VALS}),
)
def q_cuts(spark, sf):
    cuts = A.equal_width_cuts(B.labelled(spark, sf), PROFILE_NUM, 10).withColumn("bin", F.col("bin").cast("int"))
    path = scratch(spark, "cuts")
    cuts.write.parquet(path)
    return r6(spark.read.parquet(path))


_DETAIL_EDGES = "SELECT e.inner FROM e WHERE e.feature = 'annual_inc'"


@register(
    "D9_feature_detail",
    report_sql("SELECT * FROM labelled WHERE split = 'train'", "SELECT *, 'live' AS target_label FROM logs", LIVE_NUM, LIVE_CAT,
               needs=("labelled", "logs"), select=f"""SELECT CAST(b.bucket AS INTEGER) AS bucket,
  round(CASE WHEN b.bucket > 0 THEN x.inner[b.bucket] END, 6) AS range_start,
  round(CASE WHEN b.bucket < len(x.inner) THEN x.inner[b.bucket + 1] END, 6) AS range_end,
  round(coalesce((SELECT count(*) FROM ref WHERE annual_inc IS NOT NULL AND len(list_filter(x.inner, lambda z: z < annual_inc)) = b.bucket)
        / (SELECT count(annual_inc) FROM ref), 0), 6) AS reference_pct,
  round(coalesce((SELECT count(*) FROM logs WHERE annual_inc IS NOT NULL AND len(list_filter(x.inner, lambda z: z < annual_inc)) = b.bucket)
        / (SELECT count(annual_inc) FROM logs), 0), 6) AS live_pct,
  round(1 - (SELECT count(annual_inc) FROM ref) / (SELECT count(*) FROM ref), 6) AS reference_missing_pct,
  round(1 - (SELECT count(annual_inc) FROM logs) / (SELECT count(*) FROM logs), 6) AS live_missing_pct,
  'annual_inc' AS feature, round(r.PSI, 6) AS psi, r.drift_level
FROM ({_DETAIL_EDGES}) x, range(0, 10) b(bucket), rep r WHERE b.bucket <= len(x.inner) AND r.feature = 'annual_inc'"""),
)
def q_detail(spark, sf):
    detail = D.feature_detail(reference_profile(spark, sf), B.prediction_logs(spark, sf), "annual_inc", LIVE_NUM, LIVE_CAT)
    return r6(detail.withColumn("bucket", F.col("bucket").cast("int")))


@register(
    "D9_feature_detail_categorical",
    report_sql("SELECT * FROM labelled WHERE split = 'train'", "SELECT *, 'live' AS target_label FROM logs", LIVE_NUM, LIVE_CAT,
               needs=("labelled", "logs"), select="""SELECT coalesce(a.category, l.category) AS category, 'emp_length' AS feature,
  round(coalesce(a.n, 0) / (SELECT count(emp_length) FROM ref), 6) AS reference_pct,
  round(coalesce(l.n, 0) / (SELECT count(emp_length) FROM logs), 6) AS live_pct, (a.n IS NULL AND l.n > 0) AS unseen,
  round((SELECT PSI FROM rep WHERE feature = 'emp_length'), 6) AS psi, (SELECT drift_level FROM rep WHERE feature = 'emp_length') AS drift_level
FROM (SELECT emp_length AS category, count(*) AS n FROM ref WHERE emp_length IS NOT NULL GROUP BY 1) a
FULL OUTER JOIN (SELECT emp_length AS category, count(*) AS n FROM logs WHERE emp_length IS NOT NULL GROUP BY 1) l ON a.category = l.category"""),
)
def q_detail_categorical(spark, sf):
    return r6(D.feature_detail(reference_profile(spark, sf), B.prediction_logs(spark, sf), "emp_length", LIVE_NUM, LIVE_CAT))
