"""Bound drift queries.

Reference = train split of the labelled loans. Targets: val/test splits, a
drift-injected copy of test (B4 rules), and the prediction log as the live
population (daily populations for the snapshot history).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from riskframe import specs
from riskframe.operators import drift as D
from riskframe.plans.common import r6
from riskframe.plans.registry import register
from riskframe.sources import bindings as B
from riskframe.sources.bindings import oracle
from riskframe.sources.io import stored_table

NUM = list(B.LOAN_ROLES.numeric)
CAT = list(B.LOAN_ROLES.categorical)
LIVE_NUM = ["loan_amnt", "annual_inc", "dti", "revol_util", "mths_since_last_delinq", "fico_range_low"]
LIVE_CAT = ["term", "purpose", "emp_length"]
LEVELS = [i * (1 / 10) for i in range(1, 10)]


def _train(spark, sf):
    return B.labelled(spark, sf).filter(F.col("split") == "train")


def _split(spark, sf, name):
    return B.labelled(spark, sf).filter(F.col("split") == name)


def reference_profile(spark, sf):
    """The fitted train reference, stored once per input folder in the shared folder."""
    inputs = [f"{sf.rstrip('/')}/{t}.parquet" for t in ("orders", "customer", "nation", "lineitem")]
    num, cat = list(dict.fromkeys([*NUM, *LIVE_NUM])), list(dict.fromkeys([*CAT, *LIVE_CAT]))
    table = stored_table(spark, f"profile-v{B.LABELLED_VERSION}", inputs, lambda: D.fit_profile(_train(spark, sf), num, cat).table())
    return D.Profile.from_table(table)


def shifted(df):
    """B4 drift rules on a loan frame (deterministic by loan_id)."""
    k = F.col("loan_id")
    return df.withColumns({
        "annual_inc": F.when(k % 5 == 0, F.lit(None).cast("double"))
        .when(k % 10 < 3, F.col("annual_inc") * F.lit(0.75)).otherwise(F.col("annual_inc")),
        "purpose": F.when(k % 25 == 0, F.lit("NEW")).otherwise(F.col("purpose")),
        "mths_since_last_delinq": F.when(k % 10 == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
    })


_SHIFTED_SQL = """SELECT * REPLACE (
  CASE WHEN loan_id % 5 = 0 THEN NULL WHEN loan_id % 10 < 3 THEN annual_inc * 0.75 ELSE annual_inc END AS annual_inc,
  CASE WHEN loan_id % 25 = 0 THEN 'NEW' ELSE purpose END AS purpose,
  CAST(CASE WHEN loan_id % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS mths_since_last_delinq)
FROM labelled WHERE split = 'test'"""


def psi_sql(ref: str, tgt: str, num, cat, levels=LEVELS, label_col: str = "target_label") -> str:
    """Brute-force PSI in DuckDB: complete (label x feature x bucket) alignment by full outer join."""
    qlist = "[" + ", ".join(repr(q) for q in levels) + "]"
    parts = []
    if num:
        rl = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {ref}" for c in num)
        tl = " UNION ALL ".join(f"SELECT {label_col} AS lbl, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {tgt}" for c in num)
        parts.append(f"""
SELECT lbl, feature, sum((t - r) * ln(t / r)) AS psi FROM (
  SELECT coalesce(a.lbl, b.lbl) AS lbl, coalesce(a.feature, b.feature) AS feature,
    greatest(coalesce(a.n, 0) / (SELECT count(*) FROM {ref}), 1e-4) AS r,
    greatest(coalesce(b.n, 0) / (SELECT count(*) FROM {tgt} x WHERE x.{label_col} = coalesce(a.lbl, b.lbl)), 1e-4) AS t
  FROM (SELECT l.lbl, rb.feature, rb.bucket, rb.n FROM
          (SELECT feature, bucket, count(*) AS n FROM
             (SELECT rl.feature, CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(e.inner, lambda x: x < v)) END AS bucket
              FROM ({rl}) rl JOIN e ON rl.feature = e.feature) z GROUP BY feature, bucket) rb
          CROSS JOIN (SELECT DISTINCT {label_col} AS lbl FROM {tgt}) l) a
  FULL OUTER JOIN
       (SELECT lbl, feature, bucket, count(*) AS n FROM
          (SELECT tl.lbl, tl.feature, CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(e.inner, lambda x: x < v)) END AS bucket
           FROM ({tl}) tl JOIN e ON tl.feature = e.feature) z GROUP BY lbl, feature, bucket) b
  ON a.lbl = b.lbl AND a.feature = b.feature AND a.bucket = b.bucket) s
GROUP BY lbl, feature""")
    if cat:
        rl = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS v FROM {ref}" for c in cat)
        tl = " UNION ALL ".join(f"SELECT {label_col} AS lbl, '{c}' AS feature, CAST({c} AS VARCHAR) AS v FROM {tgt}" for c in cat)
        parts.append(f"""
SELECT lbl, feature, sum((t - r) * ln(t / r)) AS psi FROM (
  SELECT coalesce(a.lbl, b.lbl) AS lbl, coalesce(a.feature, b.feature) AS feature,
    greatest(coalesce(a.n, 0) / (SELECT count(*) FROM {ref}), 1e-4) AS r,
    greatest(coalesce(b.n, 0) / (SELECT count(*) FROM {tgt} x WHERE x.{label_col} = coalesce(a.lbl, b.lbl)), 1e-4) AS t
  FROM (SELECT l.lbl, rb.feature, rb.k, rb.n FROM
          (SELECT feature, CASE WHEN v IS NULL THEN 'M' ELSE 'V' || v END AS k, count(*) AS n FROM ({rl}) rl GROUP BY 1, 2) rb
          CROSS JOIN (SELECT DISTINCT {label_col} AS lbl FROM {tgt}) l) a
  FULL OUTER JOIN
       (SELECT lbl, feature, k, count(*) AS n FROM
          (SELECT tl.lbl, tl.feature,
             CASE WHEN tl.v IS NULL THEN 'M' WHEN EXISTS (SELECT 1 FROM ({rl}) r2 WHERE r2.feature = tl.feature AND r2.v = tl.v)
                  THEN 'V' || tl.v ELSE 'U' END AS k
           FROM ({tl}) tl) z GROUP BY 1, 2, 3) b
  ON a.lbl = b.lbl AND a.feature = b.feature AND a.k = b.k) s
GROUP BY lbl, feature""")
    edges_cte = ""
    if num:
        rl = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {ref}" for c in num)
        edges_cte = f"SELECT feature, coalesce(list_sort(list_distinct(quantile_cont(v, {qlist}))), []::DOUBLE[]) AS inner FROM ({rl}) q GROUP BY feature"
    body = " UNION ALL ".join(parts)
    return edges_cte, body


def report_sql(ref_cte: str, tgt_cte: str, num, cat, needs=("labelled",), label_col="target_label", select=None) -> str:
    edges, body = psi_sql("ref", "tgt", num, cat, label_col=label_col)
    extra = {"ref": ref_cte, "tgt": tgt_cte}
    if edges:
        extra["e"] = edges
    extra["rep"] = f"""SELECT feature, psi AS PSI,
  CASE WHEN psi IS NULL OR isnan(psi) THEN 'significant' WHEN psi < {specs.DRIFT_STABLE_BELOW} THEN 'stable'
       WHEN psi < {specs.DRIFT_MODERATE_BELOW} THEN 'moderate' ELSE 'significant' END AS drift_level, lbl AS {label_col}
FROM ({body}) u"""
    return oracle(select or f"SELECT feature, round(PSI, 6) AS PSI, drift_level, {label_col} FROM rep", *needs, extra=extra)


_REF = "SELECT * FROM labelled WHERE split = 'train'"
_VALTEST = "SELECT *, split AS target_label FROM labelled WHERE split IN ('val', 'test')"
_VAL = "SELECT *, 'val' AS target_label FROM labelled WHERE split = 'val'"


def _valtest_report(spark, sf):
    """Both splits are one population column of one scan."""
    target = B.labelled(spark, sf).filter(F.col("split").isin("val", "test")).withColumn("target_label", F.col("split"))
    return D.drift_report_by(reference_profile(spark, sf), target, NUM, CAT)


@register("D1_psi_numeric", report_sql(_REF, _VAL, NUM, []))
def q_psi_num(spark, sf):
    return r6(D.drift_report(_train(spark, sf), _split(spark, sf, "val"), NUM, [], "val"))


@register("D2_psi_categorical", report_sql(_REF, _VAL, [], CAT))
def q_psi_cat(spark, sf):
    return r6(D.drift_report(_train(spark, sf), _split(spark, sf, "val"), [], CAT, "val"))


@register("D3_D4_drift_report", report_sql(_REF, _VALTEST, NUM, CAT))
def q_report(spark, sf):
    return r6(_valtest_report(spark, sf))


@register("D12_injected_drift_report",
          report_sql(_REF, "SELECT *, 'shifted' AS target_label FROM (" + _SHIFTED_SQL + ") s", NUM, CAT))
def q_injected(spark, sf):
    return r6(D.drift_report(reference_profile(spark, sf), shifted(_split(spark, sf, "test")), NUM, CAT, "shifted"))


@register(
    "D5_A21_level_crosstab",
    report_sql(_REF, _VALTEST, NUM, CAT, select="""SELECT target_label,
  CAST(count(*) FILTER (WHERE drift_level = 'stable') AS BIGINT) AS stable,
  CAST(count(*) FILTER (WHERE drift_level = 'moderate') AS BIGINT) AS moderate,
  CAST(count(*) FILTER (WHERE drift_level = 'significant') AS BIGINT) AS significant FROM rep GROUP BY target_label"""),
)
def q_crosstab(spark, sf):
    return D.level_crosstab(_valtest_report(spark, sf))


@register(
    "D5_O5_flagged_features",
    report_sql(_REF, "SELECT *, 'shifted' AS target_label FROM (" + _SHIFTED_SQL + ") s", NUM, CAT,
               select="SELECT feature, round(PSI, 6) AS PSI, drift_level, target_label FROM rep WHERE drift_level <> 'stable'"),
)
def q_flagged(spark, sf):
    rep = D.drift_report(reference_profile(spark, sf), shifted(_split(spark, sf, "test")), NUM, CAT, "shifted")
    return r6(D.flagged(rep))


@register(
    "O4_top_drift",
    report_sql(_REF, _VALTEST, NUM, CAT,
               select="SELECT feature, round(PSI, 6) AS PSI, drift_level, target_label FROM rep ORDER BY round(PSI, 12) DESC, feature, target_label LIMIT 10"),
)
def q_top(spark, sf):
    return r6(D.top_drift(_valtest_report(spark, sf), 10))


def _live(spark, sf):
    return B.prediction_logs(spark, sf)


_LIVE_REF = "SELECT * FROM labelled WHERE split = 'train'"
_LIVE_TGT = "SELECT *, 'live' AS target_label FROM logs"


@register("D6_live_drift_report", report_sql(_LIVE_REF, _LIVE_TGT, LIVE_NUM, LIVE_CAT, needs=("labelled", "logs")))
def q_live_report(spark, sf):
    return r6(D.drift_report(reference_profile(spark, sf), _live(spark, sf), LIVE_NUM, LIVE_CAT, "live"))


@register(
    "D6_live_drift_summary",
    report_sql(_LIVE_REF, _LIVE_TGT, LIVE_NUM, LIVE_CAT, needs=("labelled", "logs"), select=f"""
SELECT l.drift_level, CAST(count(r.feature) AS BIGINT) AS n, (SELECT count(*) FROM ref) AS reference_size,
  (SELECT count(*) FROM tgt) AS live_size, (SELECT count(*) FROM tgt) < {specs.MIN_LIVE_SAMPLE_SIZE} AS sample_size_warning,
  {specs.MIN_LIVE_SAMPLE_SIZE} AS min_sample_threshold
FROM (VALUES ('stable'), ('moderate'), ('significant')) l(drift_level) LEFT JOIN rep r ON r.drift_level = l.drift_level
GROUP BY l.drift_level"""),
)
def q_live_summary(spark, sf):
    counts, _report = D.drift_summary(reference_profile(spark, sf), _live(spark, sf), LIVE_NUM, LIVE_CAT)
    return counts.withColumns({"n": F.col("n").cast("bigint"), "reference_size": F.col("reference_size").cast("bigint"),
                               "live_size": F.col("live_size").cast("bigint"),
                               "min_sample_threshold": F.col("min_sample_threshold").cast("int")})


_OVERLAY_SQL = oracle(
    f"""SELECT CAST(b.bucket AS INTEGER) AS bucket,
  round(CASE WHEN b.bucket > 0 THEN e.inner[b.bucket] END, 6) AS range_start,
  round(CASE WHEN b.bucket < len(e.inner) THEN e.inner[b.bucket + 1] END, 6) AS range_end,
  round(coalesce((SELECT count(*) FROM ref WHERE annual_inc IS NOT NULL AND len(list_filter(e.inner, lambda x: x < annual_inc)) = b.bucket)
        / (SELECT count(annual_inc) FROM ref), 0), 6) AS reference_pct,
  round(coalesce((SELECT count(*) FROM logs WHERE annual_inc IS NOT NULL AND len(list_filter(e.inner, lambda x: x < annual_inc)) = b.bucket)
        / (SELECT count(annual_inc) FROM logs), 0), 6) AS live_pct,
  round(1 - (SELECT count(annual_inc) FROM ref) / (SELECT count(*) FROM ref), 6) AS reference_missing_pct,
  round(1 - (SELECT count(annual_inc) FROM logs) / (SELECT count(*) FROM logs), 6) AS live_missing_pct
FROM e, range(0, 10) b(bucket) WHERE b.bucket <= len(e.inner)""",
    "labelled", "logs",
    extra={"ref": _LIVE_REF,
           "e": "SELECT coalesce(list_sort(list_distinct(quantile_cont(annual_inc, "
                + "[" + ", ".join(repr(q) for q in LEVELS) + "]))), []::DOUBLE[]) AS inner FROM ref"},
)


@register("D7_numeric_overlay", _OVERLAY_SQL)
def q_num_overlay(spark, sf):
    return r6(D.numeric_overlay(reference_profile(spark, sf), _live(spark, sf), "annual_inc").withColumn("bucket", F.col("bucket").cast("int")))


@register(
    "D8_categorical_overlay",
    oracle(
        """SELECT coalesce(r.category, l.category) AS category, round(coalesce(r.n, 0) / (SELECT count(emp_length) FROM ref), 6) AS reference_pct,
  round(coalesce(l.n, 0) / (SELECT count(emp_length) FROM logs), 6) AS live_pct, (r.n IS NULL AND l.n > 0) AS unseen
FROM (SELECT emp_length AS category, count(*) AS n FROM ref WHERE emp_length IS NOT NULL GROUP BY 1) r
FULL OUTER JOIN (SELECT emp_length AS category, count(*) AS n FROM logs WHERE emp_length IS NOT NULL GROUP BY 1) l ON r.category = l.category""",
        "labelled", "logs", extra={"ref": _LIVE_REF},
    ),
)
def q_cat_overlay(spark, sf):
    return r6(D.categorical_overlay(reference_profile(spark, sf), _live(spark, sf), "emp_length"))


def daily_snapshots(spark, sf):
    """Stored snapshot table, partitioned by day: live drift of each logged day vs the train reference."""
    inputs = [f"{sf.rstrip('/')}/{t}.parquet" for t in ("orders", "customer", "nation", "lineitem", "events")]
    return stored_table(spark, f"snapshots-v{B.LABELLED_VERSION}", inputs, lambda: _build_snapshots(spark, sf), ["snapshot_date"])


def _build_snapshots(spark, sf):
    live = _live(spark, sf).withColumn("day", F.to_date("logged_at"))
    rep = D.drift_report_by(reference_profile(spark, sf), live, LIVE_NUM, LIVE_CAT, label="day")
    return rep.select(
        (F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).alias("computed_at"),
        "feature", F.col("PSI").alias("psi"), "drift_level", F.lit("live").alias("target_label")).withColumn(
        "snapshot_date", F.to_date("computed_at"))


@register(
    "D10_drift_history",
    report_sql(_LIVE_REF, "SELECT *, CAST(logged_at AS DATE) AS day FROM logs", ["annual_inc"], [], needs=("labelled", "logs"),
               label_col="day",
               select="""SELECT CAST(day AS TIMESTAMP) + INTERVAL 1 DAY AS computed_at, round(PSI, 6) AS psi, drift_level FROM rep
WHERE feature = 'annual_inc' AND CAST(day AS TIMESTAMP) + INTERVAL 1 DAY >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY"""),
)
def q_history(spark, sf):
    return r6(D.drift_history(daily_snapshots(spark, sf), "annual_inc", 7, datetime(2024, 1, 31)))


@register(
    "D11_null_shift",
    oracle(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, round(1 - count({c}) / count(*), 6) AS reference_null_rate,
  round((SELECT 1 - count({c}) / count(*) FROM sh), 6) AS target_null_rate,
  round((SELECT 1 - count({c}) / count(*) FROM sh) - (1 - count({c}) / count(*)), 6) AS null_rate_change FROM ref"""
            for c in ["annual_inc", "dti", "emp_length", "purpose"]
        ),
        "labelled", extra={"ref": _REF, "sh": _SHIFTED_SQL},
    ),
)
def q_null_shift(spark, sf):
    return r6(D.null_shift(_train(spark, sf), shifted(_split(spark, sf, "test")), ["annual_inc", "dti", "emp_length", "purpose"]))


@register(
    "D12_inject_drift_rows",
    oracle(
        f"""SELECT loan_id,
  CASE WHEN CAST((loan_id * {2654435761 % 1000003} + 42) % 1000 AS DOUBLE) / 1000.0 < 0.3
    THEN annual_inc * (0.70 + 0.15 * (CAST((loan_id * 7919 + 42) % 1000 AS DOUBLE) / 1000.0)) ELSE annual_inc END AS annual_inc,
  CASE WHEN CAST((loan_id * {2654435761 % 1000003} + 42) % 1000 AS DOUBLE) / 1000.0 < 0.3
    THEN dti * (1.2 + 0.2 * (CAST((loan_id * 104729 + 42) % 1000 AS DOUBLE) / 1000.0)) ELSE dti END AS dti
FROM labelled WHERE split = 'test'""",
        "labelled",
    ),
)
def q_inject(spark, sf):
    df = _split(spark, sf, "test").select("loan_id", "annual_inc", "dti")
    return D.inject_drift(df, "loan_id", 0.3, 42)


@register(
    "D13_equal_frequency_counts",
    oracle(
        "SELECT CAST(len(list_filter(e.inner, lambda x: x < annual_inc)) AS INTEGER) AS bucket, count(*) AS n FROM ref, e "
        "WHERE annual_inc IS NOT NULL GROUP BY 1",
        "labelled",
        extra={"ref": _REF, "e": "SELECT list_sort(list_distinct(quantile_cont(annual_inc, "
               + "[" + ", ".join(repr(q) for q in LEVELS) + "]))) AS inner FROM ref"},
    ),
)
def q_qcut(spark, sf):
    return D.equal_frequency_counts(_train(spark, sf), "annual_inc", 10).withColumn("bucket", F.col("bucket").cast("int"))
