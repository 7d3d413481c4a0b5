"""Bound evaluation queries (E1-E25) on the ``scored`` view.

The DuckDB oracles use independent brute-force forms where possible: plain
ordered windows over the whole table, and a cross product with the 99-point
grid for the cost curve.
"""

from __future__ import annotations

from pyspark.sql import functions as F


from riskframe.operators import metrics as M
from riskframe.operators import prep
from riskframe.plans.common import r6
from riskframe.plans.registry import register
from riskframe.sources import bindings as B
from riskframe.sources.bindings import oracle
from riskframe.specs import CostSpec

SEGMENTS = ["term", "purpose", "income_bracket", "addr_state"]
T_FIXED = 0.16
RATIOS = [3.0, 4.5, 6.0, 10.0]

_GRID = (
    "SELECT i, 0.01::DOUBLE + CAST(i AS DOUBLE) * (0.98::DOUBLE / 98) AS t FROM range(0, 99) r(i)"
)


def rank_sql(src: str, keys: list[str], y: str = "y", p: str = "p", skip_one_class: bool = False) -> str:
    kc = ", ".join(keys)
    kp = kc + ", " if keys else ""
    part = f"PARTITION BY {kc}" if keys else ""
    having = " HAVING max(tot_pos) > 0 AND max(tot_neg) > 0" if skip_one_class else ""
    return f"""SELECT {kp}round(sum(CAST(pos AS DOUBLE) * (CAST(tot_neg AS DOUBLE) - CAST(cn AS DOUBLE) + CAST(neg AS DOUBLE) * 0.5::DOUBLE))
        / (CAST(max(tot_pos) AS DOUBLE) * CAST(max(tot_neg) AS DOUBLE)), 6) AS roc_auc,
  round(sum(CAST(pos AS DOUBLE) / CAST(tot_pos AS DOUBLE) * CAST(cp AS DOUBLE) / CAST(cp + cn AS DOUBLE)), 6) AS pr_auc,
  CAST(max(tot_pos) AS BIGINT) AS n_pos, CAST(max(tot_neg) AS BIGINT) AS n_neg
FROM (SELECT *, sum(pos) OVER (w ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
               sum(neg) OVER (w ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
               sum(pos) OVER w AS tot_pos, sum(neg) OVER w AS tot_neg
      FROM (SELECT {kp}CAST({p} AS DOUBLE) AS p, sum({y}) AS pos, count(*) - sum({y}) AS neg FROM {src}
            WHERE {p} IS NOT NULL GROUP BY {kp}CAST({p} AS DOUBLE)) h
      WINDOW w AS ({part})) c
GROUP BY {kc if keys else "()"}{having}"""


def thr_sql(src: str, keys: list[str], t: str, y: str = "y", p: str = "p") -> str:
    kc = ", ".join(keys)
    kp = kc + ", " if keys else ""
    return f"""SELECT {kp}brier, tn, fp, fn, tp,
  round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS recall
FROM (SELECT {kp}round(avg(power(CAST({p} AS DOUBLE) - {y}, 2)), 6) AS brier,
        CAST(count(*) FILTER (WHERE NOT ({p} >= {t}) AND {y} = 0) AS BIGINT) AS tn,
        CAST(count(*) FILTER (WHERE {p} >= {t} AND {y} = 0) AS BIGINT) AS fp,
        CAST(count(*) FILTER (WHERE NOT ({p} >= {t}) AND {y} = 1) AS BIGINT) AS fn,
        CAST(count(*) FILTER (WHERE {p} >= {t} AND {y} = 1) AS BIGINT) AS tp
      FROM {src} GROUP BY {kc if keys else "()"}) a"""


def curve_sql(src: str) -> str:
    """Brute-force cost curve: every grid point against every row."""
    return f"""SELECT g.i, g.t,
  count(*) FILTER (WHERE s.y = 0 AND s.p >= g.t) AS fp,
  count(*) FILTER (WHERE s.y = 1 AND NOT (s.p >= g.t)) AS fn,
  count(*) FILTER (WHERE s.y = 1 AND s.p >= g.t) AS tp,
  count(*) FILTER (WHERE s.y = 0 AND NOT (s.p >= g.t)) AS tn
FROM g, {src} s GROUP BY g.i, g.t"""


def _scored(spark, sf):
    return B.scored(spark, sf)


# ---------------------------------------------------------------- E1/E2


@register("E1_E2_ranking_by_split", oracle(rank_sql("scored", ["split"]), "scored"))
def q_rank_split(spark, sf):
    return r6(M.ranking_metrics(_scored(spark, sf), "y", "p", ["split"]))


@register("E1_E2_ranking_overall", oracle(rank_sql("scored", []), "scored"))
def q_rank_all(spark, sf):
    return r6(M.ranking_metrics(_scored(spark, sf), "y", "p"))


@register("E3_E4_E5_threshold_metrics", oracle(thr_sql("scored", ["split"], str(T_FIXED)), "scored"))
def q_thr(spark, sf):
    return r6(M.threshold_metrics(_scored(spark, sf), "y", "p", T_FIXED, ["split"]))


@register(
    "E5_confusion_matrix",
    oracle(
        f"SELECT [[tn, fp], [fn, tp]] AS confusion_matrix FROM ({thr_sql('scored', [], str(T_FIXED))}) x",
        "scored",
    ),
)
def q_confusion(spark, sf):
    return M.confusion_matrix(_scored(spark, sf), "y", "p", T_FIXED)


_TUNE_SQL = oracle(
    f"""SELECT round(t, 6) AS threshold, cost, round({CostSpec().theoretical_threshold!r}, 6) AS theoretical_threshold
FROM (SELECT t, CAST(fp AS DOUBLE) * 2000 + CAST(fn AS DOUBLE) * 10000 AS cost, i FROM c) z
ORDER BY cost, i LIMIT 1""",
    "scored",
    extra={"g": _GRID, "v": "SELECT * FROM scored WHERE split = 'val'", "c": curve_sql("v")},
)


@register("E6_tune_threshold", _TUNE_SQL)
def q_tune(spark, sf):
    costs = CostSpec()
    val = _scored(spark, sf).filter(F.col("split") == "val")
    return r6(M.tune_threshold(val, "y", "p", costs).withColumn("theoretical_threshold", M.theoretical_threshold(costs)))


@register(
    "E6_tune_threshold_by_split",
    oracle(
        """SELECT split, round(arg_min(t, cost * 1000 + i), 6) AS threshold, min(cost) AS cost
FROM (SELECT c.*, CAST(fp AS DOUBLE) * 2000 + CAST(fn AS DOUBLE) * 10000 AS cost FROM c) z GROUP BY split""",
        "scored",
        extra={
            "g": _GRID,
            "c": """SELECT s.split, g.i, g.t,
  count(*) FILTER (WHERE s.y = 0 AND s.p >= g.t) AS fp,
  count(*) FILTER (WHERE s.y = 1 AND NOT (s.p >= g.t)) AS fn
FROM g, scored s GROUP BY s.split, g.i, g.t""",
        },
    ),
)
def q_tune_split(spark, sf):
    return r6(M.tune_threshold(_scored(spark, sf), "y", "p", CostSpec(), ["split"]))


_EVAL_T = "(SELECT t FROM (SELECT t, CAST(fp AS DOUBLE) * 2000 + CAST(fn AS DOUBLE) * 10000 AS cost, i FROM c) z ORDER BY cost, i LIMIT 1)"


@register(
    "E7_evaluate_model",
    oracle(
        f"""SELECT r.split, r.roc_auc, r.pr_auc, r.n_pos, r.n_neg, m.brier, m.tn, m.fp, m.fn, m.tp, m.precision, m.recall,
  round({_EVAL_T}, 6) AS threshold
FROM ({rank_sql('scored', ['split'])}) r JOIN ({thr_sql('scored', ['split'], _EVAL_T)}) m ON r.split = m.split""",
        "scored",
        extra={"g": _GRID, "v": "SELECT * FROM scored WHERE split = 'val'", "c": curve_sql("v")},
    ),
)
def q_evaluate(spark, sf):
    return r6(M.evaluate(_scored(spark, sf), "y", "p", "split", CostSpec(), "val"))


@register(
    "E8_calibration_curve",
    oracle(
        """SELECT split, CAST(bin AS BIGINT) AS bin, round(avg(p), 6) AS prob_pred, round(avg(y), 6) AS prob_true, count(*) AS n
FROM (SELECT split, p, y, (SELECT count(*) FROM range(1, 10) r(i) WHERE CAST(i AS DOUBLE) * (1.0::DOUBLE / 10) < s.p) AS bin
      FROM scored s) b GROUP BY split, bin""",
        "scored",
    ),
)
def q_calibration(spark, sf):
    return r6(M.calibration(_scored(spark, sf), "y", "p", 10, ["split"]).withColumn("bin", F.col("bin").cast("bigint")))


@register(
    "E9_reliability_histogram",
    oracle(
        """WITH_BINS SELECT CAST(b.i AS BIGINT) AS bin, round(CAST(b.i AS DOUBLE) * (1.0::DOUBLE / 20), 6) AS range_start,
  round(CASE WHEN b.i = 19 THEN 1.0 ELSE CAST(b.i + 1 AS DOUBLE) * (1.0::DOUBLE / 20) END, 6) AS range_end,
  CAST(count(h.bin) AS BIGINT) AS n
FROM range(0, 20) b(i) LEFT JOIN (SELECT (SELECT count(*) FROM range(1, 20) r(i) WHERE CAST(i AS DOUBLE) * (1.0::DOUBLE / 20) <= s.p) AS bin
  FROM scored s WHERE s.p >= 0 AND s.p <= 1) h ON h.bin = b.i GROUP BY b.i""".replace("WITH_BINS ", ""),
        "scored",
    ),
)
def q_reliability(spark, sf):
    from riskframe.operators.profile import score_hist

    hist, _summary = score_hist(_scored(spark, sf), 20, "p")
    return r6(hist.withColumn("bin", F.col("bin").cast("bigint")))


@register(
    "E10_recall_at_precision",
    oracle(
        """SELECT split, round(coalesce(max(CASE WHEN CAST(cp AS DOUBLE) / (cp + cn) >= 0.8 THEN CAST(cp AS DOUBLE) / tot_pos END), 0), 6) AS max_recall
FROM (SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
               sum(neg) OVER (PARTITION BY split ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
               sum(pos) OVER (PARTITION BY split) AS tot_pos
      FROM (SELECT split, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY split, p) h) c GROUP BY split""",
        "scored",
    ),
)
def q_recall_at_precision(spark, sf):
    return r6(M.recall_at_precision(_scored(spark, sf), "y", "p", 0.8, ["split"]))


@register(
    "E11_accuracy_f1",
    oracle(
        """SELECT split, round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 6) AS accuracy,
  round(CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0 END, 6) AS f1
FROM (SELECT split, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
             count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn
      FROM scored GROUP BY split) a""",
        "scored",
    ),
)
def q_acc_f1(spark, sf):
    return r6(M.accuracy_f1(_scored(spark, sf), "y", "p", 0.5, ["split"]))


@register(
    "E12_above_cut",
    oracle("SELECT split, count(*) AS n, round(avg(y), 6) AS observed_rate FROM scored WHERE p > 0.8 GROUP BY split", "scored"),
)
def q_above(spark, sf):
    return r6(M.above(_scored(spark, sf), "y", "p", 0.8, ["split"]))


@register(
    "E13_brier_reference",
    oracle("SELECT split, round(avg(y) * (1 - avg(y)), 6) AS brier_reference, round(avg(y), 6) AS base_rate FROM scored GROUP BY split",
           "scored"),
)
def q_brier_ref(spark, sf):
    return r6(M.brier_reference(_scored(spark, sf), "y", ["split"]))


_RATIO_VALUES = ", ".join(f"({r!r}::DOUBLE)" for r in RATIOS)


@register(
    "E14_cost_sweep",
    oracle(
        f"""SELECT ratio, round(arg_min(t, cost * 1000 + i), 6) AS threshold,
  round(arg_min(CAST(tp + fp AS DOUBLE) / (tp + fp + fn + tn), cost * 1000 + i), 6) AS rejection_rate,
  round(arg_min(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END, cost * 1000 + i), 6) AS recall,
  CAST(arg_min(fn, cost * 1000 + i) AS BIGINT) AS fn, CAST(arg_min(fp, cost * 1000 + i) AS BIGINT) AS fp, round(min(cost), 6) AS cost
FROM (SELECT c.*, r.ratio, CAST(fp AS DOUBLE) * 1000 + CAST(fn AS DOUBLE) * r.ratio * 1000 AS cost
      FROM c, (VALUES {_RATIO_VALUES}) r(ratio)) z GROUP BY ratio""",
        "scored",
        extra={"g": _GRID, "v": "SELECT * FROM scored WHERE split = 'val'", "c": curve_sql("v")},
    ),
)
def q_cost_sweep(spark, sf):
    val = _scored(spark, sf).filter(F.col("split") == "val")
    return r6(M.cost_sweep(val, "y", "p", RATIOS, fp_cost=1000.0))


@register(
    "E15_threshold_penalty",
    oracle(
        f"""SELECT o.ratio, round(o.cost_opt, 6) AS cost_opt, round(a.cost_assumed, 6) AS cost_assumed,
  round((a.cost_assumed - o.cost_opt) / o.cost_opt * 100, 6) AS penalty_pct
FROM (SELECT r.ratio, min(CAST(fp AS DOUBLE) * 2000 + CAST(fn AS DOUBLE) * r.ratio * 2000) AS cost_opt
      FROM c, (VALUES {_RATIO_VALUES}) r(ratio) GROUP BY r.ratio) o
JOIN (SELECT r.ratio, CAST(count(*) FILTER (WHERE p >= {T_FIXED} AND y = 0) AS DOUBLE) * 2000
             + CAST(count(*) FILTER (WHERE p < {T_FIXED} AND y = 1) AS DOUBLE) * r.ratio * 2000 AS cost_assumed
      FROM v, (VALUES {_RATIO_VALUES}) r(ratio) GROUP BY r.ratio) a ON o.ratio = a.ratio""",
        "scored",
        extra={"g": _GRID, "v": "SELECT * FROM scored WHERE split = 'val'", "c": curve_sql("v")},
    ),
)
def q_penalty(spark, sf):
    val = _scored(spark, sf).filter(F.col("split") == "val")
    return r6(M.threshold_penalty(val, "y", "p", T_FIXED, RATIOS, fp_cost=2000.0))


def _seg_long_sql(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS segment, y, p FROM {src} WHERE {c} IS NOT NULL" for c in SEGMENTS
    )


_SEG_CTES = {"t": "SELECT * FROM scored WHERE split = 'test'", "sl": _seg_long_sql("t")}


@register(
    "E17_segment_metrics",
    oracle(
        f"""SELECT r.feature, r.segment, e.n, r.n_pos, e.base_rate, r.roc_auc, r.pr_auc, e.mean_p, m.brier, m.precision, m.recall
FROM ({rank_sql('sl', ['feature', 'segment'], skip_one_class=True)}) r
JOIN ({thr_sql('sl', ['feature', 'segment'], str(T_FIXED))}) m ON r.feature = m.feature AND r.segment = m.segment
JOIN (SELECT feature, segment, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS base_rate FROM sl GROUP BY feature, segment) e
  ON r.feature = e.feature AND r.segment = e.segment""",
        "scored",
        extra=_SEG_CTES,
    ),
)
def q_segments(spark, sf):
    test = _scored(spark, sf).filter(F.col("split") == "test")
    return r6(M.segment_metrics(test, "y", "p", T_FIXED, SEGMENTS))


_FAIR_SQL = f"""SELECT feature, segment, n, CAST(n_pos AS BIGINT) AS n_positives, round(CAST(n_pos AS DOUBLE) / n, 6) AS base_rate,
  round(CAST(n_pred0 AS DOUBLE) / n, 6) AS selection_rate, round(CAST(tp AS DOUBLE) / n_pos, 6) AS tpr,
  round(CAST(fp AS DOUBLE) / (n - n_pos), 6) AS fpr, round(CASE WHEN npp > 0 THEN CAST(tp AS DOUBLE) / npp END, 6) AS precision
FROM (SELECT feature, segment, count(*) AS n, sum(y) AS n_pos, count(*) FILTER (WHERE p < {T_FIXED}) AS n_pred0,
             count(*) FILTER (WHERE p >= {T_FIXED} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {T_FIXED} AND y = 0) AS fp,
             count(*) FILTER (WHERE p >= {T_FIXED}) AS npp
      FROM sl GROUP BY feature, segment) a WHERE n_pos > 0 AND n_pos < n"""


@register("E18_fairness_audit", oracle(_FAIR_SQL, "scored", extra=_SEG_CTES))
def q_fairness(spark, sf):
    test = _scored(spark, sf).filter(F.col("split") == "test")
    return r6(M.fairness(test, "y", "p", T_FIXED, SEGMENTS))


_FAIR_NOROUND = _FAIR_SQL.replace("round(", "(").replace(", 6)", ")")


@register(
    "E19_disparate_impact",
    oracle(
        """SELECT feature, metric, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value,
  round(min(value) / max(value), 6) AS ratio, coalesce(min(value) / max(value) < 0.8, false) AS flagged
FROM (SELECT feature, 'selection_rate' AS metric, selection_rate AS value FROM fa
      UNION ALL SELECT feature, 'tpr', tpr FROM fa UNION ALL SELECT feature, 'fpr', fpr FROM fa
      UNION ALL SELECT feature, 'precision', precision FROM fa) u GROUP BY feature, metric""",
        "scored",
        extra={**_SEG_CTES, "fa": _FAIR_NOROUND},
    ),
)
def q_disparate(spark, sf):
    test = _scored(spark, sf).filter(F.col("split") == "test")
    return r6(M.disparate_impact(M.fairness(test, "y", "p", T_FIXED, SEGMENTS)))


@register(
    "E20_calibration_gap",
    oracle(
        """SELECT feature, segment, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS base_rate, round(avg(p) - avg(y), 6) AS gap,
  round(CASE WHEN avg(y) <> 0 THEN (avg(p) - avg(y)) / avg(y) END, 6) AS relative_gap
FROM sl GROUP BY feature, segment HAVING sum(y) > 0 AND sum(y) < count(*)""",
        "scored",
        extra=_SEG_CTES,
    ),
)
def q_cal_gap(spark, sf):
    test = _scored(spark, sf).filter(F.col("split") == "test")
    return r6(M.calibration_gap(M.segment_metrics(test, "y", "p", T_FIXED, SEGMENTS)))


@register("E21_score_correlation", oracle("SELECT 'p' AS a, 'p2' AS b, round(corr(p, p2), 6) AS corr FROM scored", "scored"))
def q_score_corr(spark, sf):
    return r6(M.score_corr(_scored(spark, sf), ["p", "p2"]))


@register(
    "E25_label_bias_by_month",
    oracle(
        """SELECT coalesce(a.month, b.month) AS month, round(a.naive_rate, 6) AS naive_rate, round(b.window_rate, 6) AS window_rate
FROM (SELECT CAST(date_trunc('month', issue_d) AS DATE) AS month, avg(CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END) AS naive_rate
      FROM windowed WHERE loan_status IN ('Fully Paid', 'Charged Off') GROUP BY 1) a
FULL OUTER JOIN (SELECT CAST(date_trunc('month', issue_d) AS DATE) AS month, avg(target) AS window_rate FROM labelled GROUP BY 1) b
  ON a.month = b.month""",
        "labelled",
    ),
)
def q_label_bias(spark, sf):
    loans = prep.observation_window(B.loans(spark, sf), "issue_d", B.WINDOW_MONTHS)
    naive = prep.label_resolved_only(loans)
    out = M.label_bias(naive, B.labelled(spark, sf))
    return r6(out.select(F.coalesce(F.col("month"), F.lit(None)).alias("month"), "naive_rate", "window_rate"))



