"""Bound join, set, ordering, fold and reason queries (J, U, W, O, L7-linear, L8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import specs
from riskframe.operators import drift as D
from riskframe.operators import ml as L
from riskframe.operators import relational as R
from riskframe.plans.common import r6
from riskframe.plans.drift import _SHIFTED_SQL, shifted
from riskframe.plans.registry import register
from riskframe.sources import bindings as B
from riskframe.sources.bindings import oracle

NUM = list(B.LOAN_ROLES.numeric)
TRAIN = "SELECT * FROM labelled WHERE split = 'train'"
LEVELS = [i * (1 / 10) for i in range(1, 10)]
SEGMENT_DOMAIN = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# Plain-language lookup for the bound features (feature -> label, text when it raises / lowers risk).
REASON_LOOKUP = [
    ("annual_inc", "Annual income", "Income pushed the estimated risk up.", "Income pushed the estimated risk down."),
    ("dti", "Debt-to-income ratio", "Debt relative to income raised the risk.", "Debt relative to income lowered the risk."),
    ("revol_util", "Revolving utilisation", "Use of revolving credit raised the risk.", "Use of revolving credit lowered the risk."),
    ("loan_amnt", "Loan amount", "The loan amount raised the risk.", "The loan amount lowered the risk."),
    ("fico_mid", "Credit score", "The credit score raised the risk.", "The credit score lowered the risk."),
]


def _train(spark, sf):
    return B.labelled(spark, sf).filter(F.col("split") == "train")


def _u(template, cols):
    return " UNION ALL ".join(template.format(c=c) for c in cols)


@register(
    "J1_align_scores",
    oracle("SELECT l.loan_id, l.split, l.target, s.p FROM labelled l JOIN scored s ON s.id = l.loan_id", "scored"),
)
def q_align(spark, sf):
    rows = B.labelled(spark, sf).select("loan_id", "split", "target")
    scores = B.scored(spark, sf).select(F.col("id").alias("loan_id"), "p")
    return R.align_scores(rows, scores, "loan_id")


@register("J1_duplicate_keys", oracle("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1"))
def q_dupkeys(spark, sf):
    return R.duplicate_keys(B.table(spark, sf, "lineitem"), "l_orderkey")


_EDGES = ("SELECT coalesce(list_sort(list_distinct(quantile_cont(annual_inc, [" + ", ".join(repr(q) for q in LEVELS)
          + "]))), []::DOUBLE[]) AS inner FROM (" + TRAIN + ") t")


@register(
    "J3_bin_index",
    oracle("SELECT l.loan_id, CASE WHEN annual_inc IS NULL THEN NULL ELSE len(list_filter(e.inner, lambda x: x < annual_inc)) END AS bin "
           "FROM loans l, e", "labelled", "loans", extra={"e": _EDGES}),
)
def q_bin(spark, sf):
    from riskframe.operators.binning import right_closed_bin

    edges = D.numeric_edges(_train(spark, sf), ["annual_inc"])["annual_inc"]
    inner = F.array(*[F.lit(e) for e in edges])
    return B.loans(spark, sf).select("loan_id", right_closed_bin(F.col("annual_inc"), inner, 9).cast("bigint").alias("bin"))


@register(
    "J5_align_counts",
    oracle("""SELECT coalesce(r.v, t.v) AS value, coalesce(r.n, 0) AS n_ref, coalesce(t.n, 0) AS n_live
FROM (SELECT purpose AS v, count(*) AS n FROM labelled WHERE split = 'train' GROUP BY 1) r
FULL OUTER JOIN (SELECT purpose AS v, count(*) AS n FROM sh GROUP BY 1) t ON r.v = t.v""", "labelled", extra={"sh": _SHIFTED_SQL}),
)
def q_align_counts(spark, sf):
    lab = B.labelled(spark, sf)
    return R.align_counts(lab.filter(F.col("split") == "train"), shifted(lab.filter(F.col("split") == "test")), "purpose")


@register(
    "J6_U3_unseen_values",
    oracle("SELECT purpose AS value, count(*) AS n FROM sh WHERE purpose IS NOT NULL AND purpose NOT IN "
           "(SELECT purpose FROM labelled WHERE split = 'train' AND purpose IS NOT NULL) GROUP BY 1", "labelled", extra={"sh": _SHIFTED_SQL}),
)
def q_unseen(spark, sf):
    lab = B.labelled(spark, sf)
    return R.unseen_values(lab.filter(F.col("split") == "train"), shifted(lab.filter(F.col("split") == "test")), "purpose")


_DOMAIN = ", ".join(f"'{v}'" for v in specs.EMP_LENGTH_LEVELS)


@register(
    "J7_in_domain",
    oracle(f"SELECT coalesce(emp_length IN ({_DOMAIN}), false) AS in_domain, count(*) AS n FROM loans GROUP BY 1", "loans"),
)
def q_domain(spark, sf):
    df = B.loans(spark, sf)
    return df.groupBy(F.coalesce(R.in_domain(df, "emp_length", specs.EMP_LENGTH_LEVELS), F.lit(False)).alias("in_domain")).agg(
        F.count(F.lit(1)).alias("n"))


@register(
    "J7_semi_join",
    oracle("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
)
def q_semi(spark, sf):
    orders = B.table(spark, sf, "orders").select("o_orderkey")
    returned = B.table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.semi_join(orders, returned, "o_orderkey")


# Scorecard (data-derived linear scorer) shared by W3, W4, L7-linear and L8.
_MED = _u("SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median FROM tr", NUM)
_CARD = _u("""SELECT '{c}' AS feature, m.median, avg(coalesce(CAST(t.{c} AS DOUBLE), m.median)) AS mean,
  CASE WHEN stddev_pop(coalesce(CAST(t.{c} AS DOUBLE), m.median)) = 0 THEN 1.0 ELSE stddev_pop(coalesce(CAST(t.{c} AS DOUBLE), m.median)) END AS std,
  coalesce(corr(coalesce(CAST(t.{c} AS DOUBLE), m.median), CAST(t.target AS DOUBLE)), 0) AS weight
FROM tr t, med m WHERE m.feature = '{c}' GROUP BY m.median""", NUM)
_CONTRIB = _u("""SELECT l.loan_id AS id, 'num__{c}' AS feature, c.weight * (coalesce(CAST(l.{c} AS DOUBLE), c.median) - c.mean) / c.std AS value
FROM te l, card c WHERE c.feature = '{c}'""", NUM)
_CARD_CTES = {"tr": TRAIN, "te": "SELECT * FROM labelled WHERE split = 'test'", "med": _MED, "card": _CARD, "contrib": _CONTRIB}


def _rows(spark, sf):
    lab = B.labelled(spark, sf)
    card = L.fit_scorecard(lab.filter(F.col("split") == "train"), NUM)
    return L.scorecard_rows(lab.filter(F.col("split") == "test"), card, "loan_id", NUM)


@register("L7_linear_contributions", oracle("SELECT id, feature, round(value, 6) AS value FROM contrib", "labelled", extra=_CARD_CTES))
def q_contrib(spark, sf):
    return r6(_rows(spark, sf).select("id", F.inline("contributions")))


@register(
    "L6_scorecard_scores",
    oracle("SELECT id, round(sum(value), 6) AS margin, round(1 / (1 + exp(-sum(value))), 6) AS p FROM contrib GROUP BY id", "labelled",
           extra=_CARD_CTES),
)
def q_scorecard(spark, sf):
    return r6(L.scorecard_scores(_rows(spark, sf)))


_TOP5 = ("SELECT id, feature, value, CAST(row_number() OVER (PARTITION BY id ORDER BY round(abs(value), 12) DESC, feature) AS INTEGER) AS rank "
         "FROM contrib QUALIFY rank <= 5")


@register("W3_top_reasons", oracle("SELECT id, feature, round(value, 6) AS value, rank FROM top5", "labelled", extra={**_CARD_CTES, "top5": _TOP5}))
def q_top5(spark, sf):
    return r6(R.top_reason_rows(_rows(spark, sf), 5).select("id", F.inline("reasons")).drop("ratio", "magnitude"))


_MAG = """SELECT id, feature, value, rank, abs(value) / CASE WHEN max(abs(value)) OVER (PARTITION BY id) = 0 THEN 1
  ELSE max(abs(value)) OVER (PARTITION BY id) END AS ratio FROM top5"""


@register(
    "W4_reason_magnitude",
    oracle(f"""SELECT id, feature, round(value, 6) AS value, rank, round(ratio, 6) AS ratio,
  CASE WHEN ratio > {specs.STRENGTH_STRONG_ABOVE} THEN 'strongly' WHEN ratio > {specs.STRENGTH_MODERATE_ABOVE} THEN 'moderately' ELSE 'slightly' END AS magnitude
FROM mag""", "labelled", extra={**_CARD_CTES, "top5": _TOP5, "mag": _MAG}),
)
def q_mag(spark, sf):
    return r6(R.top_reason_rows(_rows(spark, sf), 5).select("id", F.inline("reasons")))


def _lookup(spark):
    return spark.createDataFrame(REASON_LOOKUP, "feature string, label string, up string, down string")


_LOOKUP_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in REASON_LOOKUP) + ") v(feature, label, up, down)"


@register(
    "J9_L8_explain_reasons",
    oracle(f"""SELECT m.id, m.feature, round(m.value, 6) AS value,
  coalesce(k.label, array_to_string(list_transform(string_split(replace(regexp_replace(m.feature, '^(num|cat)__', ''), '_', ' '), ' '),
           lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')) AS label,
  CASE WHEN m.value > 0 THEN 'up' ELSE 'down' END AS direction,
  CASE WHEN m.ratio > {specs.STRENGTH_STRONG_ABOVE} THEN 'strongly' WHEN m.ratio > {specs.STRENGTH_MODERATE_ABOVE} THEN 'moderately' ELSE 'slightly' END AS magnitude,
  coalesce(CASE WHEN m.value > 0 THEN k.up ELSE k.down END,
           coalesce(k.label, array_to_string(list_transform(string_split(replace(regexp_replace(m.feature, '^(num|cat)__', ''), '_', ' '), ' '),
           lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' '))
           || CASE WHEN m.value > 0 THEN ' increased' ELSE ' decreased' END || ' the estimated risk.') AS sentence
FROM mag m LEFT JOIN lk k ON k.feature = regexp_replace(m.feature, '^(num|cat)__', '')""",
           "labelled", extra={**_CARD_CTES, "top5": _TOP5, "mag": _MAG, "lk": _LOOKUP_SQL}),
)
def q_explain(spark, sf):
    return r6(R.explain_rows(R.top_reason_rows(_rows(spark, sf), 5), _lookup(spark)))


_U1_COLS = ["term", "purpose", "addr_state", "emp_length"]


@register("U1_union_reports", oracle(" UNION ALL ".join(
    f"SELECT '{s}' AS target_label, '{c}' AS feature, count(*) AS n_rows, count({c}) AS n_values, count(DISTINCT {c}) AS n_levels "
    f"FROM labelled WHERE split = '{s}'" for s in ("val", "test") for c in [*NUM, *_U1_COLS]), "labelled"))
def q_union(spark, sf):
    # One report per split over every model column, the second with its columns in another order; stacked by name.
    lab = B.labelled(spark, sf)

    def report(split):
        part = lab.filter(F.col("split") == split)
        stats = [F.struct(F.lit(c).alias("feature"), F.count(F.lit(1)).alias("n_rows"), F.count(c).alias("n_values"),
                          F.count_distinct(c).alias("n_levels")) for c in [*NUM, *_U1_COLS]]
        return part.agg(F.array(*stats).alias("r")).select(F.lit(split).alias("target_label"), F.inline("r"))

    return R.union_reports(report("val"), report("test").select("n_levels", "n_values", "n_rows", "feature", "target_label"))


@register("U2_vocabulary", oracle("SELECT DISTINCT purpose AS value FROM labelled WHERE purpose IS NOT NULL", "labelled"))
def q_vocab(spark, sf):
    lab = B.labelled(spark, sf)
    return R.vocabulary([lab.filter(F.col("split") == s) for s in ("train", "val", "test")], "purpose")


@register(
    "U2_vocabulary_matches_declared",
    oracle("SELECT (SELECT count(*) FROM (SELECT DISTINCT purpose FROM labelled WHERE purpose IS NOT NULL "
           "EXCEPT ALL SELECT * FROM (VALUES " + ", ".join(f"('{v}')" for v in SEGMENT_DOMAIN) + ") d(v)) x) AS n_extra, "
           "(SELECT count(*) FROM (SELECT * FROM (VALUES " + ", ".join(f"('{v}')" for v in SEGMENT_DOMAIN) + ") d(v) "
           "EXCEPT ALL SELECT DISTINCT purpose FROM labelled WHERE purpose IS NOT NULL) y) AS n_missing", "labelled"),
)
def q_vocab_match(spark, sf):
    lab = B.labelled(spark, sf)
    v = R.vocabulary([lab.filter(F.col("split") == s) for s in ("train", "val", "test")], "purpose")
    return R.vocabulary_matches(v, SEGMENT_DOMAIN)


@register(
    "U4_V14_splits_disjoint",
    oracle("SELECT CAST(count(*) AS BIGINT) AS duplicate_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows FROM "
           "(SELECT count(*) AS n FROM labelled GROUP BY loan_id, issue_d, term, loan_amnt, annual_inc, dti, revol_util, mths_since_last_delinq, earliest_cr_line, fico_range_low, fico_range_high, purpose, addr_state, verification_status, emp_length, last_pymnt_d, target, credit_age_yrs, fico_mid HAVING count(*) > 1) g", "labelled"),
)
def q_disjoint(spark, sf):
    lab = B.labelled(spark, sf)
    parts = [lab.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")]
    return R.overlap(parts)


@register(
    "U5_id_overlap_excluded",
    oracle("SELECT CAST(count(*) AS BIGINT) AS n_shared FROM labelled WHERE loan_id IN (SELECT loan_id FROM windowed "
           "WHERE loan_status IN ('In Grace Period', 'Late (16-30 days)'))", "labelled"),
)
def q_id_overlap(spark, sf):
    from riskframe.operators import prep

    excluded = prep.observation_window(B.loans(spark, sf), "issue_d", B.WINDOW_MONTHS).filter(
        F.col("loan_status").isin(specs.LabelSpec().ambiguous))
    return R.id_overlap(B.labelled(spark, sf), excluded, "loan_id")


_FOLDS_SQL = """SELECT t.loan_id, CAST(t.pos AS BIGINT) AS position, CAST(f.i AS INTEGER) AS fold,
  CASE WHEN t.pos >= n - (5 - f.i) * sz AND t.pos < n - (5 - f.i) * sz + sz THEN 'test' ELSE 'train' END AS part
FROM (SELECT loan_id, row_number() OVER (ORDER BY issue_d, loan_id) - 1 AS pos FROM labelled WHERE split = 'train') t,
     (SELECT count(*) AS n, count(*) // 6 AS sz FROM labelled WHERE split = 'train') c, range(0, 5) f(i)
WHERE t.pos < n - (5 - f.i) * sz + sz"""


@register("W2_time_folds", oracle(_FOLDS_SQL, "labelled"))
def q_folds(spark, sf):
    f = R.time_folds(_train(spark, sf), "issue_d", "loan_id", 5)
    return f.select("loan_id", F.col("position").cast("bigint").alias("position"), F.col("fold").cast("int").alias("fold"), "part")


@register(
    "W5_fold_summary",
    oracle("""SELECT CAST(f.fold AS INTEGER) AS fold, f.part, min(l.issue_d) AS first_date, max(l.issue_d) AS last_date, count(*) AS n,
  CAST(sum(l.target) AS BIGINT) AS n_pos FROM folds f JOIN labelled l ON l.loan_id = f.loan_id GROUP BY f.fold, f.part""",
           "labelled", extra={"folds": _FOLDS_SQL}),
)
def q_fold_summary(spark, sf):
    f = R.time_folds(_train(spark, sf), "issue_d", "loan_id", 5)
    return R.fold_summary(f, "issue_d", "target").withColumn("fold", F.col("fold").cast("int"))


@register("O1_sort_by_date", oracle("SELECT loan_id, issue_d FROM labelled", "labelled"))
def q_sort(spark, sf):
    return R.sort_by_date(B.labelled(spark, sf).select("loan_id", "issue_d"), "issue_d", "loan_id")


@register(
    "O6_sample_n",
    oracle("SELECT loan_id, loan_amnt FROM loans ORDER BY (loan_id * 2654435761 + 42) % 1000003, loan_id LIMIT 100", "loans"),
)
def q_sample(spark, sf):
    return R.sample_n(B.loans(spark, sf).select("loan_id", "loan_amnt"), "loan_id", 100, 42)


@register("O8_segments_by_size", oracle("SELECT addr_state, count(*) AS n FROM labelled GROUP BY addr_state", "labelled"))
def q_seg_size(spark, sf):
    return R.segments_by_size(B.labelled(spark, sf), "addr_state")


@register(
    "O9_categories_by_share",
    oracle("""SELECT coalesce(r.category, l.category) AS category, round(coalesce(r.n, 0) / (SELECT count(term) FROM tr), 6) AS reference_pct,
  round(coalesce(l.n, 0) / (SELECT count(term) FROM logs), 6) AS live_pct, (r.n IS NULL AND l.n > 0) AS unseen
FROM (SELECT term AS category, count(*) AS n FROM tr WHERE term IS NOT NULL GROUP BY 1) r
FULL OUTER JOIN (SELECT term AS category, count(*) AS n FROM logs WHERE term IS NOT NULL GROUP BY 1) l ON r.category = l.category""",
           "labelled", "logs", extra={"tr": TRAIN}),
)
def q_cat_share(spark, sf):
    ov = D.categorical_overlay(_train(spark, sf), B.prediction_logs(spark, sf), "term")
    return r6(R.categories_by_share(ov))
