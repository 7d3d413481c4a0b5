"""Bound feature-pipeline queries (M1-M11): fit on train, transform all splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import specs
from riskframe.operators import features as M
from riskframe.plans.common import r6
from riskframe.plans.registry import register
from riskframe.sources import bindings as B
from riskframe.sources.bindings import oracle

NUM = list(B.LOAN_ROLES.numeric)
CAT = list(B.LOAN_ROLES.categorical)
TRAIN = "SELECT * FROM labelled WHERE split = 'train'"


def _train(spark, sf):
    return B.labelled(spark, sf).filter(F.col("split") == "train")


def _u(template, cols):
    return " UNION ALL ".join(template.format(c=c) for c in cols)


_MED = _u("SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median FROM tr", NUM)
_SCALER = _u("""SELECT '{c}' AS feature, m.median, avg(coalesce(CAST({c} AS DOUBLE), m.median)) AS mean,
  CASE WHEN stddev_pop(coalesce(CAST({c} AS DOUBLE), m.median)) = 0 THEN 1.0 ELSE stddev_pop(coalesce(CAST({c} AS DOUBLE), m.median)) END AS std
FROM tr, med m WHERE m.feature = '{c}' GROUP BY m.median""", NUM)


@register("M1_fit_median", oracle("SELECT feature, round(median, 6) AS median FROM med", "labelled", extra={"tr": TRAIN, "med": _MED}))
def q_median(spark, sf):
    return r6(M.fit_median(_train(spark, sf), NUM))


@register(
    "M2_fit_scaler",
    oracle("SELECT feature, round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std FROM sc", "labelled",
           extra={"tr": TRAIN, "med": _MED, "sc": _SCALER}),
)
def q_scaler(spark, sf):
    return r6(M.fit_scaler(_train(spark, sf), NUM))


@register("M3_fill_missing", oracle("SELECT loan_id, coalesce(emp_length, 'missing') AS emp_length FROM labelled", "labelled"))
def q_fill(spark, sf):
    return M.fill_missing(B.labelled(spark, sf).select("loan_id", "emp_length"), ["emp_length"])


_VOCAB = _u("SELECT DISTINCT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'missing') AS category FROM tr", CAT)


@register(
    "M4_fit_onehot",
    oracle("SELECT feature, category, CAST(row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS INTEGER) AS position FROM voc",
           "labelled", extra={"tr": TRAIN, "voc": _VOCAB}),
)
def q_onehot(spark, sf):
    return M.fit_onehot(_train(spark, sf), CAT).withColumn("position", F.col("position").cast("int"))


_LONG_SQL = (
    _u("""SELECT l.loan_id, 'num__{c}' AS name, round((coalesce(CAST(l.{c} AS DOUBLE), s.median) - s.mean) / s.std, 6) AS value
FROM labelled l, sc s WHERE s.feature = '{c}'""", NUM)
    + " UNION ALL "
    + _u("""SELECT l.loan_id, 'cat__{c}_' || coalesce(CAST(l.{c} AS VARCHAR), 'missing') AS name, 1.0 AS value FROM labelled l
WHERE coalesce(CAST(l.{c} AS VARCHAR), 'missing') IN (SELECT category FROM voc WHERE feature = '{c}')""", CAT)
)


@register("M5_transform_long", oracle(_LONG_SQL, "labelled", extra={"tr": TRAIN, "med": _MED, "sc": _SCALER, "voc": _VOCAB}))
def q_transform_long(spark, sf):
    df = B.labelled(spark, sf)
    stats = M.fit(_train(spark, sf), NUM, CAT)
    return r6(M.transform_long(df, stats, "loan_id", NUM, CAT))


_POSITIONS = " UNION ALL ".join(f"SELECT 'num__{c}' AS name, CAST({i} AS BIGINT) AS position" for i, c in enumerate(NUM)) + f"""
UNION ALL SELECT 'cat__' || feature || '_' || category, {len(NUM)} + row_number() OVER (ORDER BY feature, category) - 1 FROM voc"""


MATRIX_SQL = oracle(f"SELECT c.loan_id, p.position, c.value FROM ({_LONG_SQL}) c JOIN pos p USING (name) WHERE abs(c.value) >= 0.0000005", "labelled",
                    extra={"tr": TRAIN, "med": _MED, "sc": _SCALER, "voc": _VOCAB, "pos": _POSITIONS})


def matrix_cells(matrix):
    """(loan_id, position, value): the cells of a sparse matrix that are not 0 at the result's 6 places."""
    cells = r6(M.sparse_cells(matrix, ["loan_id"]))
    return cells.select("loan_id", F.col("position").cast("long").alias("position"), "value").filter(F.abs("value") >= 0.0000005)


@register("M5_transform_matrix", MATRIX_SQL)
def q_transform_matrix(spark, sf):
    """The sparse matrix of every split, as its cells."""
    stats = M.fit(_train(spark, sf), NUM, CAT)
    return matrix_cells(M.transform_sparse(B.labelled(spark, sf), stats, M.feature_index(stats, NUM), ["loan_id"], NUM, CAT))


@register(
    "M11_nan_count",
    oracle(_u("""SELECT 'num__{c}' AS column, CAST(count(*) FILTER (WHERE v IS NULL OR isnan(v)) AS BIGINT) AS n_bad
FROM (SELECT (coalesce(CAST(l.{c} AS DOUBLE), s.median) - s.mean) / s.std AS v FROM labelled l, sc s WHERE s.feature = '{c}') x""", NUM),
           "labelled", extra={"tr": TRAIN, "med": _MED, "sc": _SCALER}),
)
def q_nan_count(spark, sf):
    df = B.labelled(spark, sf)
    stats = M.fit(_train(spark, sf), NUM, [])
    wide = M.transform_wide(df, stats, [], NUM, [])
    return M.nan_count(wide)


_ORD = "CAST(CASE " + " ".join(f"WHEN emp_length = '{v}' THEN {i}" for i, v in enumerate(specs.EMP_LENGTH_LEVELS)) + " END AS DOUBLE)"


@register("M6_ordinal_encoding", oracle(f"SELECT loan_id, {_ORD} AS ord__emp_length FROM labelled", "labelled"))
def q_ordinal(spark, sf):
    return M.ordinal(B.labelled(spark, sf).select("loan_id", "emp_length"), "emp_length", specs.EMP_LENGTH_LEVELS).drop("emp_length")


_TE_FULL = """SELECT coalesce(addr_state, chr(0)) AS category,
  n * V / (n * V + vc) * mc + (1 - n * V / (n * V + vc)) * m AS encoding
FROM (SELECT addr_state, count(*) AS n, avg(CAST(target AS DOUBLE)) AS mc, var_pop(CAST(target AS DOUBLE)) AS vc FROM tr GROUP BY addr_state) c,
     (SELECT avg(CAST(target AS DOUBLE)) AS m, var_pop(CAST(target AS DOUBLE)) AS V FROM tr) g"""


@register("M7_target_encoding_fit", oracle("SELECT category, round(encoding, 6) AS encoding FROM te", "labelled", extra={"tr": TRAIN, "te": _TE_FULL}))
def q_te_fit(spark, sf):
    enc, _prior = M.target_encoding(_train(spark, sf), "addr_state", "target")
    return r6(enc)


def _folds():
    return (F.col("loan_id") * F.lit(7919)) % F.lit(5)


_OOF = """SELECT b.loan_id, round(coalesce(c.n * g.V / (c.n * g.V + c.vc) * c.mc + (1 - c.n * g.V / (c.n * g.V + c.vc)) * g.m, g.m), 6) AS te__addr_state
FROM b JOIN (SELECT f.fold, avg(b.y) AS m, var_pop(b.y) AS V FROM (SELECT DISTINCT fold FROM b) f JOIN b ON b.fold <> f.fold GROUP BY f.fold) g
  ON b.fold = g.fold
LEFT JOIN (SELECT f.fold, b.cat, count(*) AS n, avg(b.y) AS mc, var_pop(b.y) AS vc
           FROM (SELECT DISTINCT fold FROM b) f JOIN b ON b.fold <> f.fold GROUP BY f.fold, b.cat) c ON c.fold = b.fold AND c.cat = b.cat"""


@register(
    "M7_target_encoding_oof",
    oracle(_OOF, "labelled", extra={"b": "SELECT loan_id, coalesce(addr_state, chr(0)) AS cat, CAST(target AS DOUBLE) AS y, "
                                         "(loan_id * 7919) % 5 AS fold FROM labelled WHERE split = 'train'"}),
)
def q_te_oof(spark, sf):
    return r6(M.target_encode_oof(_train(spark, sf), "addr_state", "loan_id", "target", 5, fold_col=_folds()))


@register(
    "M7_target_encoding_apply",
    oracle("""SELECT l.loan_id, round(coalesce(te.encoding, (SELECT avg(CAST(target AS DOUBLE)) FROM tr)), 6) AS te__addr_state
FROM labelled l LEFT JOIN te ON te.category = coalesce(l.addr_state, chr(0)) WHERE l.split IN ('val', 'test')""",
           "labelled", extra={"tr": TRAIN, "te": _TE_FULL}),
)
def q_te_apply(spark, sf):
    enc, prior = M.target_encoding(_train(spark, sf), "addr_state", "target")
    rows = B.labelled(spark, sf).filter(F.col("split").isin("val", "test")).select("loan_id", "addr_state")
    return r6(M.apply_target_encoding(rows, enc, "addr_state", prior).drop("addr_state"))


@register(
    "M8_missing_flags",
    oracle("SELECT loan_id, CAST(annual_inc IS NULL AS INTEGER) AS missing__annual_inc, CAST(dti IS NULL AS INTEGER) AS missing__dti, "
           "CAST(emp_length IS NULL AS INTEGER) AS missing__emp_length FROM labelled", "labelled"),
)
def q_flags(spark, sf):
    df = B.labelled(spark, sf).select("loan_id", "annual_inc", "dti", "emp_length")
    return M.missing_flags(df, ["annual_inc", "dti", "emp_length", "dti"]).drop("annual_inc", "dti", "emp_length")


_B_CTE = ("SELECT loan_id, coalesce(addr_state, chr(0)) AS cat, CAST(target AS DOUBLE) AS y, "
          "(loan_id * 7919) % 5 AS fold FROM labelled WHERE split = 'train'")
_M9_SQL = f"""{_LONG_SQL}
UNION ALL SELECT loan_id, 'missing__annual_inc', CAST(annual_inc IS NULL AS INTEGER)::DOUBLE FROM labelled
UNION ALL SELECT loan_id, 'missing__dti', CAST(dti IS NULL AS INTEGER)::DOUBLE FROM labelled
UNION ALL SELECT loan_id, 'te__addr_state', te__addr_state FROM oof
UNION ALL SELECT l.loan_id, 'te__addr_state', round(coalesce(te.encoding, (SELECT avg(CAST(target AS DOUBLE)) FROM tr)), 6)
  FROM labelled l LEFT JOIN te ON te.category = coalesce(l.addr_state, chr(0)) WHERE l.split IN ('val', 'test')"""


@register("M9_combined_preprocessor", oracle(_M9_SQL, "labelled", extra={
    "tr": TRAIN, "med": _MED, "sc": _SCALER, "voc": _VOCAB, "te": _TE_FULL, "b": _B_CTE, "oof": _OOF}))
def q_combined(spark, sf):
    """Numeric + categorical + missing indicators + out-of-fold target encoding, long form."""
    lab = B.labelled(spark, sf)
    tr = lab.filter(F.col("split") == "train")
    base = M.transform_long(lab, M.fit(tr, NUM, CAT), "loan_id", NUM, CAT)
    flags = M.missing_flags(lab.select("loan_id", "annual_inc", "dti"), ["annual_inc", "dti"]).select(
        "loan_id", F.inline(F.array(*[F.struct(F.lit(f"missing__{c}").alias("name"), F.col(f"missing__{c}").cast("double").alias("value")) for c in ("annual_inc", "dti")])))
    enc, prior = M.target_encoding(tr, "addr_state", "target")
    te_tr = M.target_encode_oof(tr, "addr_state", "loan_id", "target", 5, fold_col=_folds())
    te_other = M.apply_target_encoding(lab.filter(F.col("split") != "train").select("loan_id", "addr_state"), enc, "addr_state", prior)
    te = te_tr.unionByName(te_other.drop("addr_state")).select("loan_id", F.lit("te__addr_state").alias("name"), F.col("te__addr_state").alias("value"))
    return r6(base.unionByName(flags).unionByName(te))


@register(
    "M10_saved_state",
    oracle("SELECT 'num' AS kind, feature, round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std, CAST(NULL AS VARCHAR) AS category FROM sc "
           "UNION ALL SELECT 'cat', feature, NULL, NULL, NULL, category FROM voc",
           "labelled", extra={"tr": TRAIN, "med": _MED, "sc": _SCALER, "voc": _VOCAB}),
)
def q_saved_state(spark, sf):
    # The fitted state written to the shared folder and read back, as a later scoring job does.
    from riskframe.streaming.jobs import scratch

    path = scratch(spark, "fitted-state")
    M.save_stats(M.fit(_train(spark, sf), NUM, CAT), path)
    return r6(M.load_stats(spark, path))


@register(
    "M10_check_columns",
    oracle("SELECT c AS column, present, CASE WHEN present THEN (SELECT count(*) FROM labelled) ELSE 0 END AS n_rows "
           "FROM (VALUES ('loan_id', true), ('num__annual_inc', true), ('num__dti', true), ('num__not_fitted', false)) v(c, present)", "labelled"),
)
def q_check_columns(spark, sf):
    lab = B.labelled(spark, sf)
    matrix = M.transform_wide(lab, M.fit(_train(spark, sf), ["annual_inc", "dti"], []), ["loan_id"], ["annual_inc", "dti"], [])
    found = M.check_columns(matrix, ["loan_id", "num__annual_inc", "num__dti", "num__not_fitted"])
    n = matrix.agg(F.count(F.lit(1))).scalar()
    return found.withColumn("n_rows", F.when(F.col("present"), n).otherwise(0).cast("bigint"))
