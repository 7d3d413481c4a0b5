"""PSI: behaviours of the original tests plus exact agreement with a brute-force NumPy reading."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import drift as D


def _psi_num_reference(ref, tgt, bins=10):
    ref = np.asarray(ref, dtype=float)
    tgt = np.asarray(tgt, dtype=float)
    q = [i * (1 / bins) for i in range(bins + 1)]
    edges = np.nanquantile(ref, q)
    edges[0], edges[-1] = -np.inf, np.inf
    edges = np.unique(edges)

    def shares(x):
        n = len(x)
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            out.append(np.sum((x > a) & (x <= b)) / n)
        out.append(np.sum(np.isnan(x)) / n)
        return np.clip(np.array(out), 1e-4, None)

    r, t = shares(ref), shares(tgt)
    return float(np.sum((t - r) * np.log(t / r)))


def _psi_cat_reference(ref, tgt):
    rv = [x for x in ref if x is not None]
    vocab = sorted(set(rv))
    def share(xs, n):
        return max(xs / n, 1e-4)
    total = 0.0
    nr, nt = len(ref), len(tgt)
    for v in vocab:
        total += (share(sum(1 for x in tgt if x == v), nt) - share(sum(1 for x in ref if x == v), nr)) * math.log(
            share(sum(1 for x in tgt if x == v), nt) / share(sum(1 for x in ref if x == v), nr))
    unseen = sum(1 for x in tgt if x is not None and x not in set(vocab))
    t, r = share(unseen, nt), 1e-4
    total += (t - r) * math.log(t / r)
    t, r = share(sum(1 for x in tgt if x is None), nt), share(sum(1 for x in ref if x is None), nr)
    total += (t - r) * math.log(t / r)
    return total


def _num(spark, ref, tgt, bins=10):
    a = spark.createDataFrame([(None if (x is None or (isinstance(x, float) and math.isnan(x))) else float(x),) for x in ref], "x double")
    b = spark.createDataFrame([(None if (x is None or (isinstance(x, float) and math.isnan(x))) else float(x),) for x in tgt], "x double")
    return D.psi_numeric(a, b, "x", bins).first()["psi"]


def _cat(spark, ref, tgt):
    a = spark.createDataFrame([(x,) for x in ref], "c string")
    b = spark.createDataFrame([(x,) for x in tgt], "c string")
    return D.psi_categorical(a, b, "c").first()["psi"]


def test_identical_is_zero(spark):
    x = list(np.random.default_rng(1).normal(size=100))
    assert abs(_num(spark, x, x)) < 1e-12
    assert abs(_cat(spark, ["a", "b", "c"], ["a", "b", "c"])) < 1e-12


def test_shift_detected_and_matches_reference(spark):
    rng = np.random.default_rng(2)
    ref, tgt = rng.normal(0, 1, 1000), rng.normal(5, 1, 1000)
    got = _num(spark, ref, tgt)
    assert got >= 0.1
    assert abs(got - _psi_num_reference(ref, tgt)) < 1e-9


def test_missing_shift(spark):
    ref = [None, None] + list(range(2, 100))
    tgt = [None] * 20 + list(range(20, 100))
    got = _num(spark, ref, tgt)
    ref_np = [np.nan if v is None else v for v in ref]
    tgt_np = [np.nan if v is None else v for v in tgt]
    assert got >= 0.1
    assert abs(got - _psi_num_reference(ref_np, tgt_np)) < 1e-9


def test_duplicate_edges(spark):
    ref = [0.0] * 90 + [1.0] * 10
    tgt = [0.0] * 80 + [1.0] * 20
    got = _num(spark, ref, tgt)
    assert isinstance(got, float)
    assert abs(got - _psi_num_reference(ref, tgt)) < 1e-9


def test_bins_matter(spark):
    rng = np.random.default_rng(3)
    ref, tgt = rng.normal(0, 1, 1000), rng.normal(5, 1, 1000)
    assert _num(spark, ref, tgt, 5) != _num(spark, ref, tgt, 10)
    assert abs(_num(spark, ref, tgt, 5) - _psi_num_reference(ref, tgt, 5)) < 1e-9


@pytest.mark.parametrize("ref,tgt", [
    (["A"] * 50 + ["B"] * 50, ["A"] * 40 + ["B"] * 40 + ["C"] * 20),             # unseen
    (["A"] * 40 + ["B"] * 40 + ["C"] * 20, ["A"] * 50 + ["B"] * 50),             # vanished
    ([None] * 2 + ["A"] * 48 + ["B"] * 50, [None] * 10 + ["A"] * 40 + ["B"] * 50),  # missing
    (["missing"] * 30 + ["A"] * 70, [None] * 30 + ["A"] * 70),                   # literal 'missing' is a value, not the NULL bucket
])
def test_categorical_cases(spark, ref, tgt):
    got = _cat(spark, ref, tgt)
    assert got >= 0.1
    assert abs(got - _psi_cat_reference(ref, tgt)) < 1e-9


def test_many_populations_one_job(spark):
    rng = np.random.default_rng(4)
    ref = spark.createDataFrame([(float(v), str(int(v * 3) % 4)) for v in rng.normal(size=500)], "x double, c string")
    rows = [(d, float(v + d * 0.3), str(int(v * 3 + d) % 5)) for d in range(4) for v in rng.normal(size=200)]
    tgt = spark.createDataFrame(rows, "day int, x double, c string")
    rep = {(r.day, r.feature): r.PSI for r in D.drift_report_by(ref, tgt, ["x"], ["c"], label="day").collect()}
    ref_x = [r.x for r in ref.collect()]
    ref_c = [r.c for r in ref.collect()]
    for d in range(4):
        tx = [r[1] for r in rows if r[0] == d]
        tc = [r[2] for r in rows if r[0] == d]
        assert abs(rep[(d, "x")] - _psi_num_reference(ref_x, tx)) < 1e-9
        assert abs(rep[(d, "c")] - _psi_cat_reference(ref_c, tc)) < 1e-9


def test_level_crosstab_zero_fill(spark):
    rep = spark.createDataFrame([("a", 0.05, "stable", "val"), ("b", 0.3, "significant", "val")],
                                "feature string, PSI double, drift_level string, target_label string")
    r = D.level_crosstab(rep).first()
    assert (r.stable, r.moderate, r.significant) == (1, 0, 1)
    assert F is not None


def test_feature_detail_of_an_unknown_feature_is_empty(spark):
    from riskframe.operators import drift as D

    df = spark.range(50).selectExpr("cast(id as double) as x", "concat('c', id % 3) as c")
    assert D.feature_detail(df, df, "nothing", ["x"], ["c"]).count() == 0
    assert D.feature_detail(df, df, "x", ["x"], ["c"]).count() == 10
    assert {r.category for r in D.feature_detail(df, df, "c", ["x"], ["c"]).collect()} == {"c0", "c1", "c2"}
