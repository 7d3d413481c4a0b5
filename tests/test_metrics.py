"""Exact ranking and threshold metrics against brute-force NumPy, plus metamorphic checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import metrics as M
from riskframe.operators.windowing import running_sums
from riskframe.specs import CostSpec


def _auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def _ap(y, p):
    ap, P = 0.0, y.sum()
    for s in np.unique(p)[::-1]:
        sel = p >= s
        tp = (y[sel] == 1).sum()
        fp = (y[sel] == 0).sum()
        ap += ((y[p == s] == 1).sum() / P) * tp / (tp + fp)
    return ap


def _data(seed=0, n=800):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    p = np.round(np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1), 2)  # many ties
    return y, p


def _df(spark, y, p, groups=None):
    rows = [(int(i), int(a), float(b), (groups[i] if groups is not None else "g")) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "id long, y int, p double, g string")


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_auc_ap_exact(spark, buckets):
    y, p = _data()
    r = M.ranking_metrics(_df(spark, y, p), "y", "p", buckets=buckets).first()
    assert abs(r.roc_auc - _auc(y, p)) < 1e-12
    assert abs(r.pr_auc - _ap(y, p)) < 1e-12


def test_grouped_with_hot_group(spark):
    y, p = _data(1, 1200)
    groups = np.where(np.arange(1200) < 400, "hot", np.where(np.arange(1200) % 2 == 0, "a", "b"))
    out = {r.g: r for r in M.ranking_metrics(_df(spark, y, p, groups), "y", "p", ["g"], buckets=16).collect()}
    for g in ("hot", "a", "b"):
        m = groups == g
        assert abs(out[g].roc_auc - _auc(y[m], p[m])) < 1e-12
        assert abs(out[g].pr_auc - _ap(y[m], p[m])) < 1e-12


def test_auc_invariant_under_monotone_map(spark):
    y, p = _data(2)
    df = _df(spark, y, p)
    a = M.ranking_metrics(df, "y", "p").first()
    b = M.ranking_metrics(df.withColumn("p", F.pow(F.col("p"), 3) * 10 - 4), "y", "p").first()
    assert abs(a.roc_auc - b.roc_auc) < 1e-12 and abs(a.pr_auc - b.pr_auc) < 1e-12


def test_running_sums_match_cumsum(spark):
    rng = np.random.default_rng(5)
    v = rng.permutation(500).astype(float)
    w = rng.integers(0, 5, 500)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, w)], "v double, w long")
    got = {r.v: r.cum_w for r in running_sums(df, "v", ["w"], buckets=8).collect()}
    order = np.argsort(v)
    cs = np.cumsum(w[order])
    for i, idx in enumerate(order):
        assert got[v[idx]] == cs[i]


def test_tune_threshold_matches_loop(spark):
    y, p = _data(3)
    grid = np.linspace(0.01, 0.99, 99)
    costs = [((y == 0) & (p >= t)).sum() * 2000 + ((y == 1) & (p < t)).sum() * 10000 for t in grid]
    r = M.tune_threshold(_df(spark, y, p), "y", "p", CostSpec()).first()
    assert r.threshold == grid[int(np.argmin(costs))]
    assert r.cost == min(costs)


def test_cost_never_above_any_grid_point(spark):
    y, p = _data(4)
    curve = M.cost_curve(_df(spark, y, p), "y", "p").collect()
    best = M.tune_threshold(_df(spark, y, p), "y", "p", CostSpec()).first().cost
    assert all(best <= r.fp * 2000 + r.fn * 10000 for r in curve)


def test_threshold_metrics_and_calibration(spark):
    y, p = _data(5)
    r = M.threshold_metrics(_df(spark, y, p), "y", "p", 0.5).first()
    pred = p >= 0.5
    assert (r.tp, r.fp, r.fn, r.tn) == (int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum()),
                                        int((~pred & (y == 1)).sum()), int((~pred & (y == 0)).sum()))
    assert abs(r.brier - np.mean((p - y) ** 2)) < 1e-12
    cal = {c.bin: c for c in M.calibration(_df(spark, y, p), "y", "p", 10).collect()}
    bins = np.linspace(0, 1, 11)
    ids = np.searchsorted(bins[1:-1], p)
    for b in np.unique(ids):
        assert abs(cal[b].prob_true - y[ids == b].mean()) < 1e-12


def test_recall_at_precision_reachable_and_not(spark):
    y = np.array([1, 1, 0, 0])
    p = np.array([0.9, 0.8, 0.7, 0.1])
    assert M.recall_at_precision(_df(spark, y, p), "y", "p", 0.8).first().max_recall == 1.0
    y2 = np.array([0, 1])
    p2 = np.array([0.9, 0.1])
    assert M.recall_at_precision(_df(spark, y2, p2), "y", "p", 0.8).first().max_recall == 0.0


def test_fairness_skips_one_class_segments(spark):
    df = spark.createDataFrame([(1, 0.9, "a"), (0, 0.1, "a"), (1, 0.8, "b"), (1, 0.7, "b")], "y int, p double, seg string")
    out = {r.segment: r for r in M.fairness(df, "y", "p", 0.5, ["seg"]).collect()}
    assert set(out) == {"a"}
    assert out["a"].selection_rate == 0.5 and out["a"].tpr == 1.0 and out["a"].fpr == 0.0


def test_running_sums_keep_null_groups_and_null_values(spark):
    rows = [(None, None, 5), (None, 2.0, 1), (None, 1.0, 2), ("a", 3.0, 4), ("a", None, 7)]
    df = spark.createDataFrame(rows, "k string, v double, w long")
    up = {(r.k, r.v): (r.cum_w, r.all_w) for r in running_sums(df, "v", ["w"], ["k"], total_prefix="all_").collect()}
    assert up == {(None, None): (5, 8), (None, 1.0): (7, 8), (None, 2.0): (8, 8), ("a", None): (7, 11), ("a", 3.0): (11, 11)}
    down = {(r.k, r.v): r.cum_w for r in running_sums(df, "v", ["w"], ["k"], descending=True, buckets=2).collect()}
    assert down == {(None, 2.0): 1, (None, 1.0): 3, (None, None): 8, ("a", 3.0): 4, ("a", None): 11}


def test_running_sums_order_text_dates_and_times(spark):
    import datetime as dt
    import uuid

    rng = np.random.default_rng(8)
    ids = [str(uuid.UUID(bytes=rng.bytes(16))) for _ in range(300)] + ["", "é", "request-1", "request-10", "request-2"]
    day = [dt.date(2020, 1, 1) + dt.timedelta(days=int(i)) for i in rng.permutation(len(ids))]
    df = spark.createDataFrame([(a, b, dt.datetime.combine(b, dt.time(3)), 1) for a, b in zip(ids, day)], "s string, d date, t timestamp, w long")
    for col, order in (("s", sorted(ids, key=lambda x: x.encode())), ("d", sorted(day)), ("t", [dt.datetime.combine(x, dt.time(3)) for x in sorted(day)])):
        got = {r[col]: r.cum_w for r in running_sums(df, col, ["w"], buckets=16).collect()}
        assert [got[x] for x in order] == list(range(1, len(ids) + 1))


def test_plans_are_built_without_running_a_job(spark):
    from riskframe.operators import windowing

    seen = []
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    df = spark.range(1000).selectExpr("id % 3 k", "cast(id as double) v", "1 w")
    seen.append(windowing.quantile_arrays(df, ["k"], "v", [0.5]))
    seen.append(running_sums(df, "v", ["w"], ["k"]))
    assert set(tracker.getJobIdsForGroup(None)) == before and len(seen) == 2


def test_exact_quantiles_match_numpy(spark):
    from riskframe.operators import windowing

    rng = np.random.default_rng(7)
    vals = {"a": np.round(rng.lognormal(size=700), 3), "b": rng.integers(0, 5, 300).astype(float)}
    vals[None] = rng.normal(size=50)
    rows = [(k, float(v)) for k, arr in vals.items() for v in arr] + [("a", None), ("only null", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r["__q"] for r in windowing.quantile_arrays(df, ["k"], "v", qs).collect()}
    assert got.pop("only null") is None
    for k, arr in vals.items():
        assert np.allclose(got[k], np.quantile(arr, qs), rtol=0, atol=1e-12)
