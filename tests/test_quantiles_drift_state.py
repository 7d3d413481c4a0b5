"""Bracketed quantiles and the fitted drift profile."""

import math

import numpy as np
import pytest

from riskframe.operators import drift as D
from riskframe.operators import windowing as W

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


def interpolated(x, qs):
    xs, out = sorted(x), []
    for q in qs:
        pos = q * (len(xs) - 1)
        a, b = xs[math.floor(pos)], xs[math.ceil(pos)]
        out.append(a if a == b or math.floor(pos) == math.ceil(pos) else (math.ceil(pos) - pos) * a + (pos - math.floor(pos)) * b)
    return out


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(float(rng.normal()), float(rng.integers(0, 4)), None if rng.random() < 0.4 else float(rng.exponential()), None) for _ in range(5000)]
    return rows, spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5).cache()


@pytest.mark.parametrize("accuracy", [10_000, 50, 2])
def test_quantiles_are_exact_whatever_the_sketch_gives(numbers, accuracy):
    rows, df = numbers
    got = W.fit_quantiles(df, ["a", "b", "c", "d"], QS, accuracy=accuracy)
    for k, c in enumerate("abc"):
        assert got[c] == interpolated([r[k] for r in rows if r[k] is not None], QS)
    assert got["d"] == [None] * len(QS)


def test_a_bracket_that_misses_is_looked_for_in_its_gap(numbers, monkeypatch):
    from pyspark.sql import functions as F

    rows, df = numbers
    passes = []
    monkeypatch.setattr(W.F, "percentile_approx", lambda c, levels, accuracy: F.array(*[F.max(c)] * len(levels)))
    real = W._ranked
    monkeypatch.setattr(W, "_ranked", lambda *a: passes.append(1) or real(*a))
    assert W.fit_quantiles(df, ["a"], QS)["a"] == interpolated([r[0] for r in rows], QS)
    assert len(passes) == 2


def test_quantiles_of_few_values_infinities_and_nan(spark):
    df = spark.createDataFrame([(1.0, 5), (float("inf"), 5), (float("-inf"), 5), (float("nan"), None)], "x double, y int")
    got = W.fit_quantiles(df, ["x", "y"], [0.0, 1 / 3, 2 / 3, 1.0])
    assert got["x"][:3] == [float("-inf"), 1.0, float("inf")] and math.isnan(got["x"][3]) and got["y"] == [5.0] * 4
    assert W.fit_quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}
    approx = W.fit_quantiles(df.filter("x < 10"), ["x"], [1.0], exact=False)
    assert approx == {"x": [1.0]}


def test_profile_survives_a_table_and_gives_the_same_report(spark, tmp_path):
    ref = spark.createDataFrame([(float(i % 50), f"c{i % 4}" if i % 9 else None, None) for i in range(600)], "x double, c string, z double")
    tgt = spark.createDataFrame([(float(i % 70), f"c{i % 6}" if i % 5 else "missing", 1.0) for i in range(400)], "x double, c string, z double")
    fitted = D.fit_profile(ref, ["x", "z"], ["c"])
    fitted.table().write.parquet(str(tmp_path / "p"))
    again = D.Profile.from_table(spark.read.parquet(str(tmp_path / "p")))
    assert again.edges == fitted.edges and again.categorical == ["c"] and again.edges["z"] == []
    rows = lambda p: sorted(tuple(r) for r in D.drift_report(p, tgt, ["x", "z"], ["c"], "t").collect())
    assert rows(fitted) == rows(again) == rows(ref)


def test_report_needs_few_shuffles_and_one_scan_of_the_target(spark, tmp_path):
    ref = spark.range(500).selectExpr("cast(id % 90 as double) as x", "cast(id % 7 as string) as c", "case when id % 2 = 0 then 'a' else 'b' end as label")
    ref.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    rep = D.drift_report_by(D.fit_profile(t, ["x"], ["c"]), t, ["x"], ["c"], "label")
    plan = rep._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") <= 8
