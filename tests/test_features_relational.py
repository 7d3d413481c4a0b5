"""Feature fits, out-of-fold target encoding, folds and positions against brute force."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskframe.operators import features as M
from riskframe.operators import relational as R


def test_median_scaler_population_std(spark):
    vals = [1.0, 2.0, None, 10.0, 4.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = M.fit_scaler(df, ["x"]).first()
    arr = np.array([v for v in vals if v is not None])
    med = np.median(arr)
    imp = np.array([med if v is None else v for v in vals])
    assert s.median == med and abs(s.mean - imp.mean()) < 1e-12 and abs(s.std - imp.std(ddof=0)) < 1e-12


def test_onehot_unknown_all_zero(spark):
    tr = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    stats = M.fit(tr, [], ["c"])
    te = spark.createDataFrame([(1, "zz"), (2, "a"), (3, None)], "id int, c string")
    wide = M.transform_wide(te, stats, ["id"], [], ["c"]).orderBy("id").collect()
    assert [c for c in wide[0].asDict() if c.startswith("cat__")] == ["cat__c_a", "cat__c_b", "cat__c_missing"]
    assert wide[0].cat__c_a == 0 and wide[0].cat__c_b == 0 and wide[0].cat__c_missing == 0
    assert wide[1].cat__c_a == 1.0 and wide[2].cat__c_missing == 1.0


def test_oof_target_encoding_brute_force(spark):
    rng = np.random.default_rng(0)
    n = 600
    cats = rng.choice(["a", "b", "c", "d"], n, p=[0.6, 0.2, 0.15, 0.05])
    y = (rng.random(n) < np.where(cats == "a", 0.3, 0.1)).astype(int)
    fold = np.arange(n) % 5
    df = spark.createDataFrame([(int(i), str(c), int(t), int(f)) for i, c, t, f in zip(range(n), cats, y, fold)],
                               "id long, c string, y int, fold int")
    got = {r.id: r["te__c"] for r in M.target_encode_oof(df, "c", "id", "y", 5, fold_col=F.col("fold")).collect()}
    pdf = pd.DataFrame({"c": cats, "y": y, "fold": fold})
    for i in range(0, n, 37):
        other = pdf[pdf.fold != fold[i]]
        m, V = other.y.mean(), other.y.var(ddof=0)
        g = other[other.c == cats[i]].y
        lam = len(g) * V / (len(g) * V + g.var(ddof=0))
        assert abs(got[i] - (lam * g.mean() + (1 - lam) * m)) < 1e-12


def test_global_position_with_hot_date(spark):
    base = datetime(2020, 1, 1)
    rows = [(i, base if i % 3 == 0 else base + timedelta(days=i % 7)) for i in range(600)]  # one date holds > 1/3
    df = spark.createDataFrame(rows, "id long, d timestamp_ntz")
    got = {r.id: r.position for r in R.global_position(df, "d", "id", buckets=8).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert all(got[r[0]] == i for i, r in enumerate(order))


def test_global_position_puts_null_dates_last_and_takes_text_keys(spark):
    base = datetime(2020, 1, 1)
    rows = [(f"req-{i:03d}", None if i % 5 == 0 else base + timedelta(hours=i % 9)) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, d timestamp_ntz")
    got = {r.id: r.position for r in R.global_position(df, "d", "id", buckets=8).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or base, r[0]))
    assert len(got) == 120 and all(got[r[0]] == i for i, r in enumerate(order))


def test_sample_hash_does_not_overflow(spark):
    df = spark.createDataFrame([(2**62 + i,) for i in range(50)] + [(i,) for i in range(50)], "k long")
    assert len({r.k for r in R.sample_n(df, "k", 20).collect()}) == 20


def test_time_folds_expanding(spark):
    base = datetime(2020, 1, 1)
    rows = [(i, base + timedelta(days=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, d timestamp_ntz")
    f = R.time_folds(df, "d", "id", 5).collect()
    size = 60 // 6
    for k in range(5):
        test_ids = sorted(r.id for r in f if r.fold == k and r.part == "test")
        train_ids = sorted(r.id for r in f if r.fold == k and r.part == "train")
        start = 60 - (5 - k) * size
        assert test_ids == list(range(start, start + size))
        assert train_ids == list(range(0, start))


def test_top_reasons_and_magnitude(spark):
    rows = [(1, "num__a", 0.5), (1, "num__b", -2.0), (1, "num__c", 1.0), (1, "num__d", 0.1), (1, "num__e", 0.0), (1, "num__f", 0.05)]
    df = spark.createDataFrame(rows, "id long, feature string, value double")
    top = R.top_reasons(df, 5).orderBy("rank").collect()
    assert [r.feature for r in top] == ["num__b", "num__c", "num__a", "num__d", "num__f"]
    mag = {r.feature: r.magnitude for r in R.reason_magnitude(df).collect()}
    assert mag["num__b"] == "strongly" and mag["num__c"] == "moderately" and mag["num__a"] == "slightly"


def test_sample_is_deterministic(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = [r.k for r in R.sample_n(df, "k", 10, 7).collect()]
    b = [r.k for r in R.sample_n(df.repartition(7), "k", 10, 7).collect()]
    assert a == b and len(a) == 10


def test_onehot_with_very_many_levels(spark):
    import pytest

    from riskframe.operators import features as M

    df = spark.range(60_000).selectExpr("id", "concat('employer ', id) as c", "cast(id % 7 as double) as x")
    vocab = M.fit_onehot(df, ["c"])
    assert vocab.count() == 60_000
    order = sorted(f"employer {i}" for i in range(60_000))
    got = {r.category: r.position for r in vocab.filter("position < 5 or position > 59990").collect()}
    assert all(order[p] == c for c, p in got.items())
    stats = M.fit(df, ["x"], ["c"])
    assert M.transform_long(df, stats, "id", ["x"], ["c"]).count() == 120_000
    with pytest.raises(ValueError, match="transform_long"):
        M.transform_wide(df, stats, ["id"], ["x"], ["c"])
