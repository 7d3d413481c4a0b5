"""Successive halving over time folds, and its resumption."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators import ml as L


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(300).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"),
                                 F.when(F.col("id") % 10 > 6, 1).otherwise(0).alias("target"))
    folds = df.select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("fold")).filter(F.col("id") < 100 * (F.col("fold") + 1)).withColumn(
        "part", F.when(F.col("id") < 100 * F.col("fold") + 60, "train").otherwise("test"))
    return df.cache(), folds


class Learner:
    """Fits nothing: a trial's quality is its parameter, so the right decisions are known."""

    def __init__(self, stop_after=None):
        self.calls, self.stop_after = [], stop_after

    def __call__(self, df, features, y, quality=0.0, **other):
        if self.stop_after is not None and len(self.calls) >= self.stop_after:
            raise RuntimeError("stopped")
        self.calls.append(quality)
        return L.fit_lr(df, ["x"] if quality > 0.5 else ["z"], y, max_iter=2)


@pytest.fixture
def same_columns(monkeypatch):
    real = L.score
    monkeypatch.setattr(L, "score", lambda df, model, features, **kw: real(df.withColumn("w", F.lit(1)), model, ["x"] if model.coefficients[0] > 0.3 else ["z"], **kw))


TRIALS = [{"quality": q / 10, "other": i} for i, q in enumerate([1, 9, 2, 8, 3, 1, 7, 2, 1])]


def test_weak_trials_stop_early(spark, data, tmp_path, same_columns):
    learn = Learner()
    out = L.halving_search(*data, ["x"], "target", TRIALS, "id", learn, str(tmp_path / "t"), max_parallel=1).collect()
    assert len(learn.calls) == 9 + 3 + 1 and [r["rank"] for r in out] == list(range(1, 10))
    assert sorted(r.folds for r in out) == [1] * 6 + [2] * 2 + [3]
    assert {r.trial for r in out if r.folds > 1} == {1, 3, 6} and out[0].trial == 1 and out[0].folds == 3


def test_a_stopped_search_resumes(spark, data, tmp_path, same_columns):
    path = str(tmp_path / "t")
    with pytest.raises(Exception, match="stopped"):
        L.halving_search(*data, ["x"], "target", TRIALS, "id", Learner(stop_after=5), path, max_parallel=1)
    learn = Learner()
    out = L.halving_search(*data, ["x"], "target", TRIALS, "id", learn, path, max_parallel=1).collect()
    assert len(learn.calls) == 13 - 5 and out[0].trial == 1
    learn = Learner()
    again = L.halving_search(*data, ["x"], "target", TRIALS, "id", learn, path, max_parallel=1).collect()
    assert learn.calls == [] and again == out
    changed = [{"quality": 0.1, "other": 99}, *TRIALS[1:]]  # another trial under the same number is fitted anew
    learn = Learner()
    L.halving_search(*data, ["x"], "target", changed, "id", learn, path, max_parallel=1).collect()
    assert learn.calls == [0.1]


def test_trials_are_drawn_from_the_space():
    space = {"a": (1, 3), "b": (0.5, 0.6), "c": ["x", "y"]}
    got = L.sample_trials(space, 40, 1)
    assert got == L.sample_trials(space, 40, 1) and got != L.sample_trials(space, 40, 2)
    assert {t["a"] for t in got} == {1, 2, 3} and all(0.5 <= t["b"] <= 0.6 and t["c"] in "xy" for t in got)


def test_a_search_of_few_rows_runs_few_tasks(spark, data, tmp_path):
    seen = []

    def fit(df, features, y, **other):
        seen.append(df.rdd.getNumPartitions())
        return L.fit_lr(df, features, y, max_iter=2)

    L.halving_search(*data, ["x"], "target", [{"other": 1}, {"other": 2}], "id", fit, str(tmp_path / "t"), max_parallel=1).collect()
    L.search(*data, ["x"], "target", [{"other": 1}], "id", fit)
    assert set(seen) == {1}  # 300 rows: one task a pass, not one for each of the shuffle's partitions


def test_the_search_draws_from_the_whole_boosting_space():
    from riskframe.plans.models import BOOSTING_SPACE

    trials = L.sample_trials(BOOSTING_SPACE, 50)
    assert len(BOOSTING_SPACE) == 8 and len(trials) == 50
    for name, low, high in (("iters", 100, 1000), ("depth", 3, 10), ("step", 0.01, 0.3), ("subsample", 0.5, 1.0), ("feature_subset", 0.5, 1.0)):
        values = [t[name] for t in trials]
        assert all(low <= v <= high for v in values) and max(values) - min(values) > 0.8 * (high - low)
    assert 0.03 < sorted(t["step"] for t in trials)[25] < 0.1  # even on a log scale


def test_boosting_takes_a_share_of_the_features(data):
    model = L.fit_gbt(data[0], ["x", "z"], "target", iters=2, depth=2, feature_subset=0.5)
    assert model.getFeatureSubsetStrategy() == "0.5" and model.getNumTrees == 2


def test_a_rung_reads_its_own_fold_and_scores_once(spark, data, tmp_path, monkeypatch):
    df, folds = data
    seen, calls, real = [], spark.sparkContext.accumulator(0), L.score

    def fit(rows, features, y, **other):
        seen.append((rows.count(), str(rows._jdf.queryExecution().optimizedPlan())))
        return L.fit_lr(rows, features, y, max_iter=2)

    @F.udf("double")
    def counted(p):
        calls.add(1)
        return p

    def score(rows, model, features, **kw):
        return real(rows, model, features, **kw).withColumn("p", counted.asNondeterministic()("p"))

    monkeypatch.setattr(L, "score", score)
    L.halving_search(df, folds, ["x"], "target", [{"other": 1}, {"other": 2}], "id", fit, str(tmp_path / "t"), max_parallel=1).collect()
    want = {f: folds.filter((F.col("fold") == f) & (F.col("part") == "train")).count() for f in range(3)}
    assert [n for n, _ in seen] == [want[0], want[0], want[1], want[2]]
    assert all("fold#" not in plan.split("StorageLevel")[0] for _, plan in seen)  # no filter by fold over the rows of all folds
    tests = {f: folds.filter((F.col("fold") == f) & (F.col("part") == "test")).count() for f in range(3)}
    assert calls.value == 2 * tests[0] + tests[1] + tests[2]  # each test row once a fit
