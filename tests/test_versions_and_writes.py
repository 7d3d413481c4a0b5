"""Versioned publishing, appends by run, and checks observed inside the write."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskframe.sources import io as IO
from riskframe.sources import versions as V


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def loans(spark, n=60, bad=2):
    return spark.range(n).select(F.col("id").alias("loan_id"), F.when(F.col("id") % bad == 0, 1).otherwise(0).alias("target"),
                                 F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")).alias("split"))


def ids(df):
    return sorted(r.loan_id for r in df.collect())


def test_a_half_written_build_is_never_seen(spark, root):
    IO.write_splits(loans(spark), root)

    def breaks(folder):
        loans(spark, 9).write.partitionBy("split").parquet(f"{folder}/splits")
        raise OSError("the store went away")

    with pytest.raises(OSError):
        V.publish(spark, root, breaks)
    assert list(V.versions(spark, root)) == [1] and IO.load_splits(spark, root)[0].count() == 20
    # a writer that died without a word leaves a folder that no pointer names
    loans(spark, 9).write.parquet(f"{root}/versions/2-dead/splits")
    assert IO.load_splits(spark, root)[0].count() == 20
    # and a pointer that was being written does not count
    (open(f"{root}/commits/2", "w")).close()
    assert list(V.versions(spark, root)) == [1]


def test_versions_stay_loadable_and_rebuild_only_when_asked(spark, root):
    built = []
    build = lambda n: lambda: built.append(n) or loans(spark, n)
    IO.build_dataset(spark, build(30), root)
    IO.build_dataset(spark, build(60), root)
    assert built == [30]
    old = IO.load_splits(spark, root)[0]
    train, val, test, receipt = IO.build_dataset(spark, build(60), root, force_rebuild=True)
    assert built == [30, 60] and list(V.versions(spark, root)) == [1, 2]
    assert old.count() == 10 and train.count() == 20  # a reader of the first version is not disturbed
    assert ids(IO.load_splits(spark, root, version=1)[1]) == list(range(1, 30, 3))
    assert {r.split: (r.rows, r.default_rate) for r in receipt.collect()} == {s: (20, 0.5) for s in ("train", "val", "test")}
    with pytest.raises(FileNotFoundError):
        IO.load_splits(spark, root, version=3)


def test_a_missing_output_is_built_again(spark, root):
    import os

    IO.build_dataset(spark, lambda: loans(spark), root)
    os.remove(f"{V.current(spark, root)}/splits/_SUCCESS")
    assert not IO.outputs_exist(spark, {f"{V.current(spark, root)}/splits": "parquet"})
    IO.build_dataset(spark, lambda: loans(spark), root)
    assert list(V.versions(spark, root)) == [1, 2]


def test_checks_reject_a_build_before_it_is_published(spark, root):
    IO.write_splits(loans(spark), root)
    checks = {"target is 0 or 1": F.col("target").isin(0, 1), "small ids": F.col("loan_id") < 50}
    with pytest.raises(IO.BuildRejected, match="small ids.*10"):
        IO.write_splits(loans(spark), root, checks=checks)
    with pytest.raises(IO.BuildRejected, match="outside the splits"):
        IO.write_splits(loans(spark).withColumn("split", F.when(F.col("loan_id") > 0, F.col("split"))), root)
    with pytest.raises(IO.BuildRejected, match="target"):
        IO.write_splits(loans(spark).withColumn("target", F.lit(None).cast("int")), root, checks=checks)
    assert list(V.versions(spark, root)) == [1]
    receipt = IO.write_splits(loans(spark, 45), root, checks=checks)
    assert sum(r.rows for r in receipt.collect()) == 45 and V.current(spark, root).split("/")[-1].startswith("2-")


def test_build_receipt_and_checks_are_one_scan(spark, root, tmp_path):
    loans(spark).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed-write", "one pass")
    try:
        got = IO.write_checked(df, f"{root}/t", IO.split_metrics(("train", "val", "test"), "split", "target", {"ok": F.col("target") >= 0}), "split")
        assert len(jobs.getJobIdsForGroup("observed-write")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got["rows"] == 60 and got["rows val"] == 20 and got["check ok"] == 0
    assert "CollectMetrics" in df.observe("x", F.count(F.lit(1)).alias("n"))._jdf.queryExecution().executedPlan().toString()


def test_writers_of_the_same_number(spark, root):
    write = lambda folder: loans(spark, 6).write.parquet(f"{folder}/t")

    def slow(folder):  # another writer publishes meanwhile
        write(folder)
        V.publish(spark, root, write)

    assert V.publish(spark, root, slow) == 2
    with pytest.raises(V.Conflict):
        V.publish(spark, root, slow, expected=2)
    with pytest.raises(V.Conflict):
        V.publish(spark, root, write, expected=2)
    assert V.publish(spark, root, write, expected=3) == 4
    assert all(IO.is_complete(spark, f"{folder}/t") for folder in V.versions(spark, root).values())


def test_alias_moves_by_compare_and_set(spark, root):
    for _ in range(3):
        V.publish(spark, root, lambda folder: loans(spark, 3).write.parquet(f"{folder}/t"))
    assert V.alias_state(spark, root, "champion") == (0, None)
    V.set_alias(spark, root, "champion", 1)
    with pytest.raises(V.Conflict):
        V.set_alias(spark, root, "champion", 2)  # seen before the first move
    V.set_alias(spark, root, "champion", 3, expected=1)
    assert V.alias_state(spark, root, "champion") == (2, 3)
    with pytest.raises(FileNotFoundError):
        V.set_alias(spark, root, "champion", 9, expected=3)


def test_a_repeated_run_replaces_its_rows(spark, root):
    log = spark.range(20).select(F.col("id"), (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp") + F.expr("make_interval(0, 0, 0, cast(id % 2 as int))")).alias("logged_at"))
    for run, part in (("a", "id < 10"), ("b", "id >= 10"), ("b", "id >= 10")):
        IO.append_log(log.filter(part), root, ["id", "logged_at"], run)
    back = IO.read_runs(spark, root)
    assert back.columns == ["id", "logged_at", "log_date"] and sorted(r.id for r in back.collect()) == list(range(20))
    import os

    os.remove(f"{root}/run=b/_SUCCESS")  # a run that did not end is not read
    assert sorted(r.id for r in IO.read_runs(spark, root).collect()) == list(range(10))
    with pytest.raises(ValueError):
        IO.append_log(log, root, ["id", "logged_at"], "a/b")
    with pytest.raises(FileNotFoundError):
        IO.read_runs(spark, root + "-none")


def test_features_are_published_together(spark, root):
    m, s = loans(spark), spark.range(2)
    assert IO.write_features(m, s, root) == 1 and IO.write_features(m.limit(5), s, root) == 2
    assert IO.load_features(spark, root)[0].count() == 5 and IO.load_features(spark, root, 1)[0].count() == 60


def test_learners_work_after_an_observed_write(spark, root):
    from riskframe.operators import ml as L

    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = IO.write_checked(loans(spark).groupBy("split").count(), f"{root}/t", {"rows": F.count(F.lit(1)), "n": F.sum("count")})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {"rows": 3, "n": 60}
    df = loans(spark).withColumn("x", F.col("loan_id").cast("double"))
    model = L.fit_lr(df, ["x"], max_iter=2)
    assert model.hasSummary and L.score(df, model, ["x"]).filter("p > 0").count() == 60
