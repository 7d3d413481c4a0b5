"""Repeated rows by digest."""

from collections import Counter

from pyspark.sql import functions as F

from riskframe.operators import duplicates as D
from riskframe.operators import health as H
from riskframe.operators import relational as R


def rows_of(df):
    return Counter({tuple(r)[:-1]: r.n for r in df.collect()})


DATA = [(1, "a", 1.0), (1, "a", 1.0), (2, None, 1.0), (2, None, 1.0), (2, None, 1.0), (None, "2", 1.0), (3, "b", None), (3, None, None), (None, "b", None),
        (4, "x", float("nan")), (4, "x", float("nan")), (5, "z", 0.0), (5, "z", -0.0), (6, "", 2.0), (6, None, 2.0)]


def test_equals_grouping_of_whole_rows(spark):
    df = spark.createDataFrame(DATA, "i long, s string, x double").repartition(3)
    want = df.groupBy("i", "s", "x").agg(F.count("*").alias("n")).filter("n > 1")
    assert sorted(map(str, rows_of(D.repeated_rows(df)).items())) == sorted(map(str, rows_of(want).items()))
    assert D.repeated_rows(df.limit(0)).count() == 0


def test_colliding_digests_are_told_apart(spark):
    df = spark.createDataFrame(DATA, "i long, s string, x double")
    one = lambda cols: (F.lit(7).cast("long"), F.lit(7).cast("long"))  # noqa: E731 - every row collides
    assert sorted(map(str, rows_of(D.repeated_rows(df, digest=one)).items())) == sorted(map(str, rows_of(D.repeated_rows(df)).items()))


def test_nulls_in_different_columns_have_different_digests(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "s string, t string")
    d1, d2 = D.row_digest(["s", "t"])
    assert df.select(d1, d2).distinct().count() == 2


def test_only_digests_and_suspect_rows_are_shuffled(spark, tmp_path):
    wide = spark.range(4000).select((F.col("id") % 3990).alias("i"), *[F.sha2((F.col("id") % 3990).cast("string"), 512).alias(f"c{k}") for k in range(6)])
    wide.write.parquet(str(tmp_path / "w"))
    found = D.repeated_rows(spark.read.parquet(str(tmp_path / "w")))
    assert found.count() == 10
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # the few suspect digests go to the rows
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2  # counts of digests; suspect rows, counted before


def test_u4_and_h3_use_it(spark):
    a, b = spark.createDataFrame(DATA[:6], "i long, s string, x double"), spark.createDataFrame(DATA[6:], "i long, s string, x double")
    assert tuple(R.overlap([a, b]).first()) == (4, 9)
    logs = a.withColumn("logged_at", F.lit("2024-01-01").cast("timestamp")).withColumn("request_id", F.monotonically_increasing_id())
    assert tuple(H.duplicate_payloads(logs).first()) == (2, 3)
