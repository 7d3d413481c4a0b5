"""The sparse form of the feature matrix, and learners on it."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.functions.exprs import keyed_normal
from riskframe.operators import features as M
from riskframe.operators import ml as L
from riskframe.operators import treeshap
from riskframe.session import checkpoint_dir

NUM, CAT = ["x", "y"], ["h", "g"]


def rows(spark, n=120, shift=0):
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 7 != 0, (F.col("id") % 11).cast("double")).alias("x"), (F.col("id") % 5).cast("int").alias("y"),
        F.when(F.col("id") % 6 != 0, F.concat(F.lit("h"), (F.col("id") + shift) % 4)).alias("h"), F.concat(F.lit("g_"), F.col("id") % 3).alias("g"),
        F.when((F.col("id") % 11 > 4) & (F.col("id") % 3 > 0), 1).otherwise(0).alias("target"))


def test_cells_equal_the_long_form(spark):
    train, test = rows(spark), rows(spark, 60, 2).withColumn("h", F.when(F.col("id") % 9 == 0, "new").otherwise(F.col("h")))
    stats = M.fit(train, NUM, CAT)
    index = M.feature_index(stats, NUM)
    names = {r.position: r["name"] for r in index.collect()}
    assert [names[i] for i in range(len(names))] == ["num__x", "num__y", "cat__g_g_0", "cat__g_g_1", "cat__g_g_2", "cat__h_h0", "cat__h_h1", "cat__h_h2", "cat__h_h3", "cat__h_missing"]
    matrix = M.transform_sparse(test, stats, index, ["id"], NUM, CAT)
    got = {(r.id, names[r.position]): r.value for r in M.sparse_cells(matrix, ["id"]).collect()}
    want = {(r.id, r["name"]): r.value for r in M.transform_long(test, stats, "id", NUM, CAT).collect() if r.value != 0}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert matrix.head().features.size == 10 and matrix.count() == 60


def test_a_column_with_very_many_levels(spark):
    n = 200_000
    train = spark.range(n).select("id", F.concat(F.lit("user-"), "id").alias("u"), (F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("target"))
    stats = M.fit(train, ["x"], ["u"])
    index = M.feature_index(stats, ["x"])
    assert index.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first() == (0, n, n + 1)
    matrix = M.transform_sparse(train, stats, index, ["id", "target"], ["x"], ["u"])
    assert matrix.head().features.size == n + 1
    some = matrix.filter("id % 10 = 0")
    model = L.fit_lr(some, "features", max_iter=3)
    scored = L.score(some, model, "features")
    assert scored.count() == n // 10 and scored.filter("p is null").count() == 0
    place = index.filter("category = 'user-777'").first().position
    cells = {r.position: r.value for r in M.sparse_cells(matrix.filter("id = 777"), ["id"]).collect()}
    assert cells[place] == 1.0 and len(cells) <= 2


def test_learners_and_explanations_on_the_vector(spark):
    df = rows(spark, 300)
    stats = M.fit(df, NUM, CAT)
    index = M.feature_index(stats, NUM)
    matrix = M.transform_sparse(df, stats, index, ["id", "target"], NUM, CAT).cache()
    odds = L.odds_ratios(L.fit_lr(matrix, "features"), "features", 3, index).collect()
    assert len(odds) == 6 and {r.feature for r in odds} <= {r["name"] for r in index.collect()}
    assert L.score(matrix, L.fit_mlp(matrix, "features", hidden=(4,), epochs=2), "features").count() == 300
    forest = L.fit_rf(matrix, "features", trees=5, depth=4)
    total = {r.id: r.s for r in treeshap.forest_contributions(matrix, forest, "features", "id", checkpoint_dir(spark), index).groupBy("id").agg(F.sum("value").alias("s")).collect()}
    prob = {r.id: r.p for r in forest.transform(matrix).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert len(total) == 300 and all(abs(total[i] - p) < 1e-9 for i, p in prob.items())


def test_no_categories_and_no_train_rows_of_one(spark):
    df = rows(spark, 20)
    stats = M.fit(df, NUM, [])
    assert M.transform_sparse(df, stats, M.feature_index(M.fit(df, NUM, ["g"]), NUM), ["id"], NUM, []).head().features.size == 2


def test_keyed_noise_does_not_depend_on_partitioning(spark):
    df = spark.range(5000)
    noise = lambda d: {r.id: r.z for r in d.select("id", keyed_normal(F.col("id"), "x", 7).alias("z")).collect()}
    a, b = noise(df.repartition(1)), noise(df.repartition(13))
    assert a == b
    z = list(a.values())
    mean = sum(z) / len(z)
    assert abs(mean) < 0.05 and abs(sum((x - mean) ** 2 for x in z) / len(z) - 1) < 0.06
    other = {r.id: r.z for r in df.select("id", keyed_normal(F.col("id"), "y", 7).alias("z")).collect()}
    assert sum(a[i] == other[i] for i in a) == 0


def test_a_large_matrix_is_dealt_to_even_tasks(spark, monkeypatch):
    df = rows(spark, 600).coalesce(1)
    stats = M.fit(df, NUM, CAT)
    index = M.feature_index(stats, NUM)
    cells = lambda m: sorted(map(tuple, M.sparse_cells(m, ["id"]).collect()))
    whole = cells(M.transform_sparse(df, stats, index, ["id"], NUM, CAT))
    monkeypatch.setattr(M, "TASK_CELLS", 1000, raising=False)
    monkeypatch.setattr(M, "TASK_ROWS", 10, raising=False)
    dealt = M.transform_sparse(df, stats, index, ["id"], NUM, CAT)
    sizes = [len(x) for x in dealt.select("id").rdd.glom().collect()]
    assert len(sizes) == 6 and max(sizes) <= 110 and cells(dealt) == whole
