"""Random forests: scores of many rows at once against the model's own, and what a fit and its evaluation read."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskframe.operators import features as M
from riskframe.operators import forest
from riskframe.operators import metrics as E
from riskframe.operators import ml as L


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    df = spark.range(3000).select("id", (k % 97).cast("double").alias("a"), F.when(k % 11 != 0, (k * 7 % 53).cast("double")).alias("b"),
                                  F.when(k % 13 != 0, F.concat(F.lit("v"), (k % 6).cast("string"))).alias("c"),
                                  F.when((k % 97 + k * 7 % 53 + k % 6 * 9 + k * 31 % 40) > 90, 1).otherwise(0).alias("target"))
    stats = M.fit(df, ["a", "b"], ["c"])
    return M.transform_sparse(df, stats, M.feature_index(stats, ["a", "b"]), ["id", "target"], ["a", "b"], ["c"]).cache()


def own(df, model):
    return {r.id: r.p for r in model.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}


def test_scores_equal_the_models_own(spark, rows, monkeypatch):
    model = L.fit_rf(rows, "features", trees=15, depth=7)
    got = {r.id: (r.p, r.pred) for r in L.score(rows, model, "features", 0.4).collect()}
    want = own(rows, model)
    assert {i: p for i, (p, _) in got.items()} == want and len(set(want.values())) > 50
    assert all(pred == int(p >= 0.4) for p, pred in got.values())
    monkeypatch.setattr(forest, "STEP_CELLS", 500)  # many steps a batch, the last one short
    assert {r.id: r.p for r in L.score(rows, model, "features").collect()} == want


def test_dense_sparse_and_odd_vectors(spark, rows):
    model = L.fit_rf(rows, "features", trees=15, depth=7)
    size = model.numFeatures
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=size) for _ in range(40)] + [np.zeros(size), np.full(size, np.nan), np.full(size, np.inf), np.full(size, -np.inf), np.ones(size)]
    data = [(i, Vectors.dense(v) if i % 2 else Vectors.sparse(size, [(j, float(v[j])) for j in range(0, size, 2)])) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([*data, (99, Vectors.sparse(size, []))], ["id", "features"])
    assert {r.id: r.p for r in L.score(df, model, "features").collect()} == own(df, model)
    assert L.score(df.limit(0), model, "features").collect() == []


def test_a_tree_without_splits_and_one_class(spark):
    df = spark.createDataFrame([(i, float(i), 0) for i in range(20)] + [(20, 3.0, 1)], "id int, x double, target int")
    model = L.fit_rf(df, ["x"], trees=3, depth=1)
    want = own(VectorAssembler(inputCols=["x"], outputCol="features").transform(df), model)
    assert {r.id: r.p for r in L.score(df, model, ["x"]).collect()} == want


def test_a_split_of_many_categories_is_left_to_the_model(spark):
    from pyspark.ml.feature import StringIndexer

    df = spark.range(400).select("id", F.concat(F.lit("v"), (F.col("id") % 7).cast("string")).alias("c"), (F.col("id") % 7 > 3).cast("int").alias("target"))
    df = VectorAssembler(inputCols=["i"], outputCol="features").transform(StringIndexer(inputCol="c", outputCol="i").fit(df).transform(df))
    model = L.fit_rf(df, "features", trees=3, depth=3)
    assert {r.id: r.p for r in L.score(df, model, "features").collect()} == own(df, model)


def test_a_fit_keeps_the_nodes_its_rows_have_reached(rows):
    model = L.fit_rf(rows, "features", trees=3, depth=3)
    assert model.getCacheNodeIds() and model.getNumTrees == 3


def test_a_stored_histogram_computes_scores_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def dear(x):
        calls.add(1)
        return x / 7.0

    df = spark.range(100).select((F.col("id") % 2).alias("y"), (F.col("id") * 37 % 100 % 41).cast("double").alias("x"))
    want = E.ranking_metrics(df.withColumn("p", F.col("x") / 7.0), "y", "p").collect()
    assert E.ranking_metrics(df.withColumn("p", dear.asNondeterministic()("x")), "y", "p", stored=True).collect() == want
    assert calls.value == 100
