import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import quality as Q
from riskframe.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, Q.fit_quality(docs, labels, "quality", ~held_out(F.col("doc_id"), 3, 1))


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    got = Q.score_quality(docs, model).join(labels, "doc_id").withColumn("held", held_out(F.col("doc_id"), 3, 1)).toPandas()
    test = got[got.held]
    assert len(test) > 80 and ((test.score >= 0.5).astype(int) == test.quality).mean() > 0.95
    assert got.score.between(0, 1).all()
    clean = test[test.quality == 1]
    assert (clean.score >= 0.5).mean() > 0.98


def test_edge_texts_get_defined_scores(fitted, docs_of):
    model = fitted[2]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "漢" * 10), (5, "the " * 100_000), (None, "and the of"), (7, "and the of"), (7, "and the of")]
    s = [r.score for r in Q.score_quality(docs_of(rows, clash=True), model).orderBy(F.monotonically_increasing_id()).collect()]
    assert len(s) == 8 and s[0] == s[1] == s[2] and s[5] == s[6] == s[7] and all(0 <= x <= 1 for x in s)
    assert s[4] < 0.5  # one word, a hundred thousand times
    assert Q.score_quality(docs_of([]), model).count() == 0


def test_chunks_do_not_change_a_pooled_vector(fitted, monkeypatch):
    model, index = fitted[2], Q.index_vectors()
    text = "The re%% and || of, the. " * 300
    whole = Q.pool(text, model.rows, model.table(index), index, {})
    monkeypatch.setattr(Q, "CHUNK", 7)
    assert np.allclose(whole, Q.pool(text, model.rows, model.table(index), index, {}), atol=1e-4)


def test_constant_models_without_labels_or_classes(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, "c d"), (3, "e f")])
    none = Q.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality long"), "quality", F.lit(True))
    assert {r.score for r in Q.score_quality(docs, none).collect()} == {0.5}
    one = Q.fit_quality(docs, spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality long"), "quality", F.lit(True))
    assert {r.score > 0.5 for r in Q.score_quality(docs, one).collect()} == {True}


def test_held_out_labels_and_lang_do_not_matter(fitted):
    docs, labels, model = fitted
    other = labels.withColumn("quality", F.when(held_out(F.col("doc_id"), 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.fit_quality(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), other, "quality", ~held_out(F.col("doc_id"), 3, 1))
    assert np.allclose(model.w1, again.w1) and model.temperature == again.temperature and model.rows == again.rows


def test_temperature_lowers_the_calibration_loss():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=(1500, Q.SIZE)), np.full(1500, 100.0)])
    y = (rng.random(1500) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(float)
    m = Q.Model({}, np.zeros((0, Q.DIMS)), **Q.fit_network(x, y, y.mean()))
    back = np.random.default_rng(5).permutation(1500)[:300]
    loss = lambda s: -np.mean(y[back] * np.log(s[back] + 1e-12) + (1 - y[back]) * np.log(1 - s[back] + 1e-12))
    calibrated = loss(m.scores(x))
    m.temperature = 1.0
    assert calibrated <= loss(m.scores(x)) + 1e-9
