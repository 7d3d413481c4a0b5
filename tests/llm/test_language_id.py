import random

import pandas as pd
from pyspark.sql import functions as F

from riskframe.llm import language_id as L
from riskframe.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_on_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit_dictionaries(docs)
    got = L.identify_language(docs.withColumn("held", held_out(F.col("doc_id"), 4, 2)), model)
    test = got.filter("held").toPandas()
    assert len(test) > 200 and (test.lang == test.lang_pred).mean() > 0.97
    assert test.score.between(0, 1).all()


def test_held_out_rows_do_not_train(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200).cache()
    out = held_out(F.col("doc_id"), 4, 2)
    swapped = docs.withColumns({"text": F.when(out, F.lit("zzz")).otherwise(F.col("text")), "lang": F.when(out, F.lit("xx")).otherwise(F.col("lang"))})
    assert L.fit_dictionaries(docs) == L.fit_dictionaries(swapped)


def test_undetermined_rejected_and_edge_rows(spark, docs_of):
    rnd = random.Random(2)
    text = lambda ws: " ".join(rnd.choice(ws) for _ in range(80))
    a, b = ["alpha", "bravo", "charlie", "delta"], ["uno", "dos", "tres", "cuatro"]
    rows = [(i, text(a), "aa") for i in range(20)] + [(100 + i, text(b), "bb") for i in range(20)] + [(300, text(a), None)]
    model = L.fit_dictionaries(docs_of(rows))
    assert set(model) == {"aa", "bb"}
    asked = [(1, None), (2, ""), (3, "123 _ ... 漢".replace("漢", "")), (4, "BRAVO CHARLIE " * 20_000), (5, "tres dos uno cuatro tres dos"), (None, "alpha delta charlie alpha"), (5, "tres dos uno cuatro tres dos")]
    got = L.identify_language(docs_of(asked, clash=True), model).toPandas()
    assert list(got.lang_pred) == ["und", "und", "und", "aa", "bb", "aa", "bb"]
    assert list(got.rejected[:3]) == [True] * 3 and got.score[0] == 0.0 and got.score[4] == got.score[6]
    same = L.identify_language(docs_of([(1, "qqq www")]), {"x": b"abc", "y": b"abc"}, reject_as="und").first()
    assert same.rejected and same.lang_pred == "und" and same.margin == 0.0


def test_bytes_decide_as_in_a_direct_computation(spark, docs_of):
    import zstandard as zstd

    model = {"aa": b"alpha bravo " * 40, "bb": b"uno dos tres " * 40}
    texts = ["bravo alpha tres", "dos uno " * 400, "xyz"]
    got = L.identify_language(docs_of(list(enumerate(texts))), model, block_chars=500).orderBy("doc_id").collect()
    how = zstd.ZstdCompressionParameters(strategy=zstd.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False, **L.SEARCH)
    for t, r in zip(texts, got):
        size = {k: sum(len(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=how)
                           .compress(t[i:i + 500].encode())) for i in range(0, len(t), 500)) for k, d in model.items()}
        assert r.lang_pred == min(size, key=lambda k: (size[k], k))


def test_empty_table_and_no_languages(docs_of):
    assert L.fit_dictionaries(docs_of([])) == {} == L.fit_dictionaries(docs_of([(1, "abc")]))
    assert L.identify_language(docs_of([]), {}).count() == 0
    assert L.identify_language(docs_of([(1, "abc")]), {}).first().lang_pred == "und"
    assert isinstance(L.classify({}, 10, 4.0)("abc"), tuple) and pd.DataFrame is not None
