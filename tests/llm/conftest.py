import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text[, lang[, source]]) -> documents, with extra columns of clashing names when asked for."""
    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            from pyspark.sql import functions as F

            names = ["score", "kept", "h", "id", "t", "node", "key", "__row", "mix_slot", "part", "token_ids", "label", "y", "n"]
            df = df.withColumns({c: F.lit("x") for c in names})
        return df

    return make
