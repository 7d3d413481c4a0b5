"""The registered queries against their SQL, and the pipeline against brute force of its stages."""

import duckdb
import pytest

import __spark_entry__ as entry
from riskframe.llm import queries as Q

SF = "/root/testdata/sf0.001"


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = Q.QUERIES[name](spark, SF)
    want = con.execute(Q.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert canon(got.columns, [tuple(r) for r in got.collect()]) == canon(cols, want.fetchall())


def test_all_queries_are_registered():
    names = entry.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_other_queries_return_one_row_per_document(spark, name):
    ids = [r.doc_id for r in Q.QUERIES[name](spark, SF).select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P
    from test_minhash_dedup import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs, columns = [docs.toPandas()], docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(docs.toPandas())
        assert docs.columns[:len(columns)] == columns and (k == len(P.STAGES) - 1) == (len(docs.columns) > len(columns))
    start, good, exact, near, mixed, done = outs
    op6 = Q.QUERIES["op6_quality"](spark, SF).toPandas()
    assert set(good.doc_id) == set(op6[op6.predicted == 1].doc_id)
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    assert sorted(exact.doc_id) == sorted(good.assign(k=good.text.map(low)).groupby("k").doc_id.max())
    assert sorted(near.doc_id) == sorted(i for i, _, c in brute(list(zip(exact.doc_id, exact.text)), 5) if i == c)
    assert sorted(mixed.doc_id) == sorted(near.doc_id) == sorted(done.doc_id)
    assert done.round_trip.all() and start.shape[0] >= len(done)


def test_pipeline_result_is_in_mix_order_after_rereading_several_files(spark):
    import corpus_pipeline as P
    from riskframe.llm import source_mix

    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        out = P.run(spark, SF)
        rows = out.select("doc_id", "source", "mix_slot", "mix_offset").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(out.inputFiles()) > 3
    places = [(r.mix_slot, r.mix_offset) for r in rows]
    assert places == sorted(places) and len(set(places)) == len(rows)
    mixed = source_mix.in_mix_order(spark.createDataFrame([(r.doc_id, r.source) for r in rows], "doc_id long, source string"))
    assert [r.doc_id for r in rows] == [r.doc_id for r in mixed.collect()]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
