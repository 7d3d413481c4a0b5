"""Log health, request validation, ML additivity and streaming-vs-batch behaviour."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskframe.operators import checks as V
from riskframe.operators import health as H
from riskframe.operators import ml as L
from riskframe.streaming import jobs as X


def test_hourly_traffic_gap_fill(spark):
    now = datetime(2024, 1, 31)
    rows = [(1, now - timedelta(hours=2, minutes=10)), (2, now - timedelta(hours=2, minutes=5)), (3, now + timedelta(minutes=30)),
            (4, now - timedelta(hours=100))]
    df = spark.createDataFrame(rows, "request_id long, logged_at timestamp_ntz")
    buckets, flag = H.hourly_traffic(df, now, 5)
    got = {r.hour_start: r["count"] for r in buckets.collect()}
    assert len(got) == 5
    assert got[now - timedelta(hours=3)] == 2 and got[now] == 1 and sum(got.values()) == 3
    f = flag.first()
    assert f.nonzero_hours == 2 and f.is_bursty is False


def test_duplicate_payloads_nulls_equal(spark):
    rows = [(1, 5.0, None), (2, 5.0, None), (3, 5.0, None), (4, 6.0, "x")]
    df = spark.createDataFrame(rows, "request_id long, a double, b string")
    r = H.duplicate_payloads(df).first()
    assert (r.duplicate_payload_groups, r.duplicate_payload_extra_rows) == (1, 2)


def test_request_validation(spark):
    reqs = [
        (1, {"annual_inc": "50000", "dti": "10", "mths": None, "term": " 36 months"}),
        (2, {"dti": "10", "mths": "3", "term": " 36 months"}),                                 # missing income
        (3, {"annual_inc": "not a number", "dti": "10", "mths": "3", "term": " 36 months"}),
        (4, {"annual_inc": "100", "dti": "None", "mths": "3", "term": " 36 months"}),         # "None" string rejected
        (5, {"annual_inc": "100", "dti": "1", "mths": "3", "term": " 48 months"}),
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in reqs], "request_id long, payload string")
    valid, bad = V.validate_requests(df, "payload", ["annual_inc", "dti", "mths"], nullable=["mths"],
                                     enums={"term": [" 36 months", " 60 months"]})
    assert [r.request_id for r in valid.collect()] == [1]
    errs = {r.request_id: r.errors for r in bad.collect()}
    assert errs[2] == ["annual_inc: missing"] and errs[3] == ["annual_inc: not a number"]
    assert errs[4] == ["dti: not a number"] and errs[5] == ["term: not allowed"]


def test_scorecard_contributions_add_up(spark):
    rows = [(i, float(i % 7), float((i * 3) % 11), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, target int")
    card = L.fit_scorecard(df, ["a", "b"])
    contrib = L.scorecard_contributions(df, card, "id", ["a", "b"])
    scores = L.scorecard_scores(L.scorecard_rows(df, card, "id", ["a", "b"]))
    j = contrib.groupBy("id").agg(F.sum("value").alias("s")).join(scores, "id")
    assert j.filter(F.abs(F.col("s") - F.col("margin")) > 1e-12).count() == 0


def test_risk_ordering(spark):
    rows = [(i, float(i % 50), int(i % 50 > 35)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, dti double, target int")
    card = L.fit_scorecard(df, ["dti"])
    fixture = spark.createDataFrame([(1, 5.0), (2, 45.0)], "id long, dti double")  # low-risk, high-risk
    s = {r.id: r.p for r in L.scorecard_scores(L.scorecard_rows(fixture, card, "id", ["dti"])).collect()}
    assert s[1] < s[2]


def test_stream_dedupe_and_late_rows(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(minutes=10 * i), 1) for i in range(60)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")
    src = X.stage_event_files(spark, ev, X.scratch(spark, "t-src"), 4)
    # generous delay: equals the batch answer
    stream = X.read_stream(spark, src, ev.schema, 1, event_time="ts")
    out = X.scratch(spark, "t-out")
    X.run_available(X.dedupe(stream, "event_id", "ts", "30 days").select("event_id"), out, X.scratch(spark, "t-ck"))
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(60))
    # tight delay: windows of rows held back to the last drop are already closed, so those rows are dropped
    stream2 = X.read_stream(spark, src, ev.schema, 1, event_time="ts")
    out2 = X.scratch(spark, "t-out2")
    X.run_available(X.hourly_counts(stream2, "ts", "10 minutes"), out2, X.scratch(spark, "t-ck2"), "update")
    streamed = X.latest_per_key(spark, out2, ["window_start"]).agg(F.sum("count")).first()[0]
    with_dups = 60 + sum(1 for i in range(60) if i % 50 == 0 and i % 97 != 0)
    assert streamed < with_dups


def test_gbt_treeshap_additivity(spark):
    import math

    from pyspark.ml.functions import vector_to_array

    from riskframe.operators import treeshap
    from riskframe.session import checkpoint_dir

    rows = [(i, float(i % 7), float((i * 3) % 11), float(i % 4), int((i % 7) + (i % 4) > 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, target int")
    feats = ["a", "b", "c"]
    model = L.fit_gbt(df, feats, "target", iters=8, depth=3)
    contrib = treeshap.gbt_contributions(df.limit(40), model, feats, "id", checkpoint_dir(spark))
    total = {r.id: r.s for r in contrib.groupBy("id").agg(F.sum("value").alias("s")).collect()}
    prob = {r.id: r.p for r in model.transform(L.assemble(df.limit(40), feats))
            .select("id", vector_to_array("probability")[1].alias("p")).collect()}
    for i, s in total.items():
        assert abs(s - math.log(prob[i] / (1 - prob[i]))) < 1e-6


def test_tree_contributions_of_dummies_are_summed_to_their_column(spark):
    import math

    from pyspark.ml.functions import vector_to_array

    from riskframe.operators import treeshap
    from riskframe.session import checkpoint_dir

    feats = ["num__a", "cat__g_x", "cat__g_y", "cat__g_z", "cat__g_h_x"]
    rows = [(i, float(i % 7), float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2), float(i % 2), int((i % 7) + 3 * (i % 3) + i % 2 > 6)) for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(["id long", *[f"{f} double" for f in feats], "target int"]))
    model = L.fit_gbt(df, feats, "target", iters=8, depth=3)
    some = df.limit(40)
    raw = treeshap.gbt_contributions(some, model, feats, "id", checkpoint_dir(spark))
    got = treeshap.sum_to_parents(raw, ["g", "g_h"]).toPandas()
    assert {"cat__g", "cat__g_h"} <= set(got.feature) <= {"num__a", "cat__g", "cat__g_h", "__base__"} and not got.duplicated(["id", "feature"]).any()
    parts = raw.toPandas()
    want = parts[parts.feature.isin(["cat__g_x", "cat__g_y", "cat__g_z"])].groupby("id").value.sum()
    have = got[got.feature == "cat__g"].set_index("id").value
    assert len(want) == len(have) and all(abs(have[i] - v) < 1e-9 for i, v in want.items())
    prob = {r.id: r.p for r in model.transform(L.assemble(some, feats)).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    for i, s in got.groupby("id").value.sum().items():
        assert abs(s - math.log(prob[i] / (1 - prob[i]))) < 1e-6


def test_scores_survive_a_failed_log_write(spark, tmp_path):
    src = X.scratch(spark, "t-x1")
    spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, v double").write.parquet(src)
    stream = spark.readStream.schema("id long, v double").parquet(src)
    blocked = tmp_path / "log"
    blocked.write_text("a file stands where the log folder should be")
    scores, status = X.scratch(spark, "t-scores"), X.scratch(spark, "t-status")
    X.score_stream(stream, lambda b: (b.filter("id % 5 <> 0"), b.filter("id % 5 = 0")), lambda v: v.selectExpr("id", "v / 20 as p"),
                   scores, str(blocked), X.scratch(spark, "t-q"), status, X.scratch(spark, "t-ck3"))
    assert sorted(r.id for r in spark.read.parquet(scores).collect()) == [i for i in range(20) if i % 5]
    assert [r.log_written for r in spark.read.parquet(status).collect()] == [False]


def test_stored_table_follows_its_inputs_and_rewrites_half_written_folders(spark, tmp_path):
    import shutil

    from riskframe.sources import io as IO

    src, built = tmp_path / "in.parquet", []

    def build():
        built.append(1)
        return spark.read.parquet(str(src))

    spark.range(5).write.parquet(str(src))
    name = f"t{tmp_path.name}"
    assert IO.stored_table(spark, name, [str(src)], build).count() == 5 and IO.stored_table(spark, name, [str(src)], build).count() == 5
    assert len(built) == 1
    shutil.rmtree(src)
    spark.range(9).write.parquet(str(src))
    assert IO.stored_table(spark, name, [str(src)], build).count() == 9 and len(built) == 2
    path = next(p for _, p in IO._READERS if name in p and IO.input_fingerprint(spark, [str(src)]) in p)
    fs, marker = IO._file_system(spark, f"{path}/_SUCCESS")
    fs.delete(marker, False)
    IO._READERS.clear()
    assert IO.stored_table(spark, name, [str(src)], build).count() == 9 and len(built) == 3


def test_checkpoint_folder_is_required(spark, monkeypatch):
    import pytest

    from riskframe import session

    class Bare:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Bare)


def test_csv_null_tokens_of_pandas(spark, tmp_path):
    from riskframe.sources import io as IO

    f = tmp_path / "x.csv"
    f.write_text("a,b\nNaN,1\n#N/A,nan\nn/a,2\nkept,\"1,000\"\n")
    rows = IO.read_loans_csv(spark, str(f), ["a", "b"], numeric=["b"]).collect()
    assert [(r.a, r.b) for r in rows] == [(None, 1.0), (None, None), (None, 2.0), ("kept", 1000.0)]


def test_constant_columns_in_density_and_kde(spark):
    import numpy as np

    from riskframe.operators import profile as A

    df = spark.createDataFrame([(3.0,)] * 8, "x double")
    hist = A.density_hist(df, "x", 4).orderBy("bin").collect()
    want, edges = np.histogram([3.0] * 8, 4, density=True)
    assert [r.density for r in hist] == want.tolist() and [r.lower for r in hist] == edges[:-1].tolist()
    assert {r.density for r in A.kde(df, "x", 5).collect()} == {None}
