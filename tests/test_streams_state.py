"""Bounded stream state, late rows as a side output, and the maintained drift state."""

import datetime as dt
import shutil

from pyspark.sql import functions as F

from riskframe.operators import drift as D
from riskframe.operators.drift_state import DriftState
from riskframe.streaming import jobs as X

START = dt.datetime(2024, 1, 1)


def drops(spark, name, parts):
    """One file per drop, in order; rows are (id, hours after the start)."""
    path = X.scratch(spark, name)
    for k, rows in enumerate(parts):
        data = [(i, None if h is None else START + dt.timedelta(hours=h)) for i, h in rows]
        spark.createDataFrame(data, "id long, ts timestamp").coalesce(1).write.parquet(f"{path}/drop={k}")
    return spark.readStream.schema("id long, ts timestamp, drop int").option("maxFilesPerTrigger", 1).parquet(path).drop("drop")


def split(spark, name, parts, delay="5 hours"):
    on_time, late, marks = (X.scratch(spark, f"{name}-{x}") for x in ("on", "late", "marks"))
    X.split_late(drops(spark, f"{name}-src", parts), "ts", delay, on_time, late, marks, X.scratch(spark, f"{name}-ck"))
    return on_time, late, marks


PARTS = [[(i, i) for i in range(0, 10)], [(10, 20), (11, 4.5), (12, 3.5)], [(13, 40), (14, 15), (15, 14.5), (16, None)], [(17, 36), (18, 60)]]


def test_late_rows_go_to_their_own_table(spark):
    on_time, late, marks = split(spark, "sl", PARTS)
    got = {r.id: r.batch_id for r in spark.read.parquet(late).collect()}
    assert got == {12: 1, 15: 2, 16: 2}
    assert {r.id for r in spark.read.parquet(on_time).collect()} == set(range(19)) - set(got)
    newest = {r.batch_id: r.newest for r in spark.read.parquet(marks).collect()}
    assert newest[3] == START + dt.timedelta(hours=60) and newest[0] == START + dt.timedelta(hours=9)


def test_state_falls_as_the_watermark_passes(spark):
    parts = [[(100 * d + h, 24 * d + h) for h in range(24)] for d in range(6)]
    on_time, _, _ = split(spark, "st", parts)
    src = spark.readStream.schema("id long, ts timestamp, batch_id int").option("maxFilesPerTrigger", 1).parquet(on_time)
    out = X.scratch(spark, "st-out")
    seen = X.run_available(X.hourly_counts(src, "ts", "5 hours"), out, X.scratch(spark, "st-ck2"))
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in seen if p.get("stateOperators")]
    assert max(rows) <= 24 + 6 and rows[-1] <= 6 < max(rows)  # one day's hours and the delay, of 144 hours; falls at the end
    closed = spark.read.parquet(out)
    assert closed.count() == 144 - rows[-1] and closed.agg(F.sum("count")).first()[0] == closed.count()
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in seen if p.get("stateOperators")) == 0


def test_dedupe_forgets_old_keys_and_loses_none(spark):
    parts = [[(i, 10 * d + i / 100) for i in range(100 * d, 100 * d + 100)] for d in range(4)]
    parts = [p + (parts[k - 1][-50:] if k else []) for k, p in enumerate(parts)]  # copies within the delay
    on_time, late, _ = split(spark, "dd", parts, "5 hours")
    src = spark.readStream.schema("id long, ts timestamp, batch_id int").option("maxFilesPerTrigger", 1).parquet(on_time)
    out = X.scratch(spark, "dd-out")
    seen = X.run_available(X.dedupe(src, "id", "ts", "5 hours").select("id"), out, X.scratch(spark, "dd-ck2"))
    ids = [r.id for r in spark.read.parquet(out).collect()]
    assert sorted(ids) == sorted({i for p in parts for i, _ in p} - {r.id for r in spark.read.parquet(late).collect()})
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in seen if p.get("stateOperators")]
    assert rows[-1] <= 200 and len(ids) == 400


def logs(spark, n, day0=0):
    return spark.range(n).select(F.col("id"), (F.col("id") % 13).cast("double").alias("x"), F.concat(F.lit("c"), F.col("id") % 4).alias("c"),
                                 F.expr(f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, {day0} + cast(id % 3 as int))").alias("logged_at"))


def rows_of(df):
    return sorted((r.feature, round(r.PSI, 12), r.drift_level) for r in df.collect())


def test_drift_state_equals_the_batch_report(spark):
    ref, a, b = logs(spark, 500), logs(spark, 200).withColumn("x", F.col("x") * 2), logs(spark, 300, 2).withColumn("c", F.lit("new"))
    state = DriftState(spark, X.scratch(spark, "ds")).fit(ref, ["x"], ["c"])
    assert state.report().count() == 0
    for k, part in enumerate((a, b)):
        state.merge(part, k, F.col("logged_at"))
        state.merge(part, k, F.col("logged_at"))  # the same batch again
    want = rows_of(D.drift_report(ref, a.unionByName(b), ["x"], ["c"], "live"))
    assert rows_of(state.report()) == want
    assert state.compact() == 1 and rows_of(state.report()) == want
    state.merge(a, 0, F.col("logged_at"))  # a batch that is in the sums already
    assert rows_of(state.report()) == want and state.compact() == 1
    whole = a.unionByName(b).withColumn("day", F.to_date("logged_at"))
    daily = D.drift_report_by(ref, whole, ["x"], ["c"], "day")
    key = lambda df: sorted((str(r.day), r.feature, round(r.PSI, 12)) for r in df.collect())
    assert key(state.daily_reports()) == key(daily)
    again = DriftState(spark, state.path).fit(a, ["x"], ["c"])  # a stored profile stays
    assert rows_of(again.report()) == want


def test_a_broken_count_folder_is_not_read(spark, tmp_path):
    state = DriftState(spark, str(tmp_path / "s")).fit(logs(spark, 100), ["x"], [])
    state.merge(logs(spark, 50), 0, F.col("logged_at"))
    want = rows_of(state.report())
    state.merge(logs(spark, 70), 1, F.col("logged_at"))
    (tmp_path / "s" / "counts" / "batch_id=1" / "_SUCCESS").unlink()
    assert rows_of(state.report()) == want


def test_snapshots_never_read_the_log_again(spark, tmp_path, monkeypatch):
    src = str(tmp_path / "src")
    for k in range(3):
        logs(spark, 100 * (k + 1)).coalesce(1).write.parquet(f"{src}/drop={k}")
    stream = spark.readStream.schema(logs(spark, 1).schema).option("maxFilesPerTrigger", 1).parquet(src)
    log, snaps = tmp_path / "log", str(tmp_path / "snaps")
    state = DriftState(spark, str(tmp_path / "state")).fit(logs(spark, 400).withColumn("x", F.col("x") + 1), ["x"], ["c"])
    real = state.report

    def report():
        for old in sorted(log.iterdir()):  # what was logged is gone when the report is made
            shutil.rmtree(old)
        return real()

    monkeypatch.setattr(state, "report", report)
    X.snapshot_stream(stream, state, str(log), snaps, str(tmp_path / "ck"), compact_every=2)
    s = spark.read.parquet(snaps)
    assert s.select("batch_id").distinct().count() == 3
    live = logs(spark, 100).unionByName(logs(spark, 200)).unionByName(logs(spark, 300))
    assert rows_of(s.filter("batch_id = 2")) == rows_of(D.drift_report(logs(spark, 400).withColumn("x", F.col("x") + 1), live, ["x"], ["c"], "live"))


def test_a_scoring_stream_of_many_files_takes_few_batches(spark, monkeypatch):
    from riskframe.plans import checks, streaming
    from riskframe.sources.io import finished_parts

    real, run, paths = checks.requests, X.score_stream, []
    monkeypatch.setattr(checks, "requests", lambda *a: real(*a).repartition(6))
    monkeypatch.setattr(X, "score_stream", lambda *a: (run(*a), paths.append(a[3])))
    out = streaming.q_x1(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and 1 < len(finished_parts(spark, paths[0], "batch_id")) <= 4  # of 24 files
