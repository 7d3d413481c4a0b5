"""Structured Streaming jobs.

Sources are file streams (Parquet) read with an explicit schema. Stateful
operators bound their state with watermarks and run in append mode: a window,
session or remembered key leaves the state when the watermark passes it. Rows
later than that are not lost in the operator: ``split_late`` parts them off
before, into a table of their own. Results leave through
``foreachBatch`` sinks that are idempotent per batch id (each batch writes its
own ``batch_id=`` partition with overwrite, so a retried batch replaces itself),
and every stream keeps its offsets in a checkpoint location under the shared
checkpoint folder, so a restarted job resumes exactly where it stopped.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.operators.binning import equal_width_left_closed
from riskframe.operators.drift_state import DriftState
from riskframe.session import checkpoint_dir
from riskframe.sources.io import finished_parts


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/riskframe-streams/{name}-{uuid.uuid4().hex[:12]}"


def stage_event_files(spark: SparkSession, events: DataFrame, out: str, n_files: int = 6, ts: str = "ts",
                      key: str = "event_id", files_per_drop: int | None = None) -> str:
    """Write ``events`` as ``n_files`` Parquet drops in time order, with every key % 50 == 0
    written a second time in the next drop and every key % 97 == 0 held back to the last drop.

    Drops are equal-width time slices (no global ordering window); each drop is
    its own folder ``drop=i``, written by all tasks that hold rows of it, one
    drop after the other, so that file times follow the drop order. With
    ``files_per_drop`` a drop has so many files, so a trigger of as many reads one drop.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    lo, hi = events.agg(F.min(t)).scalar(), events.agg(F.max(t)).scalar()
    sl = F.least(F.floor((t - lo) / (hi - lo + F.lit(1.0)) * F.lit(float(n_files))).cast("int"), F.lit(n_files - 1))
    q = events.withColumn("__slice", sl)
    late = F.col(key) % 97 == 0
    for i in range(n_files):
        part = q.filter(((F.col("__slice") == i) & ~late) | (F.lit(i == n_files - 1) & late))
        # the copy of drop i-1 arrives with drop i; the last drop also carries its own copies
        src_slices = [i - 1] if i < n_files - 1 else [i - 1, i]
        dup = q.filter(F.col("__slice").isin(src_slices) & (F.col(key) % 50 == 0) & ~late) if i > 0 else None
        drop = part if dup is None else part.unionByName(dup)
        drop = drop.repartition(files_per_drop) if files_per_drop else drop
        drop.drop("__slice").withColumn("drop", F.lit(i)).write.mode("append").partitionBy("drop").parquet(out)
    return out


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, event_time: str | None = None) -> DataFrame:
    """File stream; ``event_time`` (a wall-clock TIMESTAMP_NTZ column) becomes a TIMESTAMP for watermarks."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumn(event_time, F.col(event_time).cast("timestamp")) if event_time else df


def files_per_trigger(files: int, triggers: int) -> int:
    """Files that a trigger reads, so that ``files`` take at most ``triggers`` batches: a batch's fixed cost is not paid per file."""
    return max(1, -(-files // triggers))


def wall_clock(df: DataFrame, *cols: str) -> DataFrame:
    """Window bounds back to wall-clock TIMESTAMP_NTZ (the inverse of the cast in ``read_stream``)."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def _batch_sink(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return write


def run_available(df: DataFrame, out: str, ckpt: str, mode: str = "append", sink=None) -> list[dict]:
    """Process everything available now and stop (the bounded form of a continuous job); returns the progress reports kept."""
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
         .foreachBatch(sink or _batch_sink(out)).trigger(availableNow=True).start())
    q.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress]


def split_late(src: DataFrame, ts: str, delay: str, on_time_path: str, late_path: str, marks_path: str, ckpt: str) -> None:
    """Part rows that come later than ``delay`` behind the newest event of all earlier batches from those that are on time.

    Both go to tables of one folder per batch, with the batch id; ``marks_path`` keeps the newest event time after each
    batch (one row), which is all that the next one needs. A row whose time is NULL is late. A repeated batch replaces its folders.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = finished_parts(spark, marks_path, "batch_id").get(batch_id - 1)
        newest = spark.read.parquet(before).first()["newest"] if before else None
        batch.persist()  # read once for both parts and the mark
        try:
            edge = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
            late = F.col(ts).isNull() | F.coalesce(F.col(ts) < edge, F.lit(False))
            batch.filter(~late).write.mode("overwrite").parquet(f"{on_time_path}/batch_id={batch_id}")
            batch.filter(late).write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
            mark = batch.agg(F.greatest(F.max(F.col(ts).cast("timestamp")), F.lit(newest).cast("timestamp")).alias("newest"))
            mark.write.mode("overwrite").parquet(f"{marks_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    src.writeStream.option("checkpointLocation", ckpt).foreachBatch(handle).trigger(availableNow=True).start().awaitTermination()


def last_batch(spark: SparkSession, out: str) -> DataFrame:
    """Read a complete-mode sink: the whole result as of the newest batch (partition pruned)."""
    df = spark.read.parquet(out)
    return df.filter(F.col("batch_id") == df.agg(F.max("batch_id")).scalar()).drop("batch_id")


def latest_per_key(spark: SparkSession, out: str, keys) -> DataFrame:
    """Read an update-mode sink: the newest version of each key (max batch id)."""
    df = spark.read.parquet(out)
    w = Window.partitionBy(*keys)
    return df.withColumn("__last", F.max("batch_id").over(w)).filter(F.col("batch_id") == F.col("__last")).drop("__last", "batch_id")


# ------------------------------------------------------------------ X2 / X6


def hourly_counts(src: DataFrame, ts: str = "logged_at", delay: str = "1 hour") -> DataFrame:
    """Requests per hour with late data accepted up to ``delay`` behind the newest event."""
    return src.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("count")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count")


def sliding_counts(src: DataFrame, ts: str = "logged_at", size: str = "1 hour", slide: str = "15 minutes",
                   delay: str = "1 hour") -> DataFrame:
    """Overlapping windows for burst detection."""
    return src.withWatermark(ts, delay).groupBy(F.window(ts, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("count")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count")


def sessions(src: DataFrame, key: str, ts: str = "logged_at", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per key (a new session after ``gap`` without events)."""
    return src.withWatermark(ts, delay).groupBy(F.col(key), F.session_window(ts, gap).alias("s")).agg(
        F.count(F.lit(1)).alias("count")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "count")


# ------------------------------------------------------------------ X3


def dedupe(src: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """First occurrence of each key; state kept only while within the watermark delay."""
    return src.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


# ------------------------------------------------------------------ X5


def running_scores(src: DataFrame, prob: str = "prob", bins: int = 30, threshold: float = 0.16) -> DataFrame:
    """Running score histogram and decision counts (complete mode; state = bins rows)."""
    b = equal_width_left_closed(F.col(prob).cast("double"), F.lit(0.0), F.lit(1.0), bins)
    return src.filter(F.col(prob).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(prob) >= F.lit(threshold)).cast("bigint").alias("n_pred_1"))


# ------------------------------------------------------------------ X1 / X4


def score_stream(src: DataFrame, validate, score, scores_path: str, log_path: str, quarantine_path: str, status_path: str,
                 ckpt: str) -> None:
    """Requests -> validation -> scoring -> scores, then the log; a failed log write never loses a score.

    ``validate(batch) -> (valid, bad)`` and ``score(valid) -> scored`` are batch
    functions applied to each micro-batch. Scores and quarantined requests are
    written first, and a failure there stops the batch, which is then retried.
    The log is written from the stored scores; its failure is recorded in the
    status table, and the batch can be logged again from ``scores_path``.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        at = f"batch_id={batch_id}"
        batch.persist()  # read once for the valid and the rejected part
        try:
            valid, bad = validate(batch)
            score(valid).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{scores_path}/{at}")
            bad.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{quarantine_path}/{at}")
        finally:
            batch.unpersist()
        ok = True
        try:
            batch.sparkSession.read.parquet(f"{scores_path}/{at}").write.mode("overwrite").parquet(f"{log_path}/{at}")
        except Exception:  # noqa: BLE001 - logging must not fail scoring
            ok = False
        batch.sparkSession.createDataFrame([(batch_id, ok)], "batch_id long, log_written boolean").write.mode("overwrite").parquet(
            f"{status_path}/batch_id={batch_id}")

    q = src.writeStream.option("checkpointLocation", ckpt).foreachBatch(handle).trigger(availableNow=True).start()
    q.awaitTermination()


def snapshot_stream(src: DataFrame, state: DriftState, log_path: str, snapshots_path: str, ckpt: str, ts: str = "logged_at",
                    every: str | None = None, compact_every: int = 24) -> None:
    """Each trigger adds the micro-batch to the log table and to the drift state, then writes a snapshot of the drift so far.

    Only the micro-batch is read: the report comes from the state's sums, which every ``compact_every`` batches become
    one table. ``every`` sets a processing-time trigger (e.g. "60 minutes"); without it all available input is processed
    now and the stream stops. A repeated batch replaces its log part, its counts and its snapshot.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        part = f"{log_path}/batch_id={batch_id}"
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(part)
        state.merge(batch.sparkSession.read.parquet(part), batch_id, F.col(ts))
        rep = state.report()
        rep.withColumns({"computed_at": F.current_timestamp(), "batch_id": F.lit(batch_id)}).write.mode("overwrite").parquet(
            f"{snapshots_path}/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            state.compact()

    w = src.writeStream.option("checkpointLocation", ckpt).foreachBatch(handle)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    q = w.start()
    if not every:
        q.awaitTermination()
