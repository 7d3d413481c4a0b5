"""Maintained drift state: a stored reference profile and mergeable bucket counts per day.

Bucket counts against fixed edges are sums, so the drift of a log that grows is kept by adding the counts of each new
batch; nothing that was counted is read again. The state is a folder in the shared store:

* ``profile``: the fitted reference (edges and bucket counts), written once;
* ``counts/batch_id=<n>``: (day, feature, kind, value, n) of one batch, replaced as a whole when the batch is repeated;
* ``base/upto=<n>``: the sums of all batches up to n, written by ``compact``.

A folder counts only when Spark's success marker is in it, so a broken write is not read and is replaced by its retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators import drift as D
from riskframe.sources.io import finished_parts, is_complete

COUNTS = "day date, feature string, kind int, value string, n long"


class DriftState:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._profile: D.Profile | None = None

    def fit(self, reference: DataFrame | D.Profile, numeric=(), categorical=(), bins: int = 10, exact: bool = True) -> DriftState:
        """Store the reference profile, unless it already is."""
        if not is_complete(self.spark, f"{self.path}/profile"):
            profile = reference if isinstance(reference, D.Profile) else D.fit_profile(reference, numeric, categorical, bins, exact)
            profile.table().write.mode("overwrite").parquet(f"{self.path}/profile")
        return self

    @property
    def profile(self) -> D.Profile:
        if self._profile is None:
            self._profile = D.Profile.from_table(self.spark.read.parquet(f"{self.path}/profile"))
        return self._profile

    def merge(self, batch: DataFrame, batch_id: int, day: Column) -> None:
        """Add a batch's bucket counts, one pass over the batch; the same batch id again replaces its counts."""
        upto, _ = self._newest()
        if batch_id <= upto:
            return  # already in the compacted sums
        counts = self.profile.counts(batch.withColumn("__day", day.cast("date")), ["__day"])
        counts.select(F.col("__day").alias("day"), "feature", F.col("kind").cast("int").alias("kind"), "value", "n") \
            .write.mode("overwrite").parquet(f"{self.path}/counts/batch_id={batch_id}")

    def _newest(self) -> tuple[int, str | None]:
        bases = finished_parts(self.spark, f"{self.path}/base", "upto")
        return max(bases.items(), default=(-1, None))

    def counts(self) -> DataFrame:
        """(day, feature, kind, value, n) of everything merged so far."""
        upto, base = self._newest()
        parts = [p for k, p in sorted(finished_parts(self.spark, f"{self.path}/counts", "batch_id").items()) if k > upto]
        paths = ([base] if base else []) + parts
        if not paths:
            return self.spark.createDataFrame([], COUNTS)
        rows = self.spark.read.schema(COUNTS).parquet(*paths)
        return rows.groupBy("day", "feature", "kind", "value").agg(F.sum("n").alias("n"))

    def compact(self) -> int:
        """Write the sums of all merged batches as one table; returns the last batch id in it (-1 for none)."""
        upto, _ = self._newest()
        last = max([upto, *finished_parts(self.spark, f"{self.path}/counts", "batch_id")])
        if last > upto:
            self.counts().write.mode("overwrite").parquet(f"{self.path}/base/upto={last}")
        return last

    def report(self, label: str = "live") -> DataFrame:
        """(feature, PSI, drift_level, target_label) of everything merged so far, from the sums alone."""
        whole = self.counts().groupBy("feature", "kind", "value").agg(F.sum("n").alias("n")).withColumn("target_label", F.lit(label))
        return D.report_of_counts(self.profile, whole)

    def daily_reports(self) -> DataFrame:
        """(feature, PSI, drift_level, day), one population per day."""
        return D.report_of_counts(self.profile, self.counts(), "day")
