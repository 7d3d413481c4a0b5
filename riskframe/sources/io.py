"""Sources and sinks.

Readers return lazy DataFrames; writers are the only actions. Tables that
several jobs share are written once to the shared checkpoint folder
(``spark.checkpoint.dir``), never to a machine-local folder.
"""

from __future__ import annotations

import hashlib
import re
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from riskframe import specs
from riskframe.functions.exprs import parse_month, ts_lit
from riskframe.session import checkpoint_dir


_READERS: dict[tuple[str, str], DataFrame] = {}
_BUILD_LOCK = threading.RLock()  # a build may itself read a stored table


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, whatever store the path is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def input_fingerprint(spark: SparkSession, paths) -> str:
    """Digest of the names, sizes and modification times of all files under ``paths``."""
    seen = []
    for path in paths:
        fs, p = _file_system(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` ended: Spark leaves ``_SUCCESS`` as its last step."""
    fs, p = _file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def finished_parts(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """{n: folder} of the complete folders ``<name>=<n>`` under ``path``; a missing ``path`` has none."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return {}
    found = {}
    for f in fs.listStatus(p):
        key, _, n = f.getPath().getName().partition("=")
        if key == name and is_complete(spark, f"{path}/{key}={n}"):
            found[int(n)] = f"{path}/{key}={n}"
    return found


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder this program wrote, in whatever store it is."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def stored_table(spark: SparkSession, name: str, inputs, build: Callable[[], DataFrame],
                 partition_by=None) -> DataFrame:
    """Read ``name``, built from the files under ``inputs``, from the shared checkpoint folder.

    The folder's name holds a fingerprint of the input files, so changed inputs
    build a new table; a folder without a success marker is written again. The
    reader (file listing, partition discovery) is kept per application.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/riskframe-tables/{name}-{input_fingerprint(spark, inputs)}"
    memo = (spark.sparkContext.applicationId, path)
    with _BUILD_LOCK:  # concurrent first uses in one process build the table once
        if memo in _READERS:
            return _READERS[memo]
        if not is_complete(spark, path):
            w = build().write.mode("overwrite")
            if partition_by:
                w = w.partitionBy(*partition_by)
            w.parquet(path)
        _READERS[memo] = spark.read.parquet(path)
        return _READERS[memo]


# ----------------------------------------------------------------- S1 / S2


def read_loans_csv(spark: SparkSession, path: str, columns, numeric=(), dates=(), null_tokens=None,
                   encoding: str = "ISO-8859-1", quoted_newlines: bool = False) -> DataFrame:
    """Raw loan CSV with an explicit all-string schema, then typed.

    Null tokens are mapped to NULL on trimmed text, thousands separators are
    removed before ``try_cast`` (bad numbers become NULL), ``MMM-yyyy`` dates are
    parsed and rows with an unparseable date are dropped (S2). Files are split
    over tasks; only with ``quoted_newlines`` is a file read whole by one task.
    """
    tokens = list(null_tokens if null_tokens is not None else specs.NULL_TOKENS)
    schema = StructType([StructField(c, StringType(), True) for c in columns])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", quoted_newlines)
        .csv(path)
    )
    cleaned = raw.select(*[F.when(F.trim(F.col(c)).isin(tokens) | F.col(c).isNull(), F.lit(None)).otherwise(F.col(c)).alias(c)
                           for c in columns])
    typed = cleaned.withColumns({c: F.regexp_replace(F.col(c), ",", "").try_cast("double") for c in numeric})
    return parse_month_dates(typed, dates)


def parse_month_dates(df: DataFrame, cols, drop_bad: bool = True) -> DataFrame:
    """``MMM-yyyy`` text -> timestamp; rows with any unparseable date dropped."""
    out = df.withColumns({c: parse_month(F.col(c)) for c in cols})
    return out.dropna(subset=list(cols)) if (drop_bad and cols) else out


# ----------------------------------------------------------------- S3 - S6


def write_checked(df: DataFrame, path: str, metrics: dict[str, Column], partition_by=None) -> dict[str, object]:
    """Write ``df`` as Parquet and return aggregates over the written rows, both in one pass (Spark's ``observe``).

    The write runs in a session of its own, with the same settings: a session that has observed something can no longer be
    sent along with an ML model's training summary, and learners use the caller's session.
    """
    spark, view = df.sparkSession, f"observed_{uuid.uuid4().hex}"
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            other.conf.set(key, value)
    df.createGlobalTempView(view)
    try:
        seen = Observation()
        w = other.table(f"global_temp.{view}").observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.mode("overwrite")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        return seen.get
    finally:
        spark.catalog.dropGlobalTempView(view)


def split_metrics(splits, split: str, target: str, checks: dict[str, Column] | None = None) -> dict[str, Column]:
    """Aggregates of a build: rows, positives per split, all rows, and the violations of each check (a condition that must hold)."""
    out = {"rows": F.count(F.lit(1))}
    for s in splits:
        inside = F.col(split) == F.lit(s)
        out[f"rows {s}"] = F.count_if(inside)
        out[f"bad {s}"] = F.sum(F.when(inside, F.col(target).cast("double")))
        out[f"known {s}"] = F.count_if(inside & F.col(target).isNotNull())
    for name, holds in (checks or {}).items():
        out[f"check {name}"] = F.count_if(~F.coalesce(holds, F.lit(False)))
    return out


class BuildRejected(ValueError):
    """A build's rows break its checks; nothing was published."""


def write_splits(df: DataFrame, path: str, split: str = "split", target: str = "target", splits=("train", "val", "test"),
                 checks: dict[str, Column] | None = None) -> DataFrame:
    """S3: publish one Parquet table partitioned by split, plus a receipt (rows and default rate per split), as a new version.

    The receipt and the checks are observed while the table is written, so the build is one pass. A row outside ``splits``
    or a row that breaks a check rejects the build: the version is not published and readers keep the last one.
    Returns the receipt frame (already written as JSON next to the table).
    """
    from riskframe.sources.versions import folder_of, publish

    spark = df.sparkSession

    def write(folder: str) -> None:
        got = write_checked(df, f"{folder}/splits", split_metrics(splits, split, target, checks), split)
        broken = {n.removeprefix("check "): v for n, v in got.items() if n.startswith("check ") and v}
        if got["rows"] != sum(got[f"rows {s}"] for s in splits):
            broken["rows outside the splits"] = got["rows"] - sum(got[f"rows {s}"] for s in splits)
        if broken:
            raise BuildRejected(str(broken))
        rows = [(s, got[f"rows {s}"], got[f"bad {s}"] / got[f"known {s}"] if got[f"known {s}"] else None) for s in splits if got[f"rows {s}"]]
        spark.createDataFrame(rows, f"{split} string, rows long, default_rate double").coalesce(1).write.json(f"{folder}/receipt")

    return spark.read.json(f"{folder_of(spark, path, publish(spark, path, write))}/receipt")


def outputs_exist(spark: SparkSession, outputs: dict[str, str]) -> bool:
    """True only if every output (path -> format) was written to its end and can be opened."""
    for path, fmt in outputs.items():
        try:
            if not is_complete(spark, path):
                return False
            spark.read.format(fmt).load(path).schema  # noqa: B018
        except AnalysisException:
            return False
    return True


def build_dataset(spark: SparkSession, build: Callable[[], DataFrame], path: str, force_rebuild: bool = False, checks: dict[str, Column] | None = None):
    """S3 + S4: skip the build when a version is published and whole, unless forced."""
    from riskframe.sources.versions import current

    folder = current(spark, path)
    if force_rebuild or folder is None or not outputs_exist(spark, {f"{folder}/splits": "parquet", f"{folder}/receipt": "json"}):
        write_splits(build(), path, checks=checks)
    return load_splits(spark, path)


def load_splits(spark: SparkSession, path: str, split: str = "split", version: int | None = None):
    """(train, val, test, receipt) of a published version, the newest by default; raises if there is none."""
    from riskframe.sources.versions import folder_of

    folder = folder_of(spark, path, version)
    t = spark.read.parquet(f"{folder}/splits")
    receipt = spark.read.json(f"{folder}/receipt")
    return (t.filter(F.col(split) == "train"), t.filter(F.col(split) == "val"), t.filter(F.col(split) == "test"), receipt)


def write_features(matrix: DataFrame, stats: DataFrame, path: str, partition_by: str | None = "split") -> int:
    """Feature matrix and fitted stats table, published together; returns the version."""
    from riskframe.sources.versions import publish

    def write(folder: str) -> None:
        w = matrix.write
        (w.partitionBy(partition_by) if partition_by else w).parquet(f"{folder}/matrix")
        stats.write.parquet(f"{folder}/stats")

    return publish(matrix.sparkSession, path, write)


def load_features(spark: SparkSession, path: str, version: int | None = None):
    """(matrix, stats) of a published version, the newest by default."""
    from riskframe.sources.versions import folder_of

    folder = folder_of(spark, path, version)
    return spark.read.parquet(f"{folder}/matrix"), spark.read.parquet(f"{folder}/stats")


# ----------------------------------------------------------------- S7 - S11


def write_report_csv(report: DataFrame, path: str) -> None:
    """Drift report as one CSV file with header (the report is one row per feature and target)."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def load_prediction_log(df: DataFrame, nullable_cols=None, date_cols=("issue_d", "earliest_cr_line"),
                        target: str = "target") -> DataFrame:
    """Typed prediction log: NULL target placeholder, dates cast, nullable numerics coerced (bad -> NULL)."""
    cols = [c for c in (nullable_cols or specs.NULLABLE_NUMERIC_COLS) if c in df.columns]
    fixes: dict[str, Column] = {c: F.col(c).try_cast("double") for c in cols}
    fixes.update({c: F.col(c).try_cast("timestamp_ntz") for c in date_cols if c in df.columns})
    fixes[target] = F.lit(None).cast("int")
    return df.withColumns(fixes)


def append_run(df: DataFrame, path: str, run: str, partition_by: str) -> None:
    """Append rows under a run's key: the run's folder is written whole, so the same run again replaces its rows."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run):
        raise ValueError("a run's key is made of letters, digits, '.', '_' and '-'")
    df.write.mode("overwrite").partitionBy(partition_by).parquet(f"{path.rstrip('/')}/run={run}")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the runs whose write ended, without the run key; raises if there is none."""
    fs, p = _file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    whole = sorted(f"{path.rstrip('/')}/{n}" for n in names if n.startswith("run=") and is_complete(spark, f"{path.rstrip('/')}/{n}"))
    if not whole:
        raise FileNotFoundError(f"no finished run under {path}")
    return spark.read.option("basePath", path).parquet(*whole).drop("run")


def append_log(df: DataFrame, path: str, spec, run: str, partition: str = "log_date", ts: str = "logged_at") -> None:
    """Append records in the fixed column order of ``spec``, partitioned by log date, under the key of the run that logged them."""
    append_run(df.select(*spec).withColumn(partition, F.to_date(F.col(ts))), path, run, partition)


def append_snapshot(report: DataFrame, path: str, as_of, n_ref: Column, n_live: Column, run: str | None = None) -> None:
    """Append drift snapshot rows, partitioned by snapshot date; a run's key is its time unless given."""
    rows = report.select("feature", F.col("PSI").alias("psi"), "drift_level", F.col("target_label"),
                         n_ref.cast("bigint").alias("reference_size"), n_live.cast("bigint").alias("live_size"),
                         ts_lit(as_of).alias("computed_at")).withColumn("snapshot_date", F.to_date("computed_at"))
    append_run(rows, path, run or f"{as_of:%Y%m%dT%H%M%S}", "snapshot_date")


def load_reference(spark: SparkSession, path: str, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """The drift reference; the full table by default (no sampling needed on Spark)."""
    df = spark.read.parquet(path)
    return df.sample(fraction=fraction, seed=seed) if fraction else df
