"""Experiment runs and model registry as tables.

A run is a row (run_name, params map, metrics map, tags map); the long form
(run_name, key, value) is what queries filter and pivot. Registry entries are
rows (name, version, path, alias); the model itself is a saved ``PipelineModel``
at ``path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_metrics(evals: DataFrame, run_col: str, split_col: str, metrics) -> DataFrame:
    """Per-split metric columns -> long (run_name, key '{split}_{metric}', value); lower-case, '-' -> '_'."""
    long = evals.select(F.col(run_col).alias("run_name"), F.col(split_col).alias("__split"),
                        *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["run_name", "__split"], list(metrics), "__m", "value")
    key = F.regexp_replace(F.lower(F.concat(F.col("__split"), F.lit("_"), F.col("__m"))), "-", "_")
    return long.select("run_name", key.alias("key"), "value")


def runs_table(long: DataFrame, params: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """One row per run with MapType metrics (and params/tags when given as long (run_name, key, value))."""
    out = long.groupBy("run_name").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metrics"))
    for name, extra in (("params", params), ("tags", tags)):
        if extra is not None:
            m = extra.groupBy("run_name").agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("value").cast("string")))).alias(name))
            out = out.join(m, "run_name", "left")
    return out


def query_runs(long: DataFrame, metric: str) -> DataFrame:
    """Runs with ``metric`` > 0, best first."""
    return long.filter((F.col("key") == metric) & (F.col("value") > 0)).orderBy(F.desc("value"), "run_name")


def compare_runs(long: DataFrame, a: str, b: str) -> DataFrame:
    """Side-by-side metrics of two runs with the difference (b - a)."""
    left = long.filter(F.col("run_name") == a).select("key", F.col("value").alias("value_a"))
    right = long.filter(F.col("run_name") == b).select("key", F.col("value").alias("value_b"))
    return left.join(right, "key", "full_outer").withColumn("delta", F.col("value_b") - F.col("value_a"))


def compare_models(long: DataFrame, runs, baseline: str) -> DataFrame:
    """Metric table pivoted by run with lift over a baseline run."""
    piv = long.groupBy("key").pivot("run_name", list(runs)).agg(F.first("value"))
    return piv.withColumns({f"lift_{r}": F.col(r) - F.col(baseline) for r in runs if r != baseline})


def metrics_to_json(evals: DataFrame, key_cols, metric_cols) -> DataFrame:
    """Each evaluation row as a JSON document (numbers kept numeric)."""
    return evals.select(*key_cols, F.to_json(F.struct(*[F.col(c) for c in metric_cols])).alias("document"))


def register_models(entries: DataFrame) -> DataFrame:
    """Registry rows (name, path, metric) -> versions numbered per name in registration order."""
    from pyspark.sql import Window

    w = Window.partitionBy("name").orderBy("registered_at", "path")
    return entries.withColumn("version", F.row_number().over(w))


def promote(registry: DataFrame, metric: str = "metric", alias: str = "champion") -> DataFrame:
    """Alias the best version of each model name (max_by over the metric, latest version on ties)."""
    best = registry.groupBy("name").agg(F.max_by("version", F.struct(F.col(metric), F.col("version"))).alias("__best"))
    return registry.join(best, "name").withColumn(
        "alias", F.when(F.col("version") == F.col("__best"), F.lit(alias))).drop("__best")


def resolve_model(registry: DataFrame, name: str, alias: str = "champion") -> DataFrame:
    """The registry row for (name, alias); load with ``PipelineModel.load(row.path)``."""
    return registry.filter((F.col("name") == name) & (F.col("alias") == alias))
