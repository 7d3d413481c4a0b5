"""Shared helpers of the training-data operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ship_by_value(module: str) -> None:
    """Pickle the functions of ``module`` by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship_by_value(__name__)


def give_back() -> None:
    """At the end of a task: return freed memory to the system, as a Python worker lives on and serves later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it frees by itself or not at all
        pass


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let Arrow batches hold at most ``most`` bytes in this session, so that long texts do not add up in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def id_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (NULL for a NULL id)."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """True for ids kept out of training; a NULL id is never held out."""
    return F.coalesce(id_remainder(id_col, modulus) == F.lit(remainder), F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def labelled_sample(labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id", max_per_label: int = 2500) -> DataFrame:
    """(id, y): at most ``max_per_label`` usable ids of each class, chosen by a hash of the id.

    Several labels of one id are averaged and rounded (a tie counts as 1). Ranks are taken in 32 hash buckets first.
    """
    one = labels.filter(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        (F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    one = one.withColumn("h", F.xxhash64("id")).withColumn("b", F.pmod("h", F.lit(32)))
    first = one.withColumn("r", F.row_number().over(Window.partitionBy("y", "b").orderBy("h", "id"))).filter(F.col("r") <= max_per_label)
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "id"))).filter(F.col("r") <= max_per_label)
    return top.select("id", "y")
