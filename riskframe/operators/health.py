"""Prediction-log health and traffic (H1-H9, O2, O3).

``as_of`` is always an explicit parameter (the dashboard used the wall clock).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from riskframe import specs
from riskframe.functions.exprs import ts_lit
from riskframe.operators import prep
from riskframe.operators.duplicates import repeated_rows


def null_rates(df: DataFrame, cols=None) -> DataFrame:
    """H1: share of NULL per nullable column (one aggregate)."""
    cols = [c for c in (cols or specs.NULLABLE_NUMERIC_COLS) if c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(c)).alias(c) for c in cols])
    return wide.unpivot(["__n"], cols, "column", "__nn").select(
        "column", (F.lit(1.0) - F.col("__nn") / F.col("__n")).alias("null_rate"))


def rare_categories(df: DataFrame, cols, max_n: int = specs.SINGLETON_COUNT_THRESHOLD) -> DataFrame:
    """H2: (feature, category, count) for non-null categories with at most ``max_n`` rows."""
    cols = [c for c in cols if c in df.columns]
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "feature", "category")
    counts = long.filter(F.col("category").isNotNull()).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") <= max_n)


def payload_columns(df: DataFrame, exclude=None) -> list[str]:
    ex = set(exclude or specs.DUPLICATE_EXCLUDED)
    return [f.name for f in df.schema.fields if f.name not in ex and not isinstance(f.dataType, MapType)]


def duplicate_payloads(df: DataFrame, exclude=None) -> DataFrame:
    """H3: number of duplicated payload groups and extra rows (NULLs compare equal); digests are shuffled, not payloads."""
    groups = repeated_rows(df, payload_columns(df, exclude))
    return groups.agg(
        F.count(F.lit(1)).cast("bigint").alias("duplicate_payload_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_payload_extra_rows"),
    )


def shared_timestamps(df: DataFrame, ts: str = "logged_at") -> DataFrame:
    """H4: rows whose timestamp is shared with at least one other row."""
    g = df.groupBy(ts).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("duplicate_logged_at_count"))


def burst_ratio(df: DataFrame, ts: str = "logged_at", threshold: float = 0.5) -> DataFrame:
    """H6: distinct active hours over span hours (floor((max-min)/1h)+1); scripted traffic below the threshold."""
    span_micros = F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))
    agg = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.date_trunc("hour", F.col(ts))).cast("bigint").alias("distinct_hours"),
        (F.floor(span_micros / F.lit(3_600_000_000)) + 1).cast("bigint").alias("span_hours"),
    )
    ratio = F.col("distinct_hours") / F.col("span_hours")
    return agg.select("distinct_hours", "span_hours", ratio.alias("active_ratio"),
                      F.coalesce((F.col("n") > 0) & (ratio < F.lit(threshold)), F.lit(False)).alias("scripted_traffic"))


def data_health(df: DataFrame, categorical, ts: str = "logged_at", exclude=None, max_n: int = specs.SINGLETON_COUNT_THRESHOLD,
                limit: int = specs.OUTLIER_LIST_LIMIT, threshold: float = 0.5) -> DataFrame:
    """H7: one-row health document (scalar parts); lists (H1, H2, H5) are their own frames.

    Every row gives one cell per thing counted (its time, its hour, its categories, the rules it breaks); one aggregate
    counts equal cells and a second sums them up. Only repeated payloads are a frame of their own (H3).
    """
    t = F.col(ts).cast("timestamp")
    cells = [("row", F.lit("")), ("time", F.coalesce(F.unix_micros(t).cast("string"), F.lit(""))), ("hour", F.date_trunc("hour", t).cast("string"))]
    cells += [("category " + c, F.col(c).cast("string")) for c in categorical if c in df.columns]
    cells += [("outlier " + c, F.when(F.col(c).cast("double") > F.lit(float(b)), F.lit(""))) for c, b in specs.OUTLIER_RULES.items() if c in df.columns]
    each = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in cells]))).filter(F.col("value").isNotNull())
    counts = each.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind: F.col("kind") == F.lit(kind)
    total = lambda cond, n: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")
    micros = F.when(of("time"), F.col("value").try_cast("long"))
    one = counts.agg(
        total(of("row"), F.col("n")).alias("n_rows"),
        total(of("time") & (F.col("n") > 1), F.col("n")).alias("duplicate_logged_at_count"),
        F.count_if(of("hour")).cast("bigint").alias("distinct_hours"),
        (F.floor((F.max(micros) - F.min(micros)) / F.lit(3_600_000_000)) + 1).cast("bigint").alias("span_hours"),
        F.count_if(F.col("kind").startswith("category ") & (F.col("n") <= max_n)).cast("bigint").alias("n_rare_categories"),
        total(F.col("kind").startswith("outlier "), F.least(F.col("n"), F.lit(limit))).alias("n_outliers_listed"),
    )
    dup = duplicate_payloads(df, exclude).select(F.struct("duplicate_payload_groups", "duplicate_payload_extra_rows")).scalar()
    scripted = (F.col("n_rows") > 0) & (F.col("distinct_hours") / F.col("span_hours") < F.lit(threshold))
    return one.withColumn("__dup", dup).select(
        "n_rows", "__dup.duplicate_payload_groups", "__dup.duplicate_payload_extra_rows", "duplicate_logged_at_count", "distinct_hours", "span_hours",
        F.coalesce(scripted, F.lit(False)).alias("scripted_traffic"), "n_rare_categories", "n_outliers_listed")


def hour_spine(spark, start: Column, end: Column) -> DataFrame:
    """One row per hour from start to end inclusive."""
    return spark.range(1).select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))).alias("hour_start"))


def hourly_traffic(df: DataFrame, as_of, hours: int = 48, ts: str = "logged_at") -> tuple[DataFrame, DataFrame]:
    """H8 + J8: gap-filled hourly counts for the last ``hours`` hours and the burst flag.

    Rows count when ``start <= ts <= now + 1h``; the spine keeps hours start..now.
    """
    now = F.date_trunc("hour", ts_lit(as_of)).cast("timestamp_ntz")
    start = now - F.make_dt_interval(hours=F.lit(hours - 1))
    t = F.col(ts).cast("timestamp_ntz")
    inwin = df.filter((t >= start) & (t <= now + F.expr("INTERVAL 1 HOUR")))
    counts = inwin.groupBy(F.date_trunc("hour", t).cast("timestamp_ntz").alias("hour_start")).agg(F.count(F.lit(1)).alias("n"))
    spine = hour_spine(df.sparkSession, start, now)
    buckets = spine.join(counts, "hour_start", "left").select("hour_start", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))
    flag = buckets.agg(
        F.count(F.lit(1)).alias("n_hours"),
        F.count_if(F.col("count") > 0).cast("bigint").alias("nonzero_hours"),
    ).withColumn("is_bursty", (F.col("n_hours") > 0) & (F.col("nonzero_hours") / F.col("n_hours") < F.lit(0.3)))
    return buckets, flag


def page(df: DataFrame, offset: int = 0, limit: int = 50, ts: str = "logged_at", key: str = "request_id") -> DataFrame:
    """O2/H9: newest first, ``offset``/``limit`` (1..200), with the total before paging on every row.

    Ties on the timestamp are broken by the key so pages are stable. The total
    is a scalar subquery; the sort is a distributed top-k (offset+limit rows per partition).
    """
    limit = max(1, min(200, int(limit)))
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).offset(int(offset)).limit(limit).withColumn("total", total)


def list_predictions(df: DataFrame, offset: int = 0, limit: int = 50, **criteria) -> DataFrame:
    """H9: P14 filters then O2 paging."""
    return page(prep.filter_log(df, **criteria), offset, limit)


def latest(df: DataFrame, ts: str = "logged_at", key: str = "request_id") -> DataFrame:
    """O3: the newest record (max_by over a struct: one pass, no sort)."""
    cols = df.columns
    best = df.agg(F.max_by(F.struct(*cols), F.struct(F.col(ts), F.col(key))).alias("r"))
    return best.select("r.*")
