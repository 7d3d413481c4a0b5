"""Profiling aggregates.

Loops over columns become one ``unpivot`` followed by one ``groupBy``, so many
features cost one shuffle, not one job each. Percentiles are exact (linear
interpolation, fitted by ``windowing.fit_quantiles``) by default; ``exact=False``
gives the values of its mergeable sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.exprs import bracket as bracket_expr
from riskframe.functions.exprs import month_ordinal, round6, ts_lit
from riskframe.operators.binning import equal_width_left_closed, equal_width_right_closed, linspace_edge
from riskframe.operators.windowing import fit_quantiles, quantile_frame


def long_numeric(df: DataFrame, cols, ids=()) -> DataFrame:
    """(ids..., column, value double) rows for the given numeric columns."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(ids), list(cols), "column", "value")


def long_text(df: DataFrame, cols, ids=()) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(list(ids), list(cols), "column", "value")




def null_rates(df: DataFrame, cols=None) -> DataFrame:
    """A1/H1: percent of NULL per column, sorted descending; one aggregate pass."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(c)).alias(c) for c in cols])
    long = wide.unpivot(["__n"], cols, "column", "n_present")
    return long.select(
        "column",
        (F.lit(100.0) * (F.col("__n") - F.col("n_present")) / F.col("__n")).alias("null_pct"),
    ).orderBy(F.desc("null_pct"), "column")


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """A2: counts and shares of each value; total is a scalar subquery."""
    src = df.filter(F.col(col).isNotNull()) if dropna else df
    total = src.agg(F.count(F.lit(1))).scalar()
    return src.groupBy(col).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


def class_balance(df: DataFrame, target: str = "target", by: str | None = None) -> DataFrame:
    """A3: rows, positives and default rate, overall or per group."""
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(target)).cast("bigint").alias("n_bad"),
        round6(F.avg(F.col(target))).alias("default_rate"),
    ]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def rate_by(df: DataFrame, target: str, col: str) -> DataFrame:
    """A4: default rate (percent) and size by category, NULL group excluded, sorted by rate."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg((F.avg(F.col(target)) * F.lit(100.0)).alias("default_rate_pct"), F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("default_rate_pct"), col)
    )


def rate_by_month(df: DataFrame, target: str, date: str) -> DataFrame:
    """A5: default rate per calendar month."""
    return df.groupBy(F.trunc(F.col(date), "month").alias("month")).agg(
        F.avg(F.col(target)).alias("default_rate"), F.count(F.lit(1)).alias("n")
    )


def _cut_stats(df: DataFrame, col: str, keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))


def rate_histogram(df: DataFrame, target: str, col: str, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Category default rates cut into n equal-width right-closed bins.

    Returns (bin counts on the full 0..n-1 grid, long (bin, member) list). The
    member list stays long instead of one collected array per bin, so no bin is
    gathered into a single value however many categories fall in it.
    """
    rates = rate_by(df, target, col).select(col, "default_rate_pct")
    rng = rates.agg(F.min("default_rate_pct").alias("lo"), F.max("default_rate_pct").alias("hi"))
    lo, hi = rng.select("lo").scalar(), rng.select("hi").scalar()
    binned = rates.withColumn("bin", equal_width_right_closed("default_rate_pct", lo, hi, n))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_categories"))
    spine = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    hist = spine.join(counts, "bin", "left").select("bin", F.coalesce("n_categories", F.lit(0)).cast("bigint").alias("n_categories"))
    members = binned.select("bin", F.col(col).alias("member"))
    return hist, members


def describe(df: DataFrame, cols, exact: bool = True) -> DataFrame:
    """Count, mean, std (ddof 1), min, quartiles, max per column (moments in one aggregate)."""
    q = quantile_frame(df.sparkSession, fit_quantiles(df, cols, [0.25, 0.5, 0.75], exact))  # one row per column
    one = lambda v: F.struct(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    moments = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), one(F.col(c).cast("double")).alias("m")) for c in cols]).alias("a"))
    return moments.select(F.inline("a")).select("column", "m.*").join(F.broadcast(q), "column").select(
        "column", "count", "mean", "std", "min",
        F.col("__q")[0].alias("p25"), F.col("__q")[1].alias("p50"), F.col("__q")[2].alias("p75"), "max",
    )


def quantiles(df: DataFrame, cols, qs, exact: bool = True) -> DataFrame:
    """(column, q, value) with linear interpolation, NULLs ignored."""
    agg = quantile_frame(df.sparkSession, fit_quantiles(df, cols, qs, exact))
    levels = F.array(*[F.lit(float(x)) for x in qs])
    return agg.select("column", F.posexplode(F.arrays_zip(levels.alias("q"), F.col("__q").alias("v"))).alias("pos", "z")).select(
        "column", F.col("z.q").alias("q"), F.col("z.v").alias("value")
    )


def equal_width_cuts(df: DataFrame, cols, n: int = 10) -> DataFrame:
    """``pd.cut(col, n)`` for every numeric column on a complete (column, bin) grid.

    Empty and single-valued columns are skipped. Edges: linspace(min, max, n+1),
    lowest edge lowered by 0.1 % of the range; bins right-closed.
    """
    long = long_numeric(df, cols).filter(F.col("value").isNotNull())
    # One row per column: bounded by the number of columns, safe to broadcast.
    stats = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter(F.col("lo") < F.col("hi"))
    binned = long.join(F.broadcast(stats), "column").withColumn("bin", equal_width_right_closed("value", "lo", "hi", n))
    counts = binned.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = stats.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(n))
    lower = F.when(F.col("bin") == 0, F.col("lo") - (F.col("hi") - F.col("lo")) * F.lit(0.001)).otherwise(
        linspace_edge(F.col("lo"), step, F.col("bin")))
    upper = F.when(F.col("bin") == n - 1, F.col("hi")).otherwise(linspace_edge(F.col("lo"), step, F.col("bin") + 1))
    return grid.join(counts, ["column", "bin"], "left").select(
        "column", "bin", lower.alias("lower"), upper.alias("upper"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def bracket_counts(df: DataFrame, col: str, edges, labels, name: str = "bracket") -> DataFrame:
    """A10: fixed right-closed brackets with labels; out-of-range -> NULL bracket."""
    return df.groupBy(bracket_expr(col, edges, labels).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def density_hist(df: DataFrame, col: str, n: int = 50, by: str | None = None) -> DataFrame:
    """Numpy-style histogram with density, over each group's own data range."""
    keys = [by] if by else []
    src = df.filter(F.col(col).isNotNull())
    stats = src.groupBy(*keys).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(F.lit(1)).alias("total"))
    joined = src.join(stats, keys) if keys else src.withColumns({
        "lo": src.agg(F.min(col)).scalar(), "hi": src.agg(F.max(col)).scalar(), "total": src.agg(F.count(F.lit(1))).scalar()})
    # a constant column gets the range value +- 0.5, as numpy's histogram has it
    widened = {"lo": F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")),
               "hi": F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))}
    joined, stats = joined.withColumns(widened), stats.withColumns(widened)
    binned = joined.withColumn("bin", equal_width_left_closed(col, "lo", "hi", n))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = stats.select(*keys, "lo", "hi", "total", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(n))
    cnt = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return grid.join(counts, keys + ["bin"], "left").select(
        *keys, "bin",
        linspace_edge(F.col("lo"), width, F.col("bin")).alias("lower"),
        cnt.alias("n"),
        F.try_divide(cnt.cast("double"), F.col("total") * width).alias("density"),
    )


def kde(df: DataFrame, col: str, grid_points: int = 50, by: str | None = None) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) on an even grid over each group's range.

    Exact sum over all rows in one pass: the group's kernel sums are ``grid_points``
    aggregates with map-side partial aggregation, so no row is multiplied. A constant
    column has no bandwidth: its density is NULL.
    """
    keys = [by] if by else []
    src = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("x"))
    stats = src.groupBy(*keys).agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total"), F.stddev_samp("x").alias("sd")
    ).withColumn("h", F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2)))
    g = grid_points
    stats = stats.withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(float(g - 1)))
    if keys:
        rows = src.join(stats, keys)
    else:
        rows = src.withColumns({c: stats.select(c).scalar() for c in ("lo", "h", "total", "step")})
    at = lambda i: F.lit(float(i)) * F.col("step") + F.col("lo")
    z = [F.try_divide(at(i) - F.col("x"), F.col("h")) for i in range(g)]
    sums = rows.groupBy(*keys).agg(
        *[F.sum(F.exp(F.lit(-0.5) * d * d)).alias(f"__s{i}") for i, d in enumerate(z)],
        F.first("lo").alias("lo"), F.first("step").alias("step"), (F.first("total") * F.first("h")).alias("__nh"))
    points = F.array(*[F.struct(F.lit(i).alias("gi"), at(i).alias("x"), F.col(f"__s{i}").alias("s")) for i in range(g)])
    out = sums.select(*keys, "__nh", F.explode(points).alias("__p"))
    return out.select(*keys, F.col("__p.gi").alias("gi"), F.col("__p.x").alias("x"), F.try_divide(
        F.col("__p.s"), F.col("__nh") * F.lit((2 * 3.141592653589793) ** 0.5)).alias("density"))


def box_stats(df: DataFrame, cols, exact: bool = True) -> DataFrame:
    """Quartiles, 1.5*IQR whiskers clipped to data, outlier counts per column."""
    long = long_numeric(df, cols).filter(F.col("value").isNotNull())
    q = quantile_frame(df.sparkSession, fit_quantiles(df, cols, [0.25, 0.5, 0.75], exact)).select(
        "column", F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"), F.col("__q")[2].alias("q3"))
    q = q.withColumns({"lo_fence": F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1")),
                       "hi_fence": F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))})
    j = long.join(F.broadcast(q), "column")
    return j.groupBy("column", "q1", "median", "q3").agg(
        F.min(F.when(F.col("value") >= F.col("lo_fence"), F.col("value"))).alias("whisker_lo"),
        F.max(F.when(F.col("value") <= F.col("hi_fence"), F.col("value"))).alias("whisker_hi"),
        F.count_if((F.col("value") < F.col("lo_fence")) | (F.col("value") > F.col("hi_fence"))).cast("bigint").alias("n_outliers"),
    )


def corr_with_target(df: DataFrame, cols, target: str = "target") -> DataFrame:
    """Pearson (point-biserial for 0/1 targets) of each column with the target; NULL pairs ignored."""
    src = df.select(F.col(target).cast("double").alias("__y"), *cols)
    long = long_numeric(src, cols, ids=["__y"])
    return long.groupBy("column").agg(F.corr("value", "__y").alias("corr")).orderBy(F.desc("corr"), "column")


def corr_pairs(df: DataFrame, pairs) -> DataFrame:
    """Correlation of chosen column pairs in one aggregate."""
    names = [f"{a}__{b}" for a, b in pairs]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(nm) for (a, b), nm in zip(pairs, names)])
    long = wide.unpivot([], names, "pair", "corr")
    return long.select(F.split("pair", "__")[0].alias("a"), F.split("pair", "__")[1].alias("b"), "corr")


def default_timing(df: DataFrame, start: str, end: str, status: str = "loan_status", bad=("Charged Off",),
                   max_months: int = 72) -> DataFrame:
    """A17 + W1: months from issue to last payment for bad loans, cumulative share over 0..max_months.

    The histogram has at most max_months+1 rows, so its ordered running sum is a
    window over a tiny frame.
    """
    m = month_ordinal(F.col(end)) - month_ordinal(F.col(start))
    src = df.filter(F.col(status).isin(list(bad)) & F.col(end).isNotNull()).select(m.alias("months"))
    total = src.agg(F.count(F.lit(1))).scalar()
    hist = src.filter((F.col("months") >= 0) & (F.col("months") <= max_months)).groupBy("months").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("months").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select("months", "n", (F.sum("n").over(w) / total).alias("cum_share"))


def distinct_counts(df: DataFrame, cols=None, approx: bool = False) -> DataFrame:
    """Number of distinct non-null values per column (HyperLogLog++ when approx)."""
    cols = list(cols or df.columns)
    long = long_text(df, cols)
    agg = F.approx_count_distinct("value", 0.01) if approx else F.count_distinct("value")
    return long.groupBy("column").agg(agg.cast("bigint").alias("n_distinct"))


def fully_null(df: DataFrame, by: str, cols=None) -> DataFrame:
    """(group, column) pairs where the column is 100 % NULL inside the group."""
    cols = [c for c in (cols or df.columns) if c != by]
    wide = df.groupBy(by).agg(*[F.count(F.col(c)).alias(c) for c in cols])
    return wide.unpivot([by], cols, "column", "n_present").filter(F.col("n_present") == 0).select(by, "column")


def null_patterns(df: DataFrame, cols) -> DataFrame:
    """Rows per missingness pattern over ``cols`` (pattern = 0/1 string in column order)."""
    pattern = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in cols])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def same_null_rows(df: DataFrame, a: str, b: str) -> DataFrame:
    """Are the two columns NULL in exactly the same rows?"""
    return df.agg(F.bool_and(F.col(a).isNull() == F.col(b).isNull()).alias("same_null_rows"))


def overview(df: DataFrame, as_of, ts: str = "logged_at", prob: str = "prob", pred: str = "pred", exact: bool = True) -> DataFrame:
    """Totals, recent counts, prediction split, score percentiles and time range in one aggregate."""
    q = [F.lit(x).cast("double") for x in fit_quantiles(df, [prob], [0.5, 0.9, 0.95, 0.99], exact)[prob]]
    now = ts_lit(as_of)
    return df.agg(
        F.count(F.lit(1)).alias("total_logged"),
        F.count_if(F.col(ts) >= now - F.expr("INTERVAL 24 HOURS")).cast("bigint").alias("requests_last_24h"),
        F.count_if(F.col(ts) >= now - F.expr("INTERVAL 1 HOURS")).cast("bigint").alias("requests_last_1h"),
        F.count_if(F.col(pred) == 0).cast("bigint").alias("n_pred_0"),
        F.count_if(F.col(pred) == 1).cast("bigint").alias("n_pred_1"),
        F.max(prob).alias("p_max"),
        F.min(ts).alias("first_logged"),
        F.max(ts).alias("last_logged"),
    ).select(
        "total_logged", "requests_last_24h", "requests_last_1h", "n_pred_0", "n_pred_1",
        q[0].alias("p50"), q[1].alias("p90"), q[2].alias("p95"), q[3].alias("p99"),
        "p_max", "first_logged", "last_logged",
        # Predicted default rate = 100 * n1 / max(1, n0 + n1)
        (F.lit(100.0) * F.col("n_pred_1") / F.greatest(F.lit(1), F.col("n_pred_0") + F.col("n_pred_1"))).alias("predicted_default_rate"),
    )


def score_hist(df: DataFrame, bins: int = 30, prob: str = "prob") -> tuple[DataFrame, DataFrame]:
    """Histogram of scores on [0, 1] (last bin closed, outside ignored) on a complete grid,
    plus mean and median of all non-null scores."""
    src = df.select(F.col(prob).cast("double").alias("p")).filter(F.col("p").isNotNull())
    binned = src.select(equal_width_left_closed("p", F.lit(0.0), F.lit(1.0), bins).alias("bin")).filter(F.col("bin").isNotNull())
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    hist = spine.join(counts, "bin", "left").select(
        "bin",
        (F.col("bin").cast("double") * F.lit(1.0 / bins)).alias("range_start"),
        F.when(F.col("bin") == bins - 1, F.lit(1.0)).otherwise((F.col("bin") + 1).cast("double") * F.lit(1.0 / bins)).alias("range_end"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
    median = F.lit(fit_quantiles(src, ["p"], [0.5])["p"][0]).cast("double")
    summary = src.agg(F.avg("p").alias("mean"), median.alias("median"))
    return hist, summary


def positives_by(df: DataFrame, target: str, col: str) -> DataFrame:
    """Rows and positives per segment."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target)).cast("bigint").alias("n_pos"))


def date_span(df: DataFrame, date: str, by: str) -> DataFrame:
    """First and last date per group."""
    return df.groupBy(by).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))
