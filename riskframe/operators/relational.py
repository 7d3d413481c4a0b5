"""Joins, set operations, ordering and fold assignment.

Keyed joins use equi-joins and let AQE pick broadcast or a skew-aware
sort-merge join from runtime sizes. Explicit ``broadcast`` hints are used only
for sides whose size is bounded by construction (one row per feature, per
category level, per fold). No operator emits all pairs within a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.exprs import reason_strength
from riskframe.operators.duplicates import repeated_rows
from riskframe.operators.windowing import running_sums


# ------------------------------------------------------------------ joins


def align_scores(df: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """1:1 inner alignment of rows and scores by key."""
    return df.join(scores, key, "inner")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """J1 check: keys that occur more than once (should be empty before aligning)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def align_counts(ref: DataFrame, live: DataFrame, col: str) -> DataFrame:
    """Full-outer alignment of reference and live value counts, zero-filled."""
    r = ref.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n_ref"))
    lv = live.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n_live"))
    return r.join(lv, "value", "full_outer").fillna(0, subset=["n_ref", "n_live"])


def unseen_values(ref: DataFrame, target: DataFrame, col: str) -> DataFrame:
    """Values of ``target`` absent from ``ref`` (anti-join on distinct values), with counts."""
    seen = ref.select(F.col(col).alias("value")).filter(F.col("value").isNotNull()).distinct()
    counts = target.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(seen, "value", "left_anti")


def in_domain(df: DataFrame, col: str, values) -> Column:
    """Membership in an allowed set (a literal ``IN`` list; no join for a fixed domain)."""
    return F.col(col).isin(list(values))


def semi_join(df: DataFrame, allowed: DataFrame, col: str) -> DataFrame:
    """J7 for a data-driven domain: rows whose value appears in ``allowed``."""
    return df.join(allowed.select(F.col(col)).distinct(), col, "left_semi")


# ------------------------------------------------------------------ sets


def union_reports(*reports: DataFrame) -> DataFrame:
    """Union by column name."""
    return reduce(lambda a, b: a.unionByName(b), reports)


def vocabulary(dfs, col: str) -> DataFrame:
    """Distinct non-null values over several frames."""
    return reduce(lambda a, b: a.union(b), [d.select(F.col(col).alias("value")) for d in dfs]).filter(
        F.col("value").isNotNull()).distinct()


def vocabulary_matches(vocab: DataFrame, declared) -> DataFrame:
    """One row (extra, missing) comparing a vocabulary with a declared set (exceptAll both ways)."""
    decl = vocab.sparkSession.createDataFrame([(v,) for v in declared], "value string")
    extra = vocab.exceptAll(decl)
    missing = decl.exceptAll(vocab)
    return vocab.sparkSession.range(1).select(
        extra.agg(F.count(F.lit(1))).scalar().alias("n_extra"), missing.agg(F.count(F.lit(1))).scalar().alias("n_missing"))


def overlap(dfs) -> DataFrame:
    """U4: fully duplicated rows across the concatenated frames (one row: groups, rows); digests are shuffled, not rows."""
    g = repeated_rows(reduce(lambda a, b: a.unionByName(b), dfs))
    return g.agg(F.count(F.lit(1)).cast("bigint").alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def id_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Number of keys of ``a`` also present in ``b`` (semi-join count)."""
    return a.select(key).join(b.select(key), key, "left_semi").agg(F.count(F.lit(1)).cast("bigint").alias("n_shared"))


# ------------------------------------------------------------------ ordering


def sort_by_date(df: DataFrame, date: str, key: str) -> DataFrame:
    """O1: date ascending (NULLs last), key as tie-breaker; a range-partitioned distributed sort."""
    return df.orderBy(F.col(date).asc_nulls_last(), F.col(key))


def global_position(df: DataFrame, date: str, key: str, buckets: int = 256) -> DataFrame:
    """0-based position of each row in (date, key) order, NULL dates last, without a single-partition window.

    Per-date counts give each date's offset and the rank inside a date is a
    running count over the key; both are two-level running sums, so neither many
    distinct timestamps nor a date holding a third of all rows meets in one task.
    """
    day_counts = df.groupBy(date).agg(F.count(F.lit(1)).alias("__n"))
    dated = running_sums(day_counts.filter(F.col(date).isNotNull()), date, ["__n"], buckets=buckets)
    offsets = dated.select(F.struct(date).alias("__day"), (F.col("cum___n") - F.col("__n")).alias("__off"))
    all_dated = day_counts.filter(F.col(date).isNotNull()).agg(F.coalesce(F.sum("__n"), F.lit(0))).scalar()
    ones = df.withColumn("__one", F.lit(1))
    ranked = running_sums(ones, key, ["__one"], keys=[date], buckets=buckets).withColumn("__day", F.struct(date))
    placed = ranked.join(offsets, "__day", "left")
    return placed.withColumn("position", F.coalesce("__off", all_dated) + F.col("cum___one") - 1).drop("__one", "cum___one", "__off", "__day")


def time_folds(df: DataFrame, date: str, key: str, k: int = 5) -> DataFrame:
    """Expanding-window folds (TimeSeriesSplit): test_size = n // (k+1); fold i tests
    the i-th of the last k blocks and trains on every row before it.

    Output is long: one row per (row, fold, part) for the folds the row takes part in.
    """
    pos = global_position(df, date, key).withColumn("__n", df.agg(F.count(F.lit(1))).scalar())
    n = F.col("__n")
    size = F.floor(n / F.lit(k + 1))
    folds = F.sequence(F.lit(0), F.lit(k - 1))
    # test block of fold i starts at n - (k - i) * size
    test_start = lambda i: n - (F.lit(k) - i) * size
    part = lambda i: F.when((F.col("position") >= test_start(i)) & (F.col("position") < test_start(i) + size), F.lit("test")).when(
        F.col("position") < test_start(i), F.lit("train"))
    tagged = pos.withColumn("__f", F.explode(F.transform(folds, lambda i: F.struct(i.alias("fold"), part(i).alias("part")))))
    return tagged.filter(F.col("__f.part").isNotNull()).select("*", F.col("__f.fold").alias("fold"), F.col("__f.part").alias("part")).drop("__f", "__n")


def fold_summary(folds: DataFrame, date: str, target: str) -> DataFrame:
    """Date span, rows and positives of each fold's train and test part."""
    return folds.groupBy("fold", "part").agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col(target)).cast("bigint").alias("n_pos"))


def top_reasons(contrib: DataFrame, k: int = 5, id_col: str = "id", feature: str = "feature", value: str = "value") -> DataFrame:
    """Top-k reasons per id by absolute contribution (feature name breaks ties).

    Magnitudes equal to 12 decimals count as ties (collinear features give
    contributions that differ only in float noise). ``row_number() <= k`` is
    planned as a per-partition group limit, so only k rows per id survive
    before the final window.
    """
    w = Window.partitionBy(id_col).orderBy(F.round(F.abs(F.col(value)), 12).desc(), F.col(feature))
    return contrib.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_reason_rows(rows: DataFrame, k: int = 5) -> DataFrame:
    """W3 + W4 where the contributions lie: ``contributions`` become ``reasons``, the k strongest (feature, value, rank, ratio, magnitude).

    Order as in ``top_reasons``; ratio is relative to the record's strongest reason. Nothing is unpivoted or shuffled.
    """
    keyed = F.transform("contributions", lambda c: F.struct((-F.round(F.abs(c["value"]), 12)).alias("k"), c["feature"].alias("feature"), c["value"].alias("value")))
    best = F.slice(F.array_sort(keyed), 1, k)  # strongest first, then by name

    def reason(largest):
        def one(c, i):
            ratio = F.abs(c["value"]) / F.when(largest == 0, F.lit(1.0)).otherwise(largest)
            return F.struct(c["feature"].alias("feature"), c["value"].alias("value"), (i + 1).alias("rank"), ratio.alias("ratio"),
                            reason_strength(ratio).alias("magnitude"))
        return one

    # a one-element array holds what is used more than once, so that it is evaluated once
    reasons = F.transform(F.array(best), lambda b: F.transform(
        F.array(F.array_max(F.transform(b, lambda c: F.abs(c["value"])))), lambda m: F.transform(b, reason(m)))[0])[0]
    return rows.select(*[c for c in rows.columns if c != "contributions"], reasons.alias("reasons"))


def explain_rows(reasons: DataFrame, lookup: DataFrame) -> DataFrame:
    """J9 + L8 on ``top_reason_rows``: one row per reason with label, direction, magnitude and sentence.

    The lookup has one row per feature: it is broadcast, and the reasons are not shuffled.
    """
    from riskframe.functions.exprs import humanise, strip_prefix

    r = reasons.select("id", F.inline("reasons")).withColumn("__name", strip_prefix(F.col("feature")))
    texts = lookup.select(F.col("feature").alias("__name"), F.struct("label", "up", "down").alias("__t"))
    r = r.join(F.broadcast(texts), "__name", "left")
    up = F.col("value") > 0
    label = F.coalesce(F.col("__t.label"), humanise(F.col("feature")))
    generic = F.concat(label, F.when(up, F.lit(" increased")).otherwise(F.lit(" decreased")), F.lit(" the estimated risk."))
    sentence = F.coalesce(F.when(up, F.col("__t.up")).otherwise(F.col("__t.down")), generic)
    return r.select("id", "feature", "value", label.alias("label"), F.when(up, F.lit("up")).otherwise(F.lit("down")).alias("direction"),
                    "magnitude", sentence.alias("sentence"))


def reason_magnitude(contrib: DataFrame, id_col: str = "id", value: str = "value") -> DataFrame:
    """|value| relative to the strongest reason of the same id (max 0 -> 1)."""
    mx = F.max(F.abs(F.col(value))).over(Window.partitionBy(id_col))
    ratio = F.abs(F.col(value)) / F.when(mx == 0, F.lit(1.0)).otherwise(mx)
    return contrib.withColumns({"ratio": ratio, "magnitude": reason_strength(ratio)})


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Deterministic sample of n rows: the n smallest integer-mix hashes of the key.

    A distributed top-k (the sample size is the feature); ties broken by key.
    """
    m = 1000003
    h = ((F.col(key) % F.lit(m)) * F.lit(2654435761 % m) + F.lit(seed)) % F.lit(m)  # reduced first: no overflow for any key
    return df.orderBy(h, F.col(key)).limit(n)


def segments_by_size(df: DataFrame, col: str) -> DataFrame:
    """Segment sizes, largest first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def categories_by_share(overlay: DataFrame) -> DataFrame:
    """Category union ordered by reference share (desc), then name."""
    return overlay.orderBy(F.desc("reference_pct"), "category")
