"""Population stability (PSI) drift.

The reference is fitted once into a **profile** (``fit_profile``): inner quantile edges per numeric feature
(``windowing.fit_quantiles``) and the bucket counts of every feature with its shares. Any number of target
populations is then one pass: bucket counts per (label, feature, bucket), joined to the profile.

* numeric: right-closed bins by comparing with the <= bins - 1 inner edges, which are numbers in the plan;
  NULL -> ``missing`` bucket;
* categorical: one bucket per value; target-only values pool into ``unseen``, NULL into ``missing``;
* shares use all rows (NULLs included) as denominators, floored at 1e-4;
  PSI = sum((t - r) * ln(t / r)). Buckets empty on both sides contribute 0, so
  only buckets seen on either side are materialised.

Buckets are tagged keys ``(kind, value)`` so a literal category named
"missing" never collides with the missing bucket. Bucket counts are sums: those of days, batches or partitions add
up to those of their union, which is what ``drift_state`` keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import specs
from riskframe.functions.exprs import drift_level, ts_lit
from riskframe.operators.binning import right_closed_bin
from riskframe.operators.windowing import fit_quantiles
from riskframe.session import cut_lineage

KIND_VALUE, KIND_MISSING, KIND_BIN = 0, 2, 3
KIND_EDGES = -1  # a stored profile's rows that hold the edges of a numeric feature


def _levels(bins: int) -> list[float]:
    # Same float levels as i * (1 / bins).
    return [i * (1 / bins) for i in range(1, bins)]


def _tagged(targets) -> DataFrame:
    """Union of target frames with a ``target_label`` column."""
    out = None
    for label, df in targets.items():
        t = df.withColumn("target_label", F.lit(label))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def numeric_edges(reference: DataFrame, cols, bins: int = 10, exact: bool = True) -> dict[str, list[float]]:
    """Distinct reference quantiles at 1/bins ... (bins-1)/bins per column, ascending.

    NULLs are ignored; an all-NULL column gets no inner edge (one (-inf, inf] bin).
    """
    fitted = fit_quantiles(reference, cols, _levels(bins), exact)
    return {c: list(dict.fromkeys(x for x in q if x is not None)) for c, q in fitted.items()}


def _bin(col: Column, edges: list[float]) -> Column:
    return right_closed_bin(col, F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>"), len(edges))


def bucket_counts(df: DataFrame, edges: dict[str, list[float]], categorical=(), keys=()) -> DataFrame:
    """(keys..., feature, kind, value, n): rows of every bucket of every feature, in one pass with map-side sums."""
    cells = []
    for c, e in edges.items():
        b = _bin(F.col(c).cast("double"), e).cast("string")
        cells.append((c, F.when(b.isNull(), F.lit(KIND_MISSING)).otherwise(F.lit(KIND_BIN)), b))
    for c in categorical:
        v = F.col(c).cast("string")
        cells.append((c, F.when(v.isNull(), F.lit(KIND_MISSING)).otherwise(F.lit(KIND_VALUE)), v))
    structs = [F.struct(F.lit(c).alias("feature"), kind.alias("kind"), F.coalesce(v, F.lit("")).alias("value")) for c, kind, v in cells]
    return df.select(*keys, F.inline(F.array(*structs))).groupBy(*keys, "feature", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Profile:
    """A fitted reference: edges of the numeric features, and (feature, kind, value, n) of all buckets."""

    edges: dict[str, list[float]]
    categorical: list[str]
    buckets: DataFrame

    def shares(self) -> DataFrame:
        """(feature, kind, value, __r, __g0, __base): floored share, its term against an empty target, and the sum of those terms."""
        w = Window.partitionBy("feature")
        r = self.buckets.withColumn("__r", _share(F.col("n"), F.sum("n").over(w)))
        r = r.withColumn("__g0", _term(F.lit(specs.PSI_FLOOR), F.col("__r")))
        return r.select("feature", "kind", "value", "__r", "__g0", F.sum("__g0").over(w).alias("__base"))

    def counts(self, target: DataFrame, keys=()) -> DataFrame:
        """Bucket counts of a target population, with this profile's edges."""
        return bucket_counts(target, self.edges, self.categorical, keys)

    def of(self, numeric=(), categorical=()) -> Profile:
        """The profile narrowed to some features."""
        return Profile({c: self.edges[c] for c in numeric}, list(categorical), self.buckets.filter(F.col("feature").isin([*numeric, *categorical])))

    def table(self) -> DataFrame:
        """The profile as one table, for storing."""
        rows = [(c, KIND_EDGES, "", None, e) for c, e in self.edges.items()]
        edges = self.buckets.sparkSession.createDataFrame(rows, "feature string, kind int, value string, n long, edges array<double>")
        return self.buckets.select("feature", F.col("kind").cast("int").alias("kind"), "value", "n",
                                   F.lit(None).cast("array<double>").alias("edges")).unionByName(edges)

    @staticmethod
    def from_table(table: DataFrame) -> Profile:
        """Read back ``table()``; one row per numeric feature reaches the driver."""
        edges = {r.feature: list(r.edges) for r in table.filter(F.col("kind") == KIND_EDGES).select("feature", "edges").orderBy("feature").collect()}
        buckets = table.filter(F.col("kind") != KIND_EDGES).select("feature", "kind", "value", "n")
        found = [r.feature for r in buckets.filter(F.col("kind") != KIND_BIN).select("feature").distinct().orderBy("feature").collect()]
        return Profile(edges, [c for c in found if c not in edges], buckets)


def fit_profile(reference: DataFrame, numeric=(), categorical=(), bins: int = 10, exact: bool = True) -> Profile:
    """Edges and bucket counts of the reference: three passes over it, whatever the number of targets."""
    edges = numeric_edges(reference, list(numeric), bins, exact)
    return Profile(edges, list(categorical), cut_lineage(bucket_counts(reference, edges, list(categorical))))


def _share(n, total):
    return F.greatest(n.cast("double") / total, F.lit(specs.PSI_FLOOR))


def _term(t: Column, r: Column) -> Column:
    return (t - r) * F.ln(t / r)


def psi_of_counts(profile: Profile, counts: DataFrame, label: str = "target_label") -> DataFrame:
    """(label, feature, psi) from target bucket counts (label, feature, kind, value, n).

    PSI = sum over reference buckets of f(floor, r) + sum over target buckets of
    [f(t, r) - f(floor, r)] (r = floor for buckets absent in the reference).
    Only an equi-join on (feature, bucket): the reference is never replicated per
    target population, so any number of populations (e.g. days) is one job.
    """
    floor, shares = F.lit(specs.PSI_FLOOR), profile.shares()
    j = counts.join(shares.drop("__base"), ["feature", "kind", "value"], "left").withColumn("__all", F.sum("n").over(Window.partitionBy(label, "feature")))
    unseen = (F.col("kind") == KIND_VALUE) & F.col("__r").isNull()  # pooled into one bucket
    part = _term(_share(F.col("n"), F.col("__all")), F.coalesce(F.col("__r"), floor)) - F.coalesce(F.col("__g0"), F.lit(0.0))
    sums = j.groupBy(label, "feature").agg(F.coalesce(F.sum(F.when(~unseen, part)), F.lit(0.0)).alias("__part"),
                                           F.sum(F.when(unseen, F.col("n"))).alias("__new"), F.first("__all").alias("__all"))
    pooled = F.when(F.col("__new").isNotNull(), _term(_share(F.col("__new"), F.col("__all")), floor)).otherwise(F.lit(0.0))
    base = shares.groupBy("feature").agg(F.first("__base").alias("__base"))  # one row per feature
    return sums.join(F.broadcast(base), "feature", "left").select(
        label, "feature", (F.col("__part") + pooled + F.coalesce(F.col("__base"), F.lit(0.0))).alias("psi"))


def report_of_counts(profile: Profile, counts: DataFrame, label: str = "target_label") -> DataFrame:
    """(feature, PSI, drift_level, label) from target bucket counts."""
    return psi_of_counts(profile, counts, label).select("feature", F.col("psi").alias("PSI"), drift_level(F.col("psi")).alias("drift_level"), label)


def _profile_of(reference, numeric, categorical, bins: int, exact: bool) -> Profile:
    """A profile given as such is narrowed to the features; a frame is fitted."""
    return reference.of(numeric, categorical) if isinstance(reference, Profile) else fit_profile(reference, numeric, categorical, bins, exact)


def drift_report_by(reference: DataFrame | Profile, target: DataFrame, numeric=(), categorical=(), label: str = "target_label",
                    bins: int = 10, exact: bool = True) -> DataFrame:
    """D3/D4 with the population given by a column of ``target``: (feature, PSI, drift_level, label)."""
    profile = _profile_of(reference, list(numeric), list(categorical), bins, exact)
    return report_of_counts(profile, profile.counts(target, [label]), label)


def drift_report_many(reference: DataFrame | Profile, targets: dict, numeric=(), categorical=(), bins: int = 10,
                      exact: bool = True) -> DataFrame:
    """D3 + D4: (feature, PSI, drift_level, target_label) for every feature and named target population."""
    return drift_report_by(reference, _tagged(targets), numeric, categorical, "target_label", bins, exact)


def drift_report(reference: DataFrame | Profile, target: DataFrame, numeric=(), categorical=(), label: str = "target",
                 bins: int = 10, exact: bool = True) -> DataFrame:
    """D3: full report for one target population."""
    return drift_report_many(reference, {label: target}, numeric, categorical, bins, exact)


def psi_numeric(reference: DataFrame, target: DataFrame, col: str, bins: int = 10, exact: bool = True) -> DataFrame:
    """D1 for one column: (feature, psi)."""
    return drift_report(reference, target, [col], [], "t", bins, exact).select("feature", F.col("PSI").alias("psi"))


def psi_categorical(reference: DataFrame, target: DataFrame, col: str) -> DataFrame:
    """D2 for one column: (feature, psi)."""
    return drift_report(reference, target, [], [col], "t").select("feature", F.col("PSI").alias("psi"))


def level_crosstab(report: DataFrame) -> DataFrame:
    """Counts of drift levels per target label, zero-filled."""
    lv = ["stable", "moderate", "significant"]
    return report.groupBy("target_label").pivot("drift_level", lv).count().fillna(0, subset=lv).select(
        "target_label", *[F.col(x).cast("bigint").alias(x) for x in lv])


def flagged(report: DataFrame) -> DataFrame:
    """Non-stable rows by PSI descending."""
    return report.filter(F.col("drift_level") != "stable").orderBy(F.desc("PSI"), "feature", "target_label")


def top_drift(report: DataFrame, k: int = 10) -> DataFrame:
    """Top-k features by PSI (the limit is the feature); PSI equal to 12 decimals is a tie, broken by name."""
    return report.orderBy(F.round(F.col("PSI"), 12).desc(), "feature", "target_label").limit(k)


def drift_summary(reference: DataFrame | Profile, live: DataFrame, numeric=(), categorical=(), min_live: int = specs.MIN_LIVE_SAMPLE_SIZE,
                  bins: int = 10, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(level counts zero-filled with sizes and warning, report sorted by PSI); the live side is read once."""
    profile = _profile_of(reference, list(numeric), list(categorical), bins, exact)
    counts = cut_lineage(profile.counts(live).withColumn("target_label", F.lit("live")))
    report = report_of_counts(profile, counts)
    spark = report.sparkSession
    lv = spark.createDataFrame([(x,) for x in ("stable", "moderate", "significant")], "drift_level string")
    n = lv.join(report.groupBy("drift_level").agg(F.count(F.lit(1)).alias("n")), "drift_level", "left").fillna(0, subset=["n"])
    n_ref, n_live = population(profile.buckets), population(counts)
    n = n.withColumns({
        "reference_size": F.lit(n_ref), "live_size": F.lit(n_live),
        "sample_size_warning": F.lit(n_live < min_live), "min_sample_threshold": F.lit(min_live),
    })
    return n, report.orderBy(F.desc("PSI"), "feature")


def population(counts: DataFrame) -> int:
    """Number of rows behind bucket counts: every row is in one bucket of each feature."""
    one = counts.groupBy("feature").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    return int(one or 0)


def _side(counts: DataFrame, feature: str, name: str, key: Column) -> DataFrame:
    """(key, n_<name>) of a feature's buckets that are not missing, with <name>_rows and <name>_present on every row."""
    w = Window.partitionBy("feature")
    present = F.col("kind") != KIND_MISSING
    return counts.filter(F.col("feature") == feature).select(
        key.alias("key"), "kind", F.col("n").alias(f"n_{name}"), F.sum("n").over(w).alias(f"{name}_rows"),
        F.coalesce(F.sum(F.when(present, F.col("n"))).over(w), F.lit(0)).alias(f"{name}_present"))


def numeric_overlay(reference: DataFrame | Profile, live: DataFrame, col: str, bins: int = 10, exact: bool = True) -> DataFrame:
    """Reference edges, shares of NON-NULL rows per side, infinite ends as NULL, NULL % per side (one pass per side)."""
    profile = _profile_of(reference, [col], [], bins, exact)
    return _numeric_overlay(profile, profile.counts(live), col)


def _numeric_overlay(profile: Profile, counts: DataFrame, col: str) -> DataFrame:
    edges = profile.edges[col]
    spark = counts.sparkSession
    spine = spark.createDataFrame([(i, edges[i - 1] if i else None, edges[i] if i < len(edges) else None) for i in range(len(edges) + 1)],
                                  "key int, range_start double, range_end double").withColumn("bucket", F.col("key"))
    key = F.when(F.col("kind") == KIND_BIN, F.col("value").cast("int")).otherwise(F.lit(-1))
    side = lambda c, s: _side(c, col, s, key).drop("kind")
    j = spine.join(side(profile.buckets, "ref"), "key", "full_outer").join(side(counts, "live"), "key", "full_outer")  # bins and the missing bucket
    j = j.withColumns({f"{s}_{x}": F.max(f"{s}_{x}").over(Window.partitionBy(F.lit(0))) for s in ("ref", "live") for x in ("rows", "present")})
    j = j.filter(F.col("bucket").isNotNull())
    share = lambda s: F.coalesce(F.try_divide(F.coalesce(F.col(f"n_{s}"), F.lit(0)).cast("double"), F.col(f"{s}_present")), F.lit(0.0))
    missing = lambda s: F.lit(1.0) - F.try_divide(F.col(f"{s}_present").cast("double"), F.col(f"{s}_rows"))
    return j.select("bucket", "range_start", "range_end", share("ref").alias("reference_pct"), share("live").alias("live_pct"),
                    missing("ref").alias("reference_missing_pct"), missing("live").alias("live_missing_pct"))


def categorical_overlay(reference: DataFrame | Profile, live: DataFrame, col: str) -> DataFrame:
    """Union of categories with non-null shares per side and an unseen flag (one pass per side)."""
    profile = _profile_of(reference, [], [col], 10, True)
    return _categorical_overlay(profile, profile.counts(live), col)


def _categorical_overlay(profile: Profile, counts: DataFrame, col: str) -> DataFrame:
    side = lambda c, s: _side(c, col, s, F.col("value")).filter(F.col("kind") == KIND_VALUE).drop("kind")
    j = side(profile.buckets, "ref").join(side(counts, "live"), "key", "full_outer").fillna(0, subset=["n_ref", "n_live"])
    share = lambda s: F.coalesce(F.try_divide(F.col(f"n_{s}").cast("double"), F.col(f"{s}_present")), F.lit(0.0))
    return j.select(F.col("key").alias("category"), share("ref").alias("reference_pct"), share("live").alias("live_pct"),
                    ((F.col("n_ref") == 0) & (F.col("n_live") > 0)).alias("unseen"))


def feature_detail(reference: DataFrame | Profile, live: DataFrame, feature: str, numeric, categorical) -> DataFrame:
    """The overlay of one feature with its drift value and level; only that feature is read, once per side.

    Numeric features give bins, categorical ones their categories; a feature that is neither gives an empty frame.
    """
    if feature not in numeric and feature not in categorical:
        return live.sparkSession.createDataFrame([], "feature string, psi double, drift_level string")
    is_numeric = feature in numeric
    profile = _profile_of(reference, [feature] if is_numeric else [], [] if is_numeric else [feature], 10, True)
    counts = cut_lineage(profile.counts(live).withColumn("target_label", F.lit("live")))
    overlay = (_numeric_overlay if is_numeric else _categorical_overlay)(profile, counts, feature)
    one = report_of_counts(profile, counts).select("feature", F.col("PSI").alias("psi"), "drift_level")
    return overlay.withColumn("feature", F.lit(feature)).join(F.broadcast(one), "feature")


def drift_history(snapshots: DataFrame, feature: str, days: int, as_of, ts: str = "computed_at") -> DataFrame:
    """Snapshots of one feature in the last ``days`` days, ascending.

    The filters reach the scan; a table partitioned by ``snapshot_date`` is read only for those days.
    """
    lo = ts_lit(as_of) - F.make_interval(days=F.lit(int(days)))
    if "snapshot_date" in snapshots.columns:
        snapshots = snapshots.filter(F.col("snapshot_date") >= F.to_date(lo))
    return snapshots.filter((F.col("feature") == feature) & (F.col(ts) >= lo)).select(ts, "psi", "drift_level").orderBy(ts)


def null_shift(reference: DataFrame, target: DataFrame, cols) -> DataFrame:
    """NULL rate per feature in reference and target, and the change."""
    def rates(df, name):
        wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(c)).alias(c) for c in cols])
        return wide.unpivot(["__n"], list(cols), "feature", "__nn").select(
            "feature", (F.lit(1.0) - F.col("__nn") / F.col("__n")).alias(name))
    j = rates(reference, "reference_null_rate").join(rates(target, "target_null_rate"), "feature")
    return j.withColumn("null_rate_change", F.col("target_null_rate") - F.col("reference_null_rate"))


def _unit(key: Column, mult: int, seed: int) -> Column:
    """Deterministic pseudo-uniform in [0, 1) from an integer key (integer arithmetic only)."""
    return ((key * F.lit(mult) + F.lit(seed)) % F.lit(1000)).cast("double") / F.lit(1000.0)


def inject_drift(df: DataFrame, key: str, share: float = 0.3, seed: int = 42, income: str = "annual_inc",
                 dti: str = "dti") -> DataFrame:
    """A deterministic ``share`` of rows get income x U(.70, .85) and dti x U(1.2, 1.4)."""
    k = F.col(key).cast("bigint")
    chosen = _unit(k, 2654435761 % 1000003, seed) < F.lit(share)
    return df.withColumns({
        income: F.when(chosen, F.col(income) * (F.lit(0.70) + F.lit(0.15) * _unit(k, 7919, seed))).otherwise(F.col(income)),
        dti: F.when(chosen, F.col(dti) * (F.lit(1.2) + F.lit(0.2) * _unit(k, 104729, seed))).otherwise(F.col(dti)),
    })


def equal_frequency_counts(df: DataFrame, col: str, n: int = 10, exact: bool = True) -> DataFrame:
    """``qcut``-style counts: edges are the column's own quantiles, lowest bin closed."""
    v = F.col(col).cast("double")
    edges = numeric_edges(df, [col], n, exact)[col]
    return df.filter(v.isNotNull()).groupBy(_bin(v, edges).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
