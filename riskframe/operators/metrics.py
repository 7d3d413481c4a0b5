"""Model evaluation on score tables (E1-E25). All take ``(df, y, p)`` column
names; nothing is collected.

Ranking metrics are exact (not the binned forms of ``pyspark.ml.evaluation``):
rows are first reduced to a distinct-score histogram per group, then ordered
running sums come from the two-level prefix sum in ``windowing``.

* ROC-AUC = sum over scores of pos(s) * (neg below s + neg(s)/2) / (P*N)
* average precision = sum over scores (descending) of pos(s)/P * tp(s)/(tp(s)+fp(s))
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import specs
from riskframe.functions.exprs import keyed_normal
from riskframe.operators.binning import equal_width_right_closed
from riskframe.operators.windowing import running_sums
from riskframe.session import cut_lineage
from riskframe.specs import CostSpec


def _y(y: str) -> Column:
    return F.col(y).cast("bigint")


def _group(df: DataFrame, keys):
    """Ungrouped metrics run as one constant group: totals join on the key instead of
    scalar subqueries (which Spark rejects inside aggregates over model output)."""
    keys = list(keys)
    if keys:
        return keys, df, []
    return ["__g"], df.withColumn("__g", F.lit(0)), ["__g"]


def score_histogram(df: DataFrame, y: str, p: str, keys=()) -> DataFrame:
    """(keys..., p, pos, neg): one row per distinct score per group (map-side combined)."""
    return df.filter(F.col(p).isNotNull()).groupBy(*keys, F.col(p).cast("double").alias("__p")).agg(
        F.sum(_y(y)).alias("pos"), (F.count(F.lit(1)) - F.sum(_y(y))).alias("neg")
    )


def ranking_metrics(df: DataFrame, y: str = "y", p: str = "p", keys=(), buckets: int = 512,
                    skip_one_class: bool = False, stored: bool = False) -> DataFrame:
    """E1 + E2: exact ROC-AUC (ties count half) and average precision per group.

    The running sums read the score histogram several times: with ``stored`` it is kept first, so that dear scores are computed once.
    """
    keys, df, drop = _group(df, keys)
    hist = score_histogram(df, y, p, keys)
    return _ranking(cut_lineage(hist) if stored else hist, keys, buckets, skip_one_class).drop(*drop)


def _ranking(hist: DataFrame, keys, buckets: int = 512, skip_one_class: bool = False) -> DataFrame:
    """``ranking_metrics`` from a score histogram (keys..., __p, pos, neg)."""
    cum = running_sums(hist, "__p", ["pos", "neg"], keys, descending=True, buckets=buckets, total_prefix="__tot_")
    P, N = F.col("__tot_pos"), F.col("__tot_neg")
    Pd = P.cast("double")
    # one-class groups (P = 0 or N = 0) give NULL instead of failing; they are undefined, not zero
    ap_term = F.try_divide(F.col("pos").cast("double") * F.col("cum_pos"), Pd * (F.col("cum_pos") + F.col("cum_neg")))
    auc_term = F.col("pos").cast("double") * (N - F.col("cum_neg") + F.col("neg").cast("double") * F.lit(0.5))
    agg = cum.groupBy(*keys).agg(
        F.sum(ap_term).alias("pr_auc"),
        F.sum(auc_term).alias("__auc"),
        F.first(P).alias("n_pos"),
        F.first(N).alias("n_neg"),
    )
    out = agg.select(
        *keys,
        F.try_divide(F.col("__auc"), F.col("n_pos").cast("double") * F.col("n_neg").cast("double")).alias("roc_auc"),
        "pr_auc",
        F.col("n_pos").cast("bigint").alias("n_pos"),
        F.col("n_neg").cast("bigint").alias("n_neg"),
    )
    return out.filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0)) if skip_one_class else out


def roc_auc(df, y="y", p="p", keys=()) -> DataFrame:
    """E1."""
    return ranking_metrics(df, y, p, keys).select(*keys, "roc_auc")


def average_precision(df, y="y", p="p", keys=()) -> DataFrame:
    """E2."""
    return ranking_metrics(df, y, p, keys).select(*keys, "pr_auc")


def threshold_metrics(df: DataFrame, y: str, p: str, t, keys=()) -> DataFrame:
    """E3 + E4 + E5: Brier, precision, recall (0 when undefined) and confusion counts at threshold t."""
    t_c = t if isinstance(t, Column) else F.lit(float(t))
    yy = _y(y)
    pred = F.col(p) >= t_c
    agg = df.groupBy(*keys).agg(
        F.avg(F.pow(F.col(p).cast("double") - yy.cast("double"), F.lit(2.0))).alias("brier"),
        F.count_if(~pred & (yy == 0)).cast("bigint").alias("tn"),
        F.count_if(pred & (yy == 0)).cast("bigint").alias("fp"),
        F.count_if(~pred & (yy == 1)).cast("bigint").alias("fn"),
        F.count_if(pred & (yy == 1)).cast("bigint").alias("tp"),
    )
    return _with_precision_recall(agg)


def _at_threshold(hist: DataFrame, t: float, keys) -> DataFrame:
    """``threshold_metrics`` from a score histogram."""
    pred, n = F.col("__p") >= F.lit(float(t)), F.col("pos") + F.col("neg")
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")
    squares = F.col("pos") * F.pow(F.col("__p") - 1.0, F.lit(2.0)) + F.col("neg") * F.pow(F.col("__p"), F.lit(2.0))
    agg = hist.groupBy(*keys).agg(
        F.try_divide(F.sum(squares), F.sum(F.when(F.col("__p").isNotNull(), n))).alias("brier"),
        total(~pred, "neg").alias("tn"), total(pred, "neg").alias("fp"), total(~pred, "pos").alias("fn"), total(pred, "pos").alias("tp"))
    return _with_precision_recall(agg)


def _with_precision_recall(agg: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp").cast("double"), F.col("fp").cast("double"), F.col("fn").cast("double")
    return agg.withColumns({
        "precision": F.when(F.col("tp") + F.col("fp") > 0, tp / (tp + fp)).otherwise(F.lit(0.0)),
        "recall": F.when(F.col("tp") + F.col("fn") > 0, tp / (tp + fn)).otherwise(F.lit(0.0)),
    })


def confusion_matrix(df: DataFrame, y: str, p: str, t) -> DataFrame:
    """E5 in the nested [[tn, fp], [fn, tp]] form."""
    m = threshold_metrics(df, y, p, t)
    return m.select(F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"))


# --------------------------------------------------------------------------
# Cost-based threshold
# --------------------------------------------------------------------------


def grid_value(i) -> Column:
    """Grid point i of linspace(0.01, 0.99, 99): 0.01 + i * (0.98 / 98), bit-identical."""
    i_c = i if isinstance(i, Column) else F.lit(i)
    step = (specs.GRID_STOP - specs.GRID_START) / (specs.GRID_POINTS - 1)
    return F.lit(specs.GRID_START) + i_c.cast("double") * F.lit(step)


def grid_rank(p) -> Column:
    """Number of grid points <= p (0..99), by arithmetic plus an exact one-step correction."""
    v = F.col(p) if isinstance(p, str) else p
    n = specs.GRID_POINTS
    step = (specs.GRID_STOP - specs.GRID_START) / (n - 1)
    guess = F.floor((v - F.lit(specs.GRID_START)) / F.lit(step)).cast("int") + F.lit(1)
    g = F.least(F.greatest(guess, F.lit(0)), F.lit(n))
    up = F.when((g < n) & (grid_value(g) <= v), g + 1).otherwise(g)
    return F.when((up > 0) & (grid_value(up - 1) > v), up - 1).otherwise(up)


def cost_curve(df: DataFrame, y: str, p: str, keys=()) -> DataFrame:
    """Per grid point i: fp(i) and fn(i) when predicting p >= t_i.

    Rows collapse to a <= 100-bucket histogram of grid ranks first; the
    cumulative sums then run over <= 99 rows per group.
    """
    keys, df, drop = _group(df, keys)
    k = grid_rank(F.col(p).cast("double"))
    hist = df.filter(F.col(p).isNotNull()).groupBy(*keys, k.alias("k")).agg(
        F.sum(_y(y)).alias("pos"), (F.count(F.lit(1)) - F.sum(_y(y))).alias("neg"))
    return _curve(hist, keys).drop(*drop)


def _curve(hist: DataFrame, keys) -> DataFrame:
    """``cost_curve`` from counts per grid rank (keys..., k, pos, neg)."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(specs.GRID_POINTS - 1))).alias("i")
    spine = hist.select(*keys).distinct().select(*keys, grid)
    j = spine.join(hist.withColumnRenamed("k", "i"), keys + ["i"], "left").fillna(0, subset=["pos", "neg"])
    # k <= i  <=>  p < t_i  (predicted negative); at most 99 rows per group in this window.
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumns({"fn": F.sum("pos").over(w).cast("bigint"), "__neg_le": F.sum("neg").over(w)})
    j = j.join(hist.groupBy(*keys).agg(F.sum("neg").alias("__nall"), F.sum("pos").alias("__pall")), keys)
    nall, pall = F.col("__nall"), F.col("__pall")
    return j.select(
        *keys, "i", grid_value(F.col("i")).alias("threshold"),
        (nall - F.col("__neg_le")).cast("bigint").alias("fp"),
        "fn",
        (pall - F.col("fn")).cast("bigint").alias("tp"),
        F.col("__neg_le").cast("bigint").alias("tn"),
    )


def tune_threshold(df: DataFrame, y: str = "y", p: str = "p", costs: CostSpec = CostSpec(), keys=()) -> DataFrame:
    """Grid threshold minimising fp*fp_cost + fn*fn_cost; first (smallest) on ties."""
    return _cheapest(cost_curve(df, y, p, keys), costs, keys)


def _cheapest(curve: DataFrame, costs: CostSpec, keys=()) -> DataFrame:
    cost = F.col("fp").cast("double") * F.lit(costs.fp_cost) + F.col("fn").cast("double") * F.lit(costs.fn_cost)
    return curve.withColumn("cost", cost).groupBy(*keys).agg(
        F.min_by("threshold", F.struct("cost", "i")).alias("threshold"),
        F.min("cost").alias("cost"),
    )


def evaluate(df: DataFrame, y: str = "y", p: str = "p", split: str = "split", costs: CostSpec = CostSpec(),
             tune_on: str = "val") -> DataFrame:
    """Tune the threshold on one split, then score every split at it.

    The scores are read once, into one histogram per split (a row per distinct score), which is stored; ranking,
    tuning and the metrics at the tuned threshold (one number) all come from it.
    """
    hist = cut_lineage(score_histogram(df, y, p, [split]))
    ranks = hist.filter(F.col(split) == tune_on).groupBy(F.lit(0).alias("__g"), grid_rank("__p").alias("k")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    best = _cheapest(_curve(ranks, ["__g"]), costs).first()
    t = best["threshold"] if best else None
    at = _at_threshold(hist, t if t is not None else 0.0, [split]).withColumn("threshold", F.lit(t).cast("double"))
    return _ranking(hist, [split]).join(at.filter(F.lit(t is not None)), split)


def calibration(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, keys=()) -> DataFrame:
    """Uniform calibration curve; a score on an inner edge falls in the lower bin; empty bins dropped."""
    b = equal_width_right_closed(F.col(p).cast("double"), F.lit(0.0), F.lit(1.0), bins)
    return df.filter(F.col(p).isNotNull()).groupBy(*keys, b.alias("bin")).agg(
        F.avg(F.col(p).cast("double")).alias("prob_pred"),
        F.avg(_y(y).cast("double")).alias("prob_true"),
        F.count(F.lit(1)).alias("n"),
    )


def recall_at_precision(df: DataFrame, y: str = "y", p: str = "p", min_precision: float = 0.8, keys=()) -> DataFrame:
    """Largest recall over the PR curve with precision >= min_precision (0 if none)."""
    keys, df, drop = _group(df, keys)
    hist = score_histogram(df, y, p, keys)
    cum = running_sums(hist, "__p", ["pos", "neg"], keys, descending=True)
    cum = cum.join(hist.groupBy(*keys).agg(F.sum("pos").alias("__tot_pos")), keys)
    P = F.col("__tot_pos")
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    rec = F.try_divide(F.col("cum_pos").cast("double"), P.cast("double"))
    return cum.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(prec >= F.lit(min_precision), rec)), F.lit(0.0)).alias("max_recall")
    ).drop(*drop)


def accuracy_f1(df: DataFrame, y: str = "y", p: str = "p", t: float = 0.5, keys=()) -> DataFrame:
    """Accuracy and F1 at a threshold."""
    m = threshold_metrics(df, y, p, t, keys)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return m.select(
        *keys,
        ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
        F.when(tp > 0, F.lit(2.0) * tp / (F.lit(2.0) * tp + fp + fn)).otherwise(F.lit(0.0)).alias("f1"),
    )


def above(df: DataFrame, y: str = "y", p: str = "p", cut: float = 0.8, keys=()) -> DataFrame:
    """Rows and observed default rate with score above a cut."""
    return df.filter(F.col(p) > F.lit(cut)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(_y(y).cast("double")).alias("observed_rate"))


def brier_reference(df: DataFrame, y: str = "y", keys=()) -> DataFrame:
    """Brier score of the constant base-rate predictor = base * (1 - base)."""
    base = F.avg(_y(y).cast("double"))
    return df.groupBy(*keys).agg((base * (F.lit(1.0) - base)).alias("brier_reference"), base.alias("base_rate"))


def cost_sweep(df: DataFrame, y: str, p: str, ratios, fp_cost: float = 1.0, keys=()) -> DataFrame:
    """Best grid threshold for each FN/FP cost ratio with rejection rate, recall, FN and FP.

    The ratio list is a short parameter; it is attached to the <= 99-row cost
    curve by ``explode`` of a literal array, not by a join.
    """
    keys = list(keys)
    curve = cost_curve(df, y, p, keys)
    r = curve.withColumn("ratio", F.explode(F.array(*[F.lit(float(x)) for x in ratios])))
    cost = F.col("fp").cast("double") * F.lit(fp_cost) + F.col("fn").cast("double") * F.col("ratio") * F.lit(fp_cost)
    best = r.withColumn("cost", cost).groupBy(*keys, "ratio").agg(
        F.min_by(F.struct("threshold", "fp", "fn", "tp", "tn", "cost"), F.struct("cost", "i")).alias("b"))
    b = F.col("b")
    n = b["fp"] + b["fn"] + b["tp"] + b["tn"]
    return best.select(
        *keys, "ratio", b["threshold"].alias("threshold"),
        ((b["tp"] + b["fp"]).cast("double") / n).alias("rejection_rate"),
        F.try_divide(b["tp"].cast("double"), (b["tp"] + b["fn"]).cast("double")).alias("recall"),
        b["fn"].alias("fn"), b["fp"].alias("fp"), b["cost"].alias("cost"),
    )


def threshold_penalty(df: DataFrame, y: str, p: str, fixed_t: float, ratios, fp_cost: float = 2000.0, keys=()) -> DataFrame:
    """(cost at a fixed threshold - optimal cost) / optimal cost * 100 for each cost ratio."""
    keys = list(keys)
    curve = cost_curve(df, y, p, keys)
    r = curve.withColumn("ratio", F.explode(F.array(*[F.lit(float(x)) for x in ratios])))
    cost = F.col("fp").cast("double") * F.lit(fp_cost) + F.col("fn").cast("double") * F.col("ratio") * F.lit(fp_cost)
    r = r.withColumn("cost", cost)
    opt = r.groupBy(*keys, "ratio").agg(F.min("cost").alias("cost_opt"))
    yy = _y(y)
    pred = F.col(p) >= F.lit(float(fixed_t))
    gk, gdf, drop = _group(df, keys)
    fixed = gdf.groupBy(*gk).agg(
        F.count_if(pred & (yy == 0)).alias("__fp"), F.count_if(~pred & (yy == 1)).alias("__fn"))
    j = opt.withColumn("__g", F.lit(0)).join(fixed, gk).drop(*drop) if not keys else opt.join(fixed, keys)
    assumed = F.col("__fp").cast("double") * F.lit(fp_cost) + F.col("__fn").cast("double") * F.col("ratio") * F.lit(fp_cost)
    return j.select(*keys, "ratio", "cost_opt", assumed.alias("cost_assumed"),
                    ((assumed - F.col("cost_opt")) / F.col("cost_opt") * F.lit(100.0)).alias("penalty_pct"))


def theoretical_threshold(costs: CostSpec) -> Column:
    """fp_cost / (fp_cost + fn_cost)."""
    return F.lit(costs.fp_cost) / (F.lit(costs.fp_cost) + F.lit(costs.fn_cost))


# --------------------------------------------------------------------------
# Segments and fairness
# --------------------------------------------------------------------------


def segments_long(df: DataFrame, y: str, p: str, cols) -> DataFrame:
    """(feature, segment, y, p) rows for several segment columns; NULL segments excluded."""
    src = df.select(F.col(y).alias("__y"), F.col(p).alias("__p"), *[F.col(c).cast("string").alias(c) for c in cols])
    return src.unpivot(["__y", "__p"], list(cols), "feature", "segment").filter(F.col("segment").isNotNull())


def segment_metrics(df: DataFrame, y: str, p: str, t: float, cols) -> DataFrame:
    """Per (feature, segment): n, positives, base rate, ROC-AUC, PR-AUC, mean p, Brier,
    precision, recall; one-class segments skipped. One unpivot covers every feature."""
    keys = ["feature", "segment"]
    hist = cut_lineage(segments_long(df, y, p, cols).groupBy(*keys, F.col("__p").cast("double").alias("__p")).agg(
        F.sum(_y("__y")).alias("pos"), (F.count(F.lit(1)) - F.sum(_y("__y"))).alias("neg")))
    known = hist.filter(F.col("__p").isNotNull())
    n, scored = F.col("pos") + F.col("neg"), F.col("__p").isNotNull()
    extra = hist.groupBy(*keys).agg(F.sum(n).cast("bigint").alias("n"), F.try_divide(F.sum(F.col("__p") * n), F.sum(F.when(scored, n))).alias("mean_p"),
                                    (F.sum("pos") / F.sum(n)).alias("base_rate"))
    return _ranking(known, keys, skip_one_class=True).join(_at_threshold(hist, t, keys), keys).join(extra, keys).select(
        *keys, "n", "n_pos", "base_rate", "roc_auc", "pr_auc", "mean_p", "brier", "precision", "recall")


def fairness(df: DataFrame, y: str, p: str, t: float, cols) -> DataFrame:
    """Per (feature, segment): base rate, selection rate (share predicted 0), TPR, FPR,
    precision (NULL if nothing predicted positive); one-class segments skipped."""
    long = segments_long(df, y, p, cols)
    yy = _y("__y")
    pred = F.col("__p") >= F.lit(float(t))
    agg = long.groupBy("feature", "segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(yy).alias("n_positives"),
        F.count_if(~pred).alias("__n_pred0"),
        F.count_if(pred & (yy == 1)).alias("__tp"),
        F.count_if(pred & (yy == 0)).alias("__fp"),
        F.count_if(pred).alias("__npp"),
    ).filter((F.col("n_positives") > 0) & (F.col("n_positives") < F.col("n")))
    n = F.col("n").cast("double")
    npos = F.col("n_positives").cast("double")
    return agg.select(
        "feature", "segment", "n", F.col("n_positives").cast("bigint").alias("n_positives"),
        (npos / n).alias("base_rate"),
        (F.col("__n_pred0").cast("double") / n).alias("selection_rate"),
        (F.col("__tp").cast("double") / npos).alias("tpr"),
        (F.col("__fp").cast("double") / (n - npos)).alias("fpr"),
        F.try_divide(F.col("__tp").cast("double"), F.col("__npp").cast("double")).alias("precision"),
    )


def disparate_impact(fair: DataFrame, metrics=("selection_rate", "tpr", "fpr", "precision"), rule: float = 0.8) -> DataFrame:
    """min/max ratio across segments per (feature, metric); flagged below the rule."""
    long = fair.select("feature", "segment", *metrics).unpivot(["feature", "segment"], list(metrics), "metric", "value")
    agg = long.groupBy("feature", "metric").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    ratio = F.try_divide(F.col("min_value"), F.col("max_value"))
    return agg.withColumns({"ratio": ratio, "flagged": F.coalesce(ratio < F.lit(rule), F.lit(False))})


def calibration_gap(seg: DataFrame) -> DataFrame:
    """Mean predicted - base rate per segment, absolute and relative."""
    return seg.select("feature", "segment", "mean_p", "base_rate",
                      (F.col("mean_p") - F.col("base_rate")).alias("gap"),
                      F.try_divide(F.col("mean_p") - F.col("base_rate"), F.col("base_rate")).alias("relative_gap"))


def score_corr(df: DataFrame, cols) -> DataFrame:
    """Pairwise correlation of model scores."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return reduce(lambda x, z: x.unionByName(z),
                  [df.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a), F.col(b)).alias("corr")) for a, b in pairs])


def label_bias(naive: DataFrame, full: DataFrame, date: str = "issue_d", target: str = "target") -> DataFrame:
    """Monthly default rate under the naive (resolved-only) and the window labels, full outer by month."""
    a = naive.groupBy(F.trunc(F.col(date), "month").alias("month")).agg(F.avg(_y(target).cast("double")).alias("naive_rate"))
    b = full.groupBy(F.trunc(F.col(date), "month").alias("month")).agg(F.avg(_y(target).cast("double")).alias("window_rate"))
    return a.join(b, "month", "full_outer")


def perturbation_robustness(df: DataFrame, cols, key: str, score, sigmas, y: str = "target", seed: int = 42) -> DataFrame:
    """(sigma, pr_auc, delta_pr_auc) with every column multiplied by 1 + sigma * N(0, 1), noise keyed by (key, column, seed).

    ``score(rows)`` keeps ``sigma`` and ``y`` and adds ``p``. All strengths, and the unperturbed rows (sigma 0), are one job.
    """
    noise = df.withColumns({f"__z_{c}": keyed_normal(F.col(key), c, seed) for c in cols})
    each = noise.withColumn("sigma", F.explode(F.array(*[F.lit(float(s)) for s in [0.0, *sigmas]])))
    noisy = each.withColumns({c: F.col(c) * (F.lit(1.0) + F.col("sigma") * F.col(f"__z_{c}")) for c in cols}).drop(*[f"__z_{c}" for c in cols])
    ap = average_precision(score(noisy), y, "p", ["sigma"])  # one row per strength
    plain = F.max(F.when(F.col("sigma") == 0, F.col("pr_auc"))).over(Window.partitionBy(F.lit(0)))
    return ap.select("sigma", "pr_auc", (F.col("pr_auc") - plain).alias("delta_pr_auc")).filter(F.col("sigma") != 0)


def directional_expectation(df: DataFrame, col: str, delta: float, score) -> DataFrame:
    """(feature, delta, n, mean_change_p, share_up) when ``col`` is raised by ``delta``; ``score(rows)`` keeps ``moved`` and ``id`` and adds ``p``."""
    each = df.withColumn("moved", F.explode(F.array(F.lit(0), F.lit(1))))
    moved = each.withColumn(col, F.col(col) + F.when(F.col("moved") == 1, F.lit(float(delta))).otherwise(F.lit(0.0)))
    pairs = score(moved).groupBy("id").agg(F.max(F.when(F.col("moved") == 0, F.col("p"))).alias("p0"), F.max(F.when(F.col("moved") == 1, F.col("p"))).alias("p1"))
    return pairs.agg(F.lit(col).alias("feature"), F.lit(float(delta)).alias("delta"), F.count(F.lit(1)).alias("n"),
                     F.avg(F.col("p1") - F.col("p0")).alias("mean_change_p"), F.avg((F.col("p1") >= F.col("p0")).cast("double")).alias("share_up"))
