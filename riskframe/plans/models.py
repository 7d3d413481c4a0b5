"""Bound learning, inference, robustness and run-registry queries.

Learner outputs depend on optimiser details, so those queries are checked by
rows (plus unit tests); the run registry is built from the exact evaluations of
the two deterministic scores and is oracle-checked.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import features as M
from riskframe.operators import metrics as E
from riskframe.operators import ml as L
from riskframe.operators import relational as R
from riskframe.operators import runs as RUNS
from riskframe.plans.common import r6
from riskframe.plans.evaluation import _GRID, rank_sql, thr_sql
from riskframe.plans.registry import register
from riskframe.plans.relational import _CARD_CTES
from riskframe.session import checkpoint_dir, cut_lineage
from riskframe.sources import bindings as B
from riskframe.sources import versions as V
from riskframe.sources.bindings import oracle
from riskframe.specs import CostSpec
from riskframe.streaming.jobs import scratch

NUM = list(B.LOAN_ROLES.numeric)
CAT = list(B.LOAN_ROLES.categorical)
RUN_METRICS = ["roc_auc", "pr_auc", "brier", "precision", "recall"]


FEATURES = "features"  # the sparse form's vector column


def matrix(spark, sf, df=None, keep=("loan_id", "split", "target")):
    """Sparse feature matrix of every split (stats fit on train), the vector column's name, and the index of its positions."""
    lab = B.labelled(spark, sf)
    stats = M.fit(lab.filter(F.col("split") == "train"), NUM, CAT)
    index = M.feature_index(stats, NUM)
    return M.transform_sparse(df if df is not None else lab, stats, index, list(keep), NUM, CAT), FEATURES, index


def _fit_lr(spark, sf):
    rows, feats, index = matrix(spark, sf)
    model = L.fit_lr(rows.filter(F.col("split") == "train"), feats, "target", c=1.0)
    return rows, feats, model, index


@register("L1_L6_logistic_regression_scores")
def q_lr(spark, sf):
    wide, feats, model, _ = _fit_lr(spark, sf)
    return L.score(wide.filter(F.col("split") == "test"), model, feats, 0.5).select("loan_id", "split", "target", "p", "pred")


@register("L1_balanced_lr_metrics")
def q_lr_balanced(spark, sf):
    wide, feats, index = matrix(spark, sf)
    model = L.fit_lr(wide.filter(F.col("split") == "train"), feats, "target", balanced=True)
    return E.ranking_metrics(L.score(wide, model, feats), "target", "p", ["split"])


@register("L2_random_forest_metrics")
def q_rf(spark, sf):
    wide, feats, index = matrix(spark, sf)
    model = L.fit_rf(wide.filter(F.col("split") == "train"), feats, "target", trees=100, depth=10, seed=42)
    return E.ranking_metrics(L.score(wide, model, feats), "target", "p", ["split"], stored=True)


@register("L3_gradient_boosting_metrics")
def q_gbt(spark, sf):
    wide, feats, index = matrix(spark, sf)
    model = L.fit_gbt(wide.filter(F.col("split") == "train"), feats, "target", iters=50, depth=5, step=0.1)
    return E.ranking_metrics(L.score(wide, model, feats), "target", "p", ["split"])


@register("L4_mlp_metrics")
def q_mlp(spark, sf):
    wide, feats, index = matrix(spark, sf)
    model = L.fit_mlp(wide.filter(F.col("split") == "train"), feats, "target", hidden=(128, 64), epochs=30)
    return E.ranking_metrics(L.score(wide, model, feats), "target", "p", ["split"])


@register("L5_time_fold_search")
def q_search(spark, sf):
    wide, feats, index = matrix(spark, sf)
    lab = B.labelled(spark, sf).filter(F.col("split") == "train")
    train = wide.filter(F.col("split") == "train").join(lab.select("loan_id", "issue_d"), "loan_id")
    folds = R.time_folds(lab.select("loan_id", "issue_d"), "issue_d", "loan_id", 5).select("loan_id", "fold", "part")
    return L.search(train, folds, feats, "target", [{"c": 0.1}, {"c": 1.0}], "loan_id", L.fit_lr, max_parallel=2)


#: Eight parameters of the boosted trees: six with the original study's ranges, and two bounds of a split for its penalties, which Spark lacks.
BOOSTING_SPACE = {"iters": (100, 1000), "depth": (3, 10), "step": ("log", 0.01, 0.3), "subsample": (0.5, 1.0), "min_instances": (1, 10),
                  "min_gain": (0.0, 0.01), "feature_subset": (0.5, 1.0), "max_bins": (8, 64)}


@register("L5_halving_search")
def q_halving(spark, sf):
    """50 trials of 8 boosting parameters over 5 expanding time folds; two thirds of each rung stop."""
    rows, feats, _ = matrix(spark, sf)
    lab = B.labelled(spark, sf).filter(F.col("split") == "train")
    folds = R.time_folds(lab.select("loan_id", "issue_d"), "issue_d", "loan_id", 5).select("loan_id", "fold", "part")
    trials = L.sample_trials(BOOSTING_SPACE, 50)
    return L.halving_search(rows.filter(F.col("split") == "train"), folds, feats, "target", trials, "loan_id", L.fit_gbt, scratch(spark, "trials"), max_parallel=8)


@register("L9_odds_ratios")
def q_odds(spark, sf):
    _rows, feats, model, index = _fit_lr(spark, sf)
    return L.odds_ratios(model, feats, 10, index)


@register("L10_ensemble_evaluation")
def q_ensemble(spark, sf):
    wide, feats, index = matrix(spark, sf)
    tr = wide.filter(F.col("split") == "train")
    lr = L.fit_lr(tr, feats, "target")
    gbt = L.fit_gbt(tr, feats, "target", iters=30, depth=4)
    a = L.score(wide, lr, feats).select("loan_id", "split", "target", F.col("p").alias("p_lr"))
    b = L.score(wide, gbt, feats).select("loan_id", F.col("p").alias("p_gbt"))
    ens = L.ensemble(a.join(b, "loan_id"), ["p_lr", "p_gbt"], "p")
    return E.evaluate(ens, "target", "p", "split", CostSpec(), "val")


def _scorer(spark, sf, *kept):
    """Rows -> (id, kept columns, p) by the scorecard fitted on train."""
    card = L.fit_scorecard(B.labelled(spark, sf).filter(F.col("split") == "train"), NUM)

    def score(rows):
        keyed = rows.withColumn("__id", F.struct(F.col("loan_id").alias("id"), *kept))
        return L.scorecard_scores(L.scorecard_rows(keyed, card, "__id", NUM)).select("id.*", "p")

    return score


def _z_sql(c: str, seed: int) -> str:
    m = f"md5(concat_ws('|', CAST(loan_id AS VARCHAR), '{c}', '{seed}'))"
    h = lambda at: f"CAST(CAST(concat('0x', substr({m}, {at}, 8)) AS BIGINT) AS DOUBLE)"
    return f"sqrt(-2.0 * ln(({h(1)} + 1.0) / 4294967296.0)) * cos(6.283185307179586::DOUBLE * ({h(9)} / 4294967296.0))"


_SIGMAS = (0.02, 0.05, 0.10)
_CARD_ONLY = {k: _CARD_CTES[k] for k in ("tr", "te", "med", "card")}
_MARGIN = " + ".join(f"(SELECT c.weight * (coalesce(CAST(x.{c} AS DOUBLE), c.median) - c.mean) / c.std FROM card c WHERE c.feature = '{c}')" for c in NUM)
_NOISY = "SELECT loan_id, target, s.sigma, " + ", ".join(f"CAST({c} AS DOUBLE) * (1.0 + s.sigma * ({_z_sql(c, 42)})) AS {c}" for c in NUM) + \
    " FROM te, (VALUES (0.0::DOUBLE), " + ", ".join(f"({x}::DOUBLE)" for x in _SIGMAS) + ") s(sigma)"


@register("E22_perturbation_robustness", oracle(
    "SELECT sigma, round(pr_auc, 6) AS pr_auc, round(pr_auc - (SELECT pr_auc FROM ap WHERE sigma = 0), 6) AS delta_pr_auc FROM ap WHERE sigma <> 0",
    "labelled", extra={**_CARD_ONLY, "noisy": _NOISY, "ps": f"SELECT sigma, target, 1 / (1 + exp(-({_MARGIN}))) AS p FROM noisy x",
                       "ap": """SELECT sigma, sum(CAST(pos AS DOUBLE) / tot * cp / (cp + cn)) AS pr_auc FROM (
  SELECT *, sum(pos) OVER (PARTITION BY sigma ORDER BY p DESC) AS cp, sum(neg) OVER (PARTITION BY sigma ORDER BY p DESC) AS cn, sum(pos) OVER (PARTITION BY sigma) AS tot
  FROM (SELECT sigma, p, sum(target) AS pos, count(*) - sum(target) AS neg FROM ps GROUP BY sigma, p) h) c GROUP BY sigma"""}))
def q_perturb(spark, sf):
    test = B.labelled(spark, sf).filter(F.col("split") == "test")
    return r6(E.perturbation_robustness(test, NUM, "loan_id", _scorer(spark, sf, "target", "sigma"), _SIGMAS))


@register("E23_directional_expectation", oracle(
    "SELECT 'dti' AS feature, 5.0::DOUBLE AS delta, count(*) AS n, round(avg(p1 - p0), 6) AS mean_change_p, round(avg(CAST(p1 >= p0 AS INTEGER)), 6) AS share_up FROM ps",
    "labelled", extra={**_CARD_ONLY, "ps": f"""SELECT 1 / (1 + exp(-({_MARGIN}))) AS p0,
  1 / (1 + exp(-({_MARGIN.replace("CAST(x.dti AS DOUBLE)", "CAST(x.dti AS DOUBLE) + 5.0")}))) AS p1 FROM te x"""}))
def q_directional(spark, sf):
    test = B.labelled(spark, sf).filter(F.col("split") == "test")
    return r6(E.directional_expectation(test, "dti", 5.0, _scorer(spark, sf, "moved")))


# ---------------------------------------------------------------- run registry on the two deterministic scores


def _evals(spark, sf):
    s = B.scored(spark, sf)
    a = E.evaluate(s, "y", "p", "split", CostSpec(), "val").withColumn("run_name", F.lit("p"))
    b = E.evaluate(s.withColumn("p", F.col("p2")), "y", "p", "split", CostSpec(), "val").withColumn("run_name", F.lit("p2"))
    return a.unionByName(b)


def _runs_long(spark, sf):
    # Logged metrics are stored rounded to 6 places, as a metrics file would hold them.
    return RUNS.flatten_metrics(r6(_evals(spark, sf)), "run_name", "split", RUN_METRICS)


def _e7_sql(name: str, src: str) -> str:
    t = f"(SELECT t FROM (SELECT t, CAST(fp AS DOUBLE) * 2000 + CAST(fn AS DOUBLE) * 10000 AS cost, i FROM c_{name}) z ORDER BY cost, i LIMIT 1)"
    return f"""SELECT '{name}' AS run_name, r.split, r.roc_auc, r.pr_auc, m.brier, m.precision, m.recall
FROM ({rank_sql(src, ['split'])}) r JOIN ({thr_sql(src, ['split'], t)}) m ON r.split = m.split"""


def _curve(src: str) -> str:
    return f"""SELECT g.i, g.t, count(*) FILTER (WHERE s.y = 0 AND s.p >= g.t) AS fp, count(*) FILTER (WHERE s.y = 1 AND NOT (s.p >= g.t)) AS fn
FROM g, {src} s WHERE s.split = 'val' GROUP BY g.i, g.t"""


_RUN_CTES = {
    "g": _GRID,
    "s_p": "SELECT id, y, p, split FROM scored",
    "s_p2": "SELECT id, y, p2 AS p, split FROM scored",
    "c_p": _curve("s_p"),
    "c_p2": _curve("s_p2"),
    "ev": _e7_sql("p", "s_p") + " UNION ALL " + _e7_sql("p2", "s_p2"),
    "rl": " UNION ALL ".join(f"SELECT run_name, lower(split || '_{m}') AS key, {m} AS value FROM ev" for m in RUN_METRICS),
}


@register("S12_runs_long", oracle("SELECT run_name, key, round(value, 6) AS value FROM rl", "scored", extra=_RUN_CTES))
def q_runs_long(spark, sf):
    return r6(_runs_long(spark, sf))


@register("S12_runs_table", oracle("""SELECT run_name, 'metrics' AS kind, key, round(value, 6) AS value FROM rl
UNION ALL SELECT r, 'selected', NULL, CAST(r = 'p' AS INTEGER)::DOUBLE FROM (VALUES ('p'), ('p2')) x(r)
UNION ALL SELECT r, 'score column', r, NULL FROM (VALUES ('p'), ('p2')) x(r)""", "scored", extra=_RUN_CTES))
def q_runs_table(spark, sf):
    """The table of runs with its metrics, params and tags maps, opened up into rows."""
    long = _runs_long(spark, sf)
    params = long.select("run_name").distinct().select("run_name", F.lit("score_column").alias("key"), F.col("run_name").alias("value"))
    tags = long.select("run_name").distinct().select("run_name", F.lit("selected").alias("key"),
                                                     (F.col("run_name") == "p").cast("string").alias("value"))
    runs = cut_lineage(RUNS.runs_table(long, params, tags))
    part = lambda kind, key, value: (F.lit(kind).alias("kind"), key.alias("key"), value.cast("double").alias("value"))
    metrics = runs.select("run_name", F.explode("metrics").alias("k", "v")).select("run_name", *part("metrics", F.col("k"), F.col("v")))
    tags = runs.select("run_name", *part("selected", F.lit(None).cast("string"), (F.col("tags")["selected"] == "true").cast("int")))
    names = runs.select("run_name", *part("score column", F.col("params")["score_column"], F.lit(None)))
    return r6(metrics.unionByName(tags).unionByName(names))


@register("S13_query_runs", oracle("SELECT run_name, key, round(value, 6) AS value FROM rl WHERE key = 'test_pr_auc' AND value > 0", "scored",
                                   extra=_RUN_CTES))
def q_query_runs(spark, sf):
    return r6(RUNS.query_runs(_runs_long(spark, sf), "test_pr_auc"))


@register(
    "S13_compare_runs",
    oracle("""SELECT coalesce(a.key, b.key) AS key, round(a.value, 6) AS value_a, round(b.value, 6) AS value_b, round(b.value - a.value, 6) AS delta
FROM (SELECT * FROM rl WHERE run_name = 'p') a FULL OUTER JOIN (SELECT * FROM rl WHERE run_name = 'p2') b ON a.key = b.key""",
           "scored", extra=_RUN_CTES),
)
def q_compare_runs(spark, sf):
    return r6(RUNS.compare_runs(_runs_long(spark, sf), "p", "p2"))


@register(
    "E24_compare_models",
    oracle("""SELECT key, round(max(value) FILTER (WHERE run_name = 'p'), 6) AS p, round(max(value) FILTER (WHERE run_name = 'p2'), 6) AS p2,
  round(max(value) FILTER (WHERE run_name = 'p2') - max(value) FILTER (WHERE run_name = 'p'), 6) AS lift_p2 FROM rl GROUP BY key""",
           "scored", extra=_RUN_CTES),
)
def q_compare_models(spark, sf):
    return r6(RUNS.compare_models(_runs_long(spark, sf), ["p", "p2"], "p"))


@register("S14_metrics_to_json", oracle("SELECT run_name, split, roc_auc, pr_auc, brier, precision, recall FROM ev", "scored", extra=_RUN_CTES))
def q_metrics_json(spark, sf):
    """Each evaluation as a JSON document, read back as a reader of the document would."""
    docs = RUNS.metrics_to_json(_evals(spark, sf), ["run_name", "split"], RUN_METRICS + ["threshold", "tn", "fp", "fn", "tp"])
    got = F.from_json("document", ", ".join(f"{m} double" for m in RUN_METRICS))
    return r6(docs.select("run_name", "split", got.alias("m")).select("run_name", "split", "m.*"))


_MEAN_CTES = {"g": _GRID, "s_m": "SELECT id, y, (p + p2) / 2.0 AS p, split FROM scored", "c_m": _curve("s_m"), "ev": _e7_sql("m", "s_m")}


@register("L10_F21_mean_score", oracle("SELECT split, roc_auc, pr_auc, brier, precision, recall FROM ev", "scored", extra=_MEAN_CTES))
def q_mean_score(spark, sf):
    """The mean of the two scores, its threshold tuned anew on val."""
    ens = L.ensemble(B.scored(spark, sf).select("y", "split", "p", "p2"), ["p", "p2"], "p_ensemble")
    return r6(E.evaluate(ens, "y", "p_ensemble", "split", CostSpec(), "val").select("split", *RUN_METRICS))


@register("L11_S16_model_registry")
def q_registry(spark, sf):
    """Fit two models, publish each as a new version in the shared folder, register, promote by val PR-AUC, resolve and score.

    A version's folder is never written again, and the alias moves only from the version it was seen at.
    """
    from pyspark.ml.classification import LogisticRegression

    rows, feats, _ = matrix(spark, sf)
    tr = rows.filter(F.col("split") == "train").withColumn("target", F.col("target").cast("double"))
    root = f"{checkpoint_dir(spark).rstrip('/')}/riskframe-models/credit_lr"
    _, champion_before = V.alias_state(spark, root, "champion")
    n, entries = tr.count(), []
    for c in (0.1, 1.0):
        est = LogisticRegression(featuresCol="features", labelCol="target", regParam=1.0 / (c * n), standardization=False)
        model = L.savable_model(feats, est).fit(tr)
        version = V.publish(spark, root, lambda folder, m=model: m.write().save(f"{folder}/model"))
        val = model.transform(rows.filter(F.col("split") == "val")).withColumn("p", vector_to_array(F.col("probability"))[1])
        ap = E.average_precision(val, "target", "p").select("pr_auc").first()[0]
        entries.append(("credit_lr", f"{V.folder_of(spark, root, version)}/model", float(ap), version))
    reg = RUNS.promote(spark.createDataFrame(entries, "name string, path string, metric double, version int"), "metric", "champion")
    best = RUNS.resolve_model(reg, "credit_lr", "champion").first()
    V.set_alias(spark, root, "champion", best["version"], expected=champion_before)
    _, version = V.alias_state(spark, root, "champion")
    path = f"{V.folder_of(spark, root, version)}/model"
    scored = PipelineModel.load(path).transform(rows.filter(F.col("split") == "test")).withColumn("p", vector_to_array(F.col("probability"))[1])
    return scored.select("loan_id", "p", F.lit(version).alias("version"), F.lit(path).alias("path"))


@register("L7_tree_contributions_top5")
def q_tree_contrib(spark, sf):
    """TreeSHAP contributions (log-odds) of a GBT model for test loans, dummies summed to their column, top 5 per loan (rows-only; additivity unit-tested)."""
    from riskframe.operators import treeshap

    wide, feats, index = matrix(spark, sf)
    model = L.fit_gbt(wide.filter(F.col("split") == "train"), feats, "target", iters=20, depth=4)
    contrib = treeshap.gbt_contributions(wide.filter(F.col("split") == "test"), model, feats, "loan_id", checkpoint_dir(spark), index)
    summed = treeshap.sum_to_parents(contrib, CAT)
    return R.top_reasons(summed.filter(F.col("feature") != "__base__"), 5)


@register("L7_forest_contributions_top5")
def q_forest_contrib(spark, sf):
    """Contributions (probability of default) of a random forest for test loans, dummies summed to their column, top 5 per loan."""
    from riskframe.operators import treeshap

    wide, feats, index = matrix(spark, sf)
    model = L.fit_rf(wide.filter(F.col("split") == "train"), feats, "target", trees=20, depth=6)
    contrib = treeshap.forest_contributions(wide.filter(F.col("split") == "test"), model, feats, "loan_id", checkpoint_dir(spark), index)
    summed = treeshap.sum_to_parents(contrib, CAT)
    return R.top_reasons(summed.filter(F.col("feature") != "__base__"), 5)
