"""Learning and inference.

* Learners are ``pyspark.ml`` estimators on an assembled feature vector
  (distributed training; no data leaves the executors).
* Linear contributions are exact and SQL-expressible: coef * (x - mean) in
  margin space, as a long (id, feature, value) frame.
* A *scorecard* (weights = correlation of each standardised feature with the
  target, fit by one aggregate) gives a deterministic linear scorer whose
  contributions an independent SQL engine can reproduce.
* Tree contributions (path-dependent TreeSHAP) run in ``mapInPandas`` over the
  node tables of the fitted model, which are broadcast (size bounded by the
  number of nodes).
"""

from __future__ import annotations

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.exprs import decide, sigmoid
from riskframe.operators import features as M
from riskframe.operators.forest import forest_probability
from riskframe.operators.profile import long_numeric
from riskframe.session import checkpoint_dir, cut_lineage

# ------------------------------------------------------------------ scorecard


def fit_scorecard(train: DataFrame, numeric, y: str = "target") -> DataFrame:
    """(feature, median, mean, std, weight): scaler stats plus weight = corr(imputed x, y) on train."""
    stats = M.fit_scaler(train, numeric)
    long = long_numeric(train.select(F.col(y).cast("double").alias("__y"), *numeric), numeric, ids=["__y"])
    long = long.withColumnRenamed("column", "feature").join(F.broadcast(stats.select("feature", "median")), "feature")
    w = long.groupBy("feature").agg(F.corr(F.coalesce(F.col("value"), F.col("median")), F.col("__y")).alias("weight"))
    return cut_lineage(stats.join(w, "feature").fillna(0.0, subset=["weight"]))


def scorecard_rows(df: DataFrame, card: DataFrame, key: str, numeric) -> DataFrame:
    """L7 (linear), one row per record: id and ``contributions`` = array of (feature ``num__x``, value).

    value = weight * standardised x. The card (one row per feature, so bounded by the columns) becomes numbers in
    the expression: a record is scored where it lies, without subquery, unpivot, join or shuffle.
    """
    entries = {r.feature: r for r in card.filter(F.col("feature").isin(list(numeric))).collect()}

    def value(c):
        e = entries[c]
        z = (F.coalesce(F.col(c).cast("double"), F.lit(e.median)) - F.lit(e["mean"])) / F.lit(e.std)
        return F.struct(F.lit(f"num__{c}").alias("feature"), (F.lit(e.weight) * z).alias("value"))

    return df.select(F.col(key).alias("id"), F.array(*[value(c) for c in numeric]).alias("contributions"))


def scorecard_contributions(df: DataFrame, card: DataFrame, key: str, numeric) -> DataFrame:
    """L7 (linear), long: (id, feature, value)."""
    return scorecard_rows(df, card, key, numeric).select("id", F.inline("contributions"))


def scorecard_scores(rows: DataFrame, base: float = 0.0, with_contributions: bool = False) -> DataFrame:
    """L6 for the scorecard, from ``scorecard_rows``: margin = base + sum of contributions, p = sigmoid(margin)."""
    margin = F.aggregate("contributions", F.lit(float(base)), lambda s, c: s + c["value"])
    kept = ["contributions"] if with_contributions else []
    return rows.select("id", margin.alias("margin"), *kept).withColumn("p", sigmoid(F.col("margin")))


# ------------------------------------------------------------------ learners


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    """``features``: columns to put into one vector, or the name of a vector column (the sparse form of ``features.transform_sparse``)."""
    if isinstance(features, str):
        return df if features == out else df.withColumn(out, F.col(features))
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def vector_size(df: DataFrame, vector: str = "features") -> int:
    """Length of a vector column: from the attributes that the assembler left in the schema, else from the first row."""
    size = df.schema[vector].metadata.get("ml_attr", {}).get("num_attrs")
    return size if size is not None else df.select(vector).head()[vector].size


def fit_lr(df: DataFrame, features, y: str = "target", c: float = 1.0, balanced: bool = False, max_iter: int = 100):
    """L1: L2-regularised logistic regression; C=1 maps to regParam = 1/(C*n).

    ``balanced`` adds weights n / (2 * n_class) through a broadcast two-row class table.
    """
    n = df.count()
    data = assemble(df, features)
    weight_col = None
    if balanced:
        cls = df.groupBy(y).agg(F.count(F.lit(1)).alias("__nc"))
        data = data.join(F.broadcast(cls), y).withColumn("__w", F.lit(float(n)) / (F.lit(2.0) * F.col("__nc")))
        weight_col = "__w"
    lr = LogisticRegression(featuresCol="features", labelCol=y, regParam=1.0 / (c * n), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter)
    if weight_col:
        lr = lr.setWeightCol(weight_col)
    return lr.fit(data.withColumn(y, F.col(y).cast("double")))


def fit_rf(df: DataFrame, features, y: str = "target", trees: int = 100, depth: int = 12, seed: int = 42):
    """L2: random forest (depth bounded as Spark requires).

    Each row keeps the node it has reached in every tree (in memory, spilling to disk), so a level's pass does not walk from the roots
    again; the model is the same. A pass a level makes a short lineage, so those nodes are not checkpointed.
    """
    rf = RandomForestClassifier(featuresCol="features", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True, checkpointInterval=100)
    return rf.fit(assemble(df, features).withColumn(y, F.col(y).cast("double")))


def fit_gbt(df: DataFrame, features, y: str = "target", iters: int = 50, depth: int = 5, step: float = 0.1,
            subsample: float = 1.0, seed: int = 42, min_instances: int = 1, min_gain: float = 0.0, feature_subset: str | float = "all",
            max_bins: int = 32):
    """L3: gradient-boosted trees with log loss (Spark margin is half the log-odds).

    ``min_instances`` and ``min_gain`` bound a split, ``feature_subset`` says which features are tried per split (a share as 0.8, "sqrt", "all").
    """
    gbt = GBTClassifier(featuresCol="features", labelCol=y, maxIter=iters, maxDepth=depth, stepSize=step,
                        subsamplingRate=subsample, seed=seed, minInstancesPerNode=min_instances, minInfoGain=min_gain,
                        featureSubsetStrategy=str(feature_subset), maxBins=max_bins)
    return gbt.fit(assemble(df, features).withColumn(y, F.col(y).cast("double")))


def fit_mlp(df: DataFrame, features, y: str = "target", hidden=(128, 64), epochs: int = 30, block: int = 2048, seed: int = 42):
    """L4: multilayer perceptron [d, 128, 64, 2] (sigmoid hidden units)."""
    data = assemble(df, features)
    layers = [vector_size(data) if isinstance(features, str) else len(features), *hidden, 2]
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol=y, layers=layers, maxIter=epochs, blockSize=block, seed=seed)
    return mlp.fit(data.withColumn(y, F.col(y).cast("double")))


def score(df: DataFrame, model, features, t: float = 0.5, prob: str = "p") -> DataFrame:
    """Batch scoring: probability of class 1 and the decision p >= t. A two-class forest scores many rows at once."""
    rows, p = assemble(df, features), None
    if isinstance(model, RandomForestClassificationModel) and model.numClasses == 2:
        p = forest_probability(df.sparkSession, model, "features", checkpoint_dir(df.sparkSession))
    out = rows.withColumn(prob, p) if p is not None else model.transform(rows).withColumn(prob, vector_to_array(F.col("probability"))[1])
    return out.withColumn("pred", decide(prob, t)).drop("features", "rawPrediction", "probability", "prediction")


def lr_contributions(df: DataFrame, model, features, means: DataFrame, key: str) -> DataFrame:
    """L7 (linear model) on single columns: coef_f * (x_f - mean_f) per row in margin space, long form.

    ``means`` is (feature, mean) of the training matrix; the coefficient table
    (one row per feature) is broadcast.
    """
    spark = df.sparkSession
    coefs = spark.createDataFrame([(f, float(c)) for f, c in zip(features, model.coefficients.toArray())], "feature string, coef double")
    long = long_numeric(df, features, ids=[key]).withColumnRenamed("column", "feature")
    j = long.join(F.broadcast(coefs.join(means, "feature")), "feature")
    return j.select(F.col(key).alias("id"), "feature", (F.col("coef") * (F.col("value") - F.col("mean"))).alias("value"))


def coefficients(model, features, index: DataFrame | None = None) -> DataFrame:
    """(feature, coef) of a linear model; for the sparse form the names come from its ``index`` (joined by position)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    coefs = [float(c) for c in model.coefficients.toArray()]
    if index is None:
        return spark.createDataFrame(list(zip(features, coefs)), "feature string, coef double")
    at = spark.createDataFrame(list(enumerate(coefs)), "position long, coef double")
    return at.join(index.select("position", F.col("name").alias("feature")), "position").select("feature", "coef")


def odds_ratios(model, features, k: int = 10, index: DataFrame | None = None) -> DataFrame:
    """exp(coef) of the k largest and k smallest coefficients (coefficient table = one row per feature)."""
    df = coefficients(model, features, index).withColumn("odds_ratio", F.exp("coef"))
    top = df.orderBy(F.desc("coef"), "feature").limit(k).withColumn("side", F.lit("top"))
    bottom = df.orderBy(F.asc("coef"), "feature").limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def ensemble(df: DataFrame, cols, name: str = "p_ensemble") -> DataFrame:
    """Mean probability of several models (threshold re-tuned by E6 downstream)."""
    from riskframe.functions.exprs import mean_score

    return df.withColumn(name, mean_score(*cols))


def _tagged(train: DataFrame, folds: DataFrame, features, key: str) -> tuple[DataFrame, list, list[DataFrame]]:
    """(rows with fold and part, fold numbers, frames to give back after the search).

    Fits and scores read the rows many times, so they stay on the executors (memory, spilling to disk) for the search only,
    in as many parts as their cells ask for: each pass of a fit starts that many tasks, whatever the shuffle's number of partitions.
    """
    folds, sizes = _fold_sizes(folds)
    parts = M.task_count(train, sum(sizes.values()), _width(train, features))
    tagged = train.join(folds, key).repartition(parts, key).persist(StorageLevel.MEMORY_AND_DISK)
    return tagged, sorted(sizes), [tagged, folds]


def _width(train: DataFrame, features) -> int:
    return vector_size(train, features) if isinstance(features, str) else len(features)


def _fold_sizes(folds: DataFrame) -> tuple[DataFrame, dict]:
    """(the kept fold frame, rows of each fold)."""
    folds = folds.persist(StorageLevel.MEMORY_AND_DISK)
    return folds, {r["fold"]: r["n"] for r in folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= k rows


def search(train: DataFrame, folds: DataFrame, features, y: str, candidates, key: str, fit_fn, max_parallel: int = 4) -> DataFrame:
    """Candidate parameter sets scored by mean PR-AUC over expanding time folds.

    Every (candidate, fold) fit is a distributed Spark job; a driver thread pool
    only submits jobs concurrently. The fold frame is W2's long (key, fold, part).
    """
    from riskframe.operators.metrics import average_precision

    spark = train.sparkSession
    tagged, fold_ids, held = _tagged(train, folds, features, key)

    def run(ci_params):
        ci, params = ci_params
        aps = []
        for f in fold_ids:
            tr = tagged.filter((F.col("fold") == f) & (F.col("part") == "train")).drop("fold", "part")
            te = tagged.filter((F.col("fold") == f) & (F.col("part") == "test")).drop("fold", "part")
            model = fit_fn(tr, features, y, **params)
            scored = score(te, model, features)
            aps.append(average_precision(scored, y, "p").select("pr_auc").first()[0])
        return (ci, str(params), float(sum(aps) / len(aps)))

    try:
        with ThreadPoolExecutor(max_workers=max_parallel) as pool:
            results = list(pool.map(run, list(enumerate(candidates))))
    finally:
        for frame in held:
            frame.unpersist()
    # One row per candidate (a bounded summary of the fits).
    return spark.createDataFrame(results, "candidate int, params string, mean_pr_auc double")


def sample_trials(space: dict, n: int, seed: int = 42) -> list[dict]:
    """``n`` parameter sets drawn from ``space``: name -> list of choices, (low, high) of whole numbers or decimals, or ("log", low, high)."""
    rng = random.Random(seed)

    def draw(s):
        if isinstance(s, list):
            return rng.choice(s)
        if s[0] == "log":
            return min(max(math.exp(rng.uniform(math.log(s[1]), math.log(s[2]))), s[1]), s[2])
        return rng.randint(*s) if all(isinstance(x, int) for x in s) else rng.uniform(*s)

    return [{k: draw(s) for k, s in space.items()} for _ in range(n)]


def halving_search(train: DataFrame, folds: DataFrame, features, y: str, trials: list[dict], key: str, fit_fn, trials_path: str,
                   keep: float = 1 / 3, max_parallel: int = 4) -> DataFrame:
    """L5 by successive halving: (trial, params, folds, mean_pr_auc, rank), best first.

    All trials are scored on the first time fold; of each rung only the best ``keep`` go on to the next fold, so weak
    candidates cost one fit each. Every finished (trial, fold) is a row of the trials table under its own key in
    ``trials_path``: a stopped search that is started again with the same trials does only what is missing. Trials that got
    further rank first, then the mean over their folds, then the trial number. Fits are Spark jobs; a thread
    pool only submits them. A rung's fits read the rows of their own fold only, kept on the executors for the rung, and
    a fit's scores are computed once.
    """
    from riskframe.operators.metrics import average_precision
    from riskframe.sources.io import append_run, read_runs

    spark = train.sparkSession
    names = [json.dumps(t, sort_keys=True) for t in trials]

    def table():
        try:
            return read_runs(spark, trials_path)
        except FileNotFoundError:
            return spark.createDataFrame([], "trial int, params string, pr_auc double, fold int")

    done = {(r.trial, r.fold): r.pr_auc for r in table().collect() if r.params == names[r.trial]}  # one row per finished fit
    folds, sizes = _fold_sizes(folds)
    fold_ids, width, held = sorted(sizes), _width(train, features), [folds]
    if train.storageLevel == StorageLevel.NONE:  # else the caller keeps them
        held.append(train.persist(StorageLevel.MEMORY_AND_DISK))

    @contextmanager
    def kept(fold):
        """The fold's (train, test) rows, on the executors while they are used."""
        rows = train.join(folds.filter(F.col("fold") == fold), key).drop("fold").repartition(M.task_count(train, sizes[fold], width), key)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield tuple(rows.filter(F.col("part") == p).drop("part") for p in ("train", "test"))
        finally:
            rows.unpersist()

    def run(trial, fold, rows, test):
        model = fit_fn(rows, features, y, **trials[trial])
        scored = score(test, model, features).select(y, "p").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            ap = average_precision(scored, y, "p").select("pr_auc").first()[0]
        finally:
            scored.unpersist()
        row = spark.createDataFrame([(trial, names[trial], ap, int(fold))], "trial int, params string, pr_auc double, fold int")
        append_run(row.coalesce(1), trials_path, f"t{trial}-f{fold}", "fold")
        done[trial, fold] = ap

    def mean(trial, upto):
        values = [done[trial, f] for f in fold_ids[:upto]]
        return sum(-1.0 if v is None else v for v in values) / len(values)

    alive = list(range(len(trials)))
    try:
        with ThreadPoolExecutor(max_workers=max_parallel) as pool:
            for rung, fold in enumerate(fold_ids):
                missing = [t for t in alive if (t, fold) not in done]
                if missing:
                    with kept(fold) as (rows, test):
                        list(pool.map(lambda t: run(t, fold, rows, test), missing))  # noqa: B023 (used up within the rung)
                if rung + 1 < len(fold_ids):
                    best = sorted(alive, key=lambda t: (-mean(t, rung + 1), t))
                    alive = sorted(best[:max(1, math.ceil(keep * len(best)))])
    finally:
        for frame in held:
            frame.unpersist()
    known = table().join(spark.createDataFrame(list(enumerate(names)), "trial int, params string"), ["trial", "params"])
    out = known.groupBy("trial", "params").agg(F.count(F.lit(1)).cast("int").alias("folds"), F.avg(F.coalesce("pr_auc", F.lit(-1.0))).alias("mean_pr_auc"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("folds"), F.desc("mean_pr_auc"), "trial")  # one row per trial
    return out.withColumn("rank", F.row_number().over(order)).orderBy("rank")


def savable_model(features, estimator) -> Pipeline:
    """A savable pipeline (assembler, unless the features are one vector already, and estimator) for S16/L11 model storage."""
    if isinstance(features, str):
        return Pipeline(stages=[estimator])
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), estimator])
