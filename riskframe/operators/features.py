"""Feature pipeline: fit on train, transform every split.

Fitting is one aggregate job on the train split that yields a small **stats
frame** (one row per numeric feature, one row per category level). Three output forms:

* sparse (``features`` vector), for learners: positions come from a stored
  (feature, category) -> position table, joined per column; the vocabulary never
  reaches the driver, whatever its size;
* long (``key, name, value``), fully lazy: the same matrix as rows;
* wide (``num__x``, ``cat__c_v`` columns), for small vocabularies: the column
  list is the fitted vocabulary, read once to define the projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.profile import long_numeric, long_text
from riskframe.operators.windowing import fit_quantiles, running_sums
from riskframe.session import cut_lineage

MISSING = "missing"
#: Matrix cells (rows times columns) that one task should hold; a learner keeps four bytes or more of each.
TASK_CELLS = 8_000_000
#: Fewer rows than this are not worth a task of their own, however wide (a sparse row holds few of its columns).
TASK_ROWS = 5_000
#: Levels of a column that are sent to every task of a large matrix.
SENT_LEVELS = 100_000


def task_count(df: DataFrame, rows: int, width: int) -> int:
    """Tasks for a matrix: of about ``TASK_CELLS`` cells each, and at least one a core, but of no less than ``TASK_ROWS`` rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(max(cores, math.ceil(rows * width / TASK_CELLS)), math.ceil(rows / TASK_ROWS)))


def fit_median(train: DataFrame, cols, exact: bool = True) -> DataFrame:
    """M1: (feature, median) of the non-null train values (linear interpolation; distributed exact by default)."""
    fitted = fit_quantiles(train, cols, [0.5], exact)
    return train.sparkSession.createDataFrame([(c, q[0]) for c, q in fitted.items()], "feature string, median double")


def fit_scaler(train: DataFrame, cols, medians: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """M1 + M2: (feature, median, mean, std) with mean and *population* std of the imputed values.

    A zero std is stored as 1.0 (dividing by 1 leaves the centred value).
    """
    med = medians if medians is not None else fit_median(train, cols, exact)
    long = long_numeric(train, cols).withColumnRenamed("column", "feature").join(F.broadcast(med), "feature")
    x = F.coalesce(F.col("value"), F.col("median"))
    stats = long.groupBy("feature", "median").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("__sd"))
    return stats.select("feature", "median", "mean",
                        F.when(F.col("__sd") == 0, F.lit(1.0)).otherwise(F.col("__sd")).alias("std"))


def fill_missing(df: DataFrame, cols, token: str = MISSING) -> DataFrame:
    """M3: constant imputation of categoricals."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(token)) for c in cols})


def fit_onehot(train: DataFrame, cols) -> DataFrame:
    """M4: (feature, category, position) from train after the 'missing' fill, lexical order."""
    long = long_text(fill_missing(train, cols), cols).select(F.col("column").alias("feature"), F.col("value").alias("category"))
    vocab = long.distinct().withColumn("__one", F.lit(1))
    # a two-level running count: a feature with very many levels is not ranked by one task
    ranked = running_sums(vocab, "category", ["__one"], ["feature"])
    return ranked.select("feature", "category", (F.col("cum___one") - 1).alias("position"))


def fit(train: DataFrame, numeric, categorical, exact: bool = True) -> DataFrame:
    """Fitted stats frame of the column transformer.

    Rows: (kind 'num', feature, median, mean, std, NULL) and
    (kind 'cat', feature, NULL, NULL, NULL, category).
    """
    parts = []
    if numeric:
        s = fit_scaler(train, numeric, exact=exact)
        parts.append(s.select(F.lit("num").alias("kind"), "feature", "median", "mean", "std", F.lit(None).cast("string").alias("category")))
    if categorical:
        v = fit_onehot(train, categorical)
        parts.append(v.select(F.lit("cat").alias("kind"), "feature", *[F.lit(None).cast("double").alias(c) for c in ("median", "mean", "std")], "category"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Fitting is an action (like an ML Estimator): the small stats frame is
    # checkpointed to the shared folder so transforms and iterative learners
    # never re-run the fitting job.
    return cut_lineage(out)


def output_name(kind: Column, feature: Column, category: Column) -> Column:
    return F.when(kind == "num", F.concat(F.lit("num__"), feature)).otherwise(F.concat(F.lit("cat__"), feature, F.lit("_"), category))


def transform_long(df: DataFrame, stats: DataFrame, key: str, numeric, categorical) -> DataFrame:
    """M5 long form: (key, name, value) with standardised numerics and one row per present one-hot level.

    Unknown categories produce no row (all-zero one-hot); nothing is dropped.
    """
    parts = []
    if numeric:
        ns = F.broadcast(stats.filter(F.col("kind") == "num").select("feature", "median", "mean", "std"))
        nl = long_numeric(df, numeric, ids=[key]).withColumnRenamed("column", "feature").join(ns, "feature")
        z = (F.coalesce(F.col("value"), F.col("median")) - F.col("mean")) / F.col("std")
        parts.append(nl.select(key, F.concat(F.lit("num__"), F.col("feature")).alias("name"), z.alias("value")))
    if categorical:
        cs = stats.filter(F.col("kind") == "cat").select("feature", "category")
        cl = long_text(fill_missing(df, categorical), categorical, ids=[key]).select(
            key, F.col("column").alias("feature"), F.col("value").alias("category"))
        hit = cl.join(cs, ["feature", "category"])  # broadcast only if its measured size allows
        parts.append(hit.select(key, F.concat(F.lit("cat__"), F.col("feature"), F.lit("_"), F.col("category")).alias("name"),
                                F.lit(1.0).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def transform_wide(df: DataFrame, stats: DataFrame, keep, numeric, categorical, max_columns: int = 5000) -> DataFrame:
    """M5 wide form: ``num__x`` and ``cat__c_v`` double columns (remainder dropped except ``keep``).

    Numeric statistics enter as one map (a scalar subquery). The one-hot columns
    are the fitted vocabulary, which is read to the driver only after its size is
    checked against ``max_columns``; a larger vocabulary belongs in the long form.
    """
    whole = stats.filter(F.col("kind") == "num").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "mean", "std")))).alias("m")).scalar()
    if numeric:
        df = df.withColumn("__stats", whole)
    cols = [F.col(k) for k in keep]
    for c in numeric:
        e = F.col("__stats")[c]
        cols.append(((F.coalesce(F.col(c).cast("double"), e["median"]) - e["mean"]) / e["std"]).alias(f"num__{c}"))
    levels = stats.filter(F.col("kind") == "cat").select("feature", "category")
    if levels.limit(max_columns + 1).count() > max_columns:
        raise ValueError(f"more than {max_columns} one-hot levels: use transform_long")
    vocab = levels.orderBy("feature", "category").collect()
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in categorical}
    for r in vocab:
        cols.append(F.when(filled[r["feature"]] == F.lit(r["category"]), F.lit(1.0)).otherwise(F.lit(0.0))
                    .alias(f"cat__{r['feature']}_{r['category']}"))
    return df.select(*cols)


def feature_index(stats: DataFrame, numeric) -> DataFrame:
    """(position, feature, category, name, level, n_levels): places of the sparse form's columns, stored like the stats.

    Numerics come first in their given order, then the levels by (feature, category). A level's number within its feature is
    a two-level running count, so no task ranks a whole vocabulary; only the (few) features are ranked in one window.
    """
    spark = stats.sparkSession
    numeric = list(numeric)
    nums = spark.createDataFrame([(i, c) for i, c in enumerate(numeric)], "position long, feature string")
    nums = nums.select("position", "feature", F.lit(None).cast("string").alias("category"), F.lit(None).cast("long").alias("level"), F.lit(1).cast("long").alias("n_levels"))
    levels = stats.filter(F.col("kind") == "cat").select("feature", "category").withColumn("one", F.lit(1))
    ranked = running_sums(levels, "category", ["one"], ["feature"], total_prefix="all_")
    sizes = levels.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))  # one row per feature
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("feature").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("feature", (before + F.lit(len(numeric))).alias("offset"))
    cats = ranked.join(F.broadcast(offsets), "feature").select(
        (F.col("offset") + F.col("cum_one") - 1).alias("position"), "feature", "category", (F.col("cum_one") - 1).cast("long").alias("level"),
        F.col("all_one").cast("long").alias("n_levels"))
    name = F.when(F.col("category").isNull(), F.concat(F.lit("num__"), "feature")).otherwise(F.concat(F.lit("cat__"), "feature", F.lit("_"), "category"))
    return cut_lineage(nums.unionByName(cats).withColumn("name", name))


def transform_sparse(df: DataFrame, stats: DataFrame, index: DataFrame, keep, numeric, categorical, out: str = "features") -> DataFrame:
    """M5 sparse form: ``keep`` plus one vector, standardised numerics first, then one entry for each known level.

    A category of ``df`` finds its level by a join per column (broadcast only where Spark measures the vocabulary as small, else
    a shuffle with AQE's skew handling); an unknown one has no entry. Encoding and assembly are ML stages on the executors.
    The rows of a matrix too large for one task are dealt evenly first, so that no task of a learner grows with the input;
    its vocabularies of at most ``SENT_LEVELS`` levels (their sizes are known here) are broadcast without a shuffle of the rows.
    """
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    entries = {r.feature: r for r in stats.filter(F.col("kind") == "num").collect()}  # one row per numeric feature
    sizes = {r.feature: r.n for r in index.filter(F.col("category").isNotNull()).groupBy("feature").agg(F.max("n_levels").alias("n")).collect()}
    categorical = [c for c in sorted(categorical) if c in sizes]
    nums = [((F.coalesce(F.col(c).cast("double"), F.lit(entries[c].median)) - F.lit(entries[c]["mean"])) / F.lit(entries[c].std)).alias(f"__n{i}")
            for i, c in enumerate(numeric)]
    cats = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(f"__c{i}") for i, c in enumerate(categorical)]
    rows = df.select(*keep, *nums, *cats)
    n, width = df.count(), len(numeric) + sum(sizes[c] for c in categorical)
    large = n * width > TASK_CELLS
    if large:
        rows = rows.repartition(task_count(df, n, width))
    for i, c in enumerate(categorical):
        levels = index.filter((F.col("feature") == c) & F.col("category").isNotNull()).select(F.col("category").alias(f"__c{i}"), F.col("level").alias("__level"))
        if large and sizes[c] <= SENT_LEVELS:
            levels = F.broadcast(levels)
        # the number after the last level stands for an unknown category
        rows = rows.join(levels, f"__c{i}", "left").withColumn(f"__l{i}", F.coalesce(F.col("__level"), F.lit(sizes[c])).cast("double")).drop("__level")
    parts = [f"__n{i}" for i in range(len(numeric))]
    if categorical:
        places, parts = [f"__l{i}" for i in range(len(categorical))], parts + [f"__v{i}" for i in range(len(categorical))]
        last = df.sparkSession.createDataFrame([tuple(float(sizes[c] - 1) for c in categorical)], places)
        encoder = OneHotEncoder(inputCols=places, outputCols=parts[len(numeric):], handleInvalid="keep", dropLast=True)  # "keep": beyond the last is all zeros
        rows = encoder.fit(last).transform(rows)
    return VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep").transform(rows).select(*keep, out)


def sparse_cells(matrix: DataFrame, keep, vector: str = "features") -> DataFrame:
    """``keep`` plus (position, value) of a vector column's entries other than 0, whether it is stored sparse or dense."""
    v = F.unwrap_udt(vector)
    places = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    cells = F.filter(F.arrays_zip(places.alias("position"), v["values"].alias("value")), lambda x: x["value"] != 0)
    return matrix.select(*keep, F.inline(cells))


def ordinal(df: DataFrame, col: str, order, name: str | None = None) -> DataFrame:
    """M6: position in the given order (0-based); an unknown non-null value raises."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(col))
    enc = F.when(F.col(col).isNull(), F.lit(None)).when(pos > 0, (pos - 1).cast("double")).otherwise(
        F.raise_error(F.concat(F.lit(f"unknown {col} value: "), F.col(col))).cast("double"))
    return df.withColumn(name or f"ord__{col}", enc)


NULL_CATEGORY = "\u0000"


def _cat(col: str) -> Column:
    """Category key; NULL is its own category (a NUL-character surrogate)."""
    return F.coalesce(F.col(col).cast("string"), F.lit(NULL_CATEGORY))


def default_folds(key: str, k: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(k)).cast("int")


def target_encoding(train: DataFrame, col: str, y: str = "target") -> DataFrame:
    """M7 full fit: (category, encoding) smoothed toward the train mean.

    encoding = lambda*mean_c + (1-lambda)*mean with lambda = n_c*V / (n_c*V + v_c),
    V the train variance of y and v_c the within-category (population) variance.
    """
    g = train.agg(F.avg(F.col(y).cast("double")).alias("m"), F.var_pop(F.col(y).cast("double")).alias("V"))
    m, V = g.select("m").scalar(), g.select("V").scalar()
    per = train.groupBy(_cat(col).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("mc"), F.var_pop(F.col(y).cast("double")).alias("vc"))
    lam = F.col("n") * V / (F.col("n") * V + F.col("vc"))
    return per.select("category", (lam * F.col("mc") + (F.lit(1.0) - lam) * m).alias("encoding")), m


def target_encode_oof(train: DataFrame, col: str, key: str, y: str = "target", folds: int = 5,
                      fold_col: Column | None = None, name: str | None = None) -> DataFrame:
    """M7 out-of-fold values for train rows: each row is encoded with statistics of the other folds.

    One ``groupBy(category, fold)`` of (count, sum, sum of squares); category
    totals come from a window over that small aggregate, and every fold's
    out-of-fold statistics are totals minus the fold's own part, so no per-fold
    refit and no pass over the rows per fold. Hot categories only add rows to
    the partial aggregation, never to a single group of raw rows.
    """
    name = name or f"te__{col}"
    fcol = fold_col if fold_col is not None else default_folds(key, folds)
    yy = F.col(y).cast("double")
    base = train.select(key, _cat(col).alias("__cat"), yy.alias("__y"), fcol.alias("__fold"))
    cf = base.groupBy("__cat", "__fold").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("s"), F.sum(F.col("__y") * F.col("__y")).alias("ss"))
    wc = Window.partitionBy("__cat")
    cf = cf.withColumns({"__tn": F.sum("n").over(wc), "__ts": F.sum("s").over(wc), "__tss": F.sum("ss").over(wc)})
    gf = base.groupBy("__fold").agg(F.count(F.lit(1)).alias("gn"), F.sum("__y").alias("gs"), F.sum(F.col("__y") * F.col("__y")).alias("gss"))
    gn_all, gs_all, gss_all = base.agg(F.count(F.lit(1))).scalar(), base.agg(F.sum("__y")).scalar(), base.agg(F.sum(F.col("__y") * F.col("__y"))).scalar()
    # out-of-fold global statistics per fold (<= folds rows)
    go = gf.select("__fold", (gn_all - F.col("gn")).alias("on"), (gs_all - F.col("gs")).alias("os"), (gss_all - F.col("gss")).alias("oss"))
    go = go.select("__fold", (F.col("os") / F.col("on")).alias("m"),
                   (F.col("oss") / F.col("on") - F.pow(F.col("os") / F.col("on"), 2)).alias("V"))
    co = cf.select("__cat", "__fold", (F.col("__tn") - F.col("n")).alias("on"), (F.col("__ts") - F.col("s")).alias("os"),
                   (F.col("__tss") - F.col("ss")).alias("oss"))
    co = co.join(F.broadcast(go), "__fold")
    mc = F.col("os") / F.col("on")
    vc = F.col("oss") / F.col("on") - mc * mc
    lam = F.col("on") * F.col("V") / (F.col("on") * F.col("V") + vc)
    enc = F.when(F.col("on") > 0, lam * mc + (F.lit(1.0) - lam) * F.col("m")).otherwise(F.col("m"))
    enc_t = co.select("__cat", "__fold", enc.alias(name))
    rows = base.join(enc_t, ["__cat", "__fold"], "left")
    # A category absent from the other folds gets the fold's global mean.
    rows = rows.join(F.broadcast(go.select("__fold", F.col("m").alias("__m"))), "__fold")
    return rows.select(key, F.coalesce(F.col(name), F.col("__m")).alias(name))


def apply_target_encoding(df: DataFrame, enc: DataFrame, col: str, prior, name: str | None = None) -> DataFrame:
    """M7 for val/test/live: full-train encodings; unseen (and NULL) categories -> train mean.

    The encodings table is one row per category; Spark broadcasts it when its
    runtime size is small and otherwise runs a skew-aware sort-merge join (AQE).
    """
    name = name or f"te__{col}"
    e = enc.select(F.col("category").alias("__cat"), F.col("encoding").alias(name))
    j = df.withColumn("__key", _cat(col)).join(e, F.col("__key") == F.col("__cat"), "left")
    return j.drop("__cat", "__key").withColumn(name, F.coalesce(F.col(name), prior))


def missing_flags(df: DataFrame, cols) -> DataFrame:
    """M8: ``missing__c`` 0/1 indicators (a duplicated name in ``cols`` yields one column)."""
    seen = list(dict.fromkeys(cols))
    return df.withColumns({f"missing__{c}": F.col(c).isNull().cast("int") for c in seen})


def nan_count(df: DataFrame, cols=None) -> DataFrame:
    """(column, n_bad) count of NULL or NaN per column of a matrix; all should be 0."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("bigint").alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_bad")


def save_stats(stats: DataFrame, path: str) -> None:
    """Persist the fitted stats frame (Parquet)."""
    stats.write.mode("overwrite").parquet(path)


def load_stats(spark, path: str) -> DataFrame:
    """M10."""
    return spark.read.parquet(path)


def check_columns(matrix: DataFrame, expected) -> DataFrame:
    """Transform-time schema check as rows (column, present)."""
    have = set(matrix.columns)
    return matrix.sparkSession.createDataFrame([(c, c in have) for c in expected], "column string, present boolean")
