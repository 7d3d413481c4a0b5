"""Dataset preparation: snapshot, observation window, labels, splits, column
drops and log filters (P1-P20).

Global values (snapshot date, totals) are scalar subqueries
(``DataFrame.scalar()``), which Spark evaluates as one partial+final aggregate
and inlines as a literal: no cross join, no collect.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from riskframe import specs
from riskframe.functions.exprs import month_ordinal, ts_lit
from riskframe.specs import ColumnRoles, LabelSpec, SplitSpec


def snapshot_date(df: DataFrame, date: str = "issue_d") -> Column:
    """max(date) as a scalar subquery column; must be non-null."""
    return df.agg(F.max(date)).scalar()


def snapshot_frame(df: DataFrame, date: str = "issue_d") -> DataFrame:
    """P1 as a one-row frame (reports)."""
    return df.agg(F.max(date).alias("snapshot_date"))


def loan_age_months(df: DataFrame, date: str = "issue_d", as_of=None, name: str = "loan_age_months") -> DataFrame:
    """Calendar-month ordinal difference between as_of (default snapshot) and date."""
    ref = snapshot_date(df, date) if as_of is None else ts_lit(as_of)
    return df.withColumn(name, month_ordinal(ref) - month_ordinal(F.col(date)))


def observation_window(df: DataFrame, date: str = "issue_d", months: int = 24, as_of=None) -> DataFrame:
    """Keep rows at least ``months`` calendar months older than as_of."""
    ref = snapshot_date(df, date) if as_of is None else ts_lit(as_of)
    return df.filter(month_ordinal(ref) - month_ordinal(F.col(date)) >= F.lit(months))


def drop_leakage(df: DataFrame, cols) -> DataFrame:
    """Drop listed columns that exist; missing names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def dropped_columns(df: DataFrame, cols) -> list[str]:
    """P4 report: which of ``cols`` were present (schema only, no job)."""
    return [c for c in cols if c in df.columns]


def label_loans(df: DataFrame, spec: LabelSpec = LabelSpec()) -> DataFrame:
    """P5: remove ambiguous statuses, bad -> 1, everything else (unknown, NULL) -> 0."""
    s = F.col(spec.status_col)
    return (
        df.filter(~F.coalesce(s.isin(spec.ambiguous), F.lit(False)))
        .withColumn(spec.target, F.when(s.isin(spec.bad), F.lit(1)).otherwise(F.lit(0)))
        .drop(spec.status_col)
    )


def label_resolved_only(df: DataFrame, status: str = "loan_status", target: str = "target",
                        mapping: dict | None = None) -> DataFrame:
    """Naive labelling that keeps resolved loans only (censored, biased)."""
    m = mapping or specs.RESOLVED_STATUSES
    bad = [k for k, v in m.items() if v == 1]
    return (
        df.filter(F.col(status).isin(list(m)))
        .withColumn(target, F.when(F.col(status).isin(bad), F.lit(1)).otherwise(F.lit(0)))
    )


def split_column(spec: SplitSpec) -> Column:
    d = F.col(spec.date)
    expr = None
    for name, lo, hi in spec.ranges:
        cond = (d >= ts_lit(lo)) & (d <= ts_lit(hi))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def temporal_split(df: DataFrame, spec: SplitSpec, name: str = "split") -> DataFrame:
    """One pass tags each row with its split; rows outside every range are dropped."""
    return df.withColumn(name, split_column(spec)).filter(F.col(name).isNotNull())


def drop_unused(df: DataFrame, cols) -> DataFrame:
    """Drop model-unused columns, ignore missing."""
    return drop_leakage(df, cols)


def split_xy(df: DataFrame, key: str, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """Features and target as two projections sharing the row key."""
    return df.drop(target), df.select(key, target)


def prepare_split(df: DataFrame, roles: ColumnRoles, issue_d: str = "issue_d",
                  earliest: str = "earliest_cr_line", low: str = "fico_range_low",
                  high: str = "fico_range_high") -> DataFrame:
    """P10: derived credit age and FICO mid, unused columns dropped; kept as one frame with key and target.

    Sorting by issue date (O1) is not applied here: row order only matters at
    output, and a global sort is a full range shuffle.
    """
    from riskframe.functions.exprs import credit_age_yrs, fico_mid

    out = df
    if issue_d in df.columns and earliest in df.columns:
        out = out.withColumn("credit_age_yrs", credit_age_yrs(issue_d, earliest))
    if low in df.columns and high in df.columns:
        out = out.withColumn("fico_mid", fico_mid(low, high))
    return drop_unused(out, roles.drop)


def regime(roles: ColumnRoles, name: str, lender_cols=("grade", "sub_grade", "int_rate")) -> ColumnRoles:
    """Regime A keeps the lender's own grade/rate, regime B removes them."""
    return roles if name.upper() == "A" else roles.without(*lender_cols)


def all_null_columns(df: DataFrame, cols=None) -> DataFrame:
    """Columns that are 100 % null, one aggregate pass -> (column) rows."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    long = counts.unpivot([], cols, "column", "n_present")
    return long.filter(F.col("n_present") == 0).select("column")


def drop_all_null(train: DataFrame, *others: DataFrame, cols=None):
    """Drop from every split the columns that are 100 % null in train.

    The column list is a schema-sized result (one aggregate row), so reading it
    back to choose a projection is bounded by the number of columns.
    """
    gone = [r["column"] for r in all_null_columns(train, cols).collect()]
    return [d.drop(*gone) for d in (train,) + others], gone


def columns_by_kind(df: DataFrame) -> dict[str, list[str]]:
    """Columns by logical type (schema fold, no job)."""
    out = {"number": [], "string": [], "datetime": [], "other": []}
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, NumericType):
            out["number"].append(f.name)
        elif isinstance(t, StringType):
            out["string"].append(f.name)
        elif isinstance(t, (DateType, TimestampType, TimestampNTZType)):
            out["datetime"].append(f.name)
        else:
            out["other"].append(f.name)
    return out


def kind_counts(df: DataFrame) -> DataFrame:
    """P13 as rows (kind, column, n_values): the logical kind of every column and its number of non-null values."""
    kinds = [(k, c) for k, cs in columns_by_kind(df).items() for c in cs]
    named = df.sparkSession.createDataFrame(kinds, "kind string, column string")
    cols = [c for _, c in kinds]
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).unpivot([], cols, "column", "n_values")
    return named.join(counts, "column").select("kind", "column", "n_values")


def filter_log(df: DataFrame, pred=None, min_prob=None, max_prob=None, purpose=None, addr_state=None,
               date_from=None, date_to=None, ts: str = "logged_at") -> DataFrame:
    """Optional ANDed filters (all pushable to Parquet)."""
    conds = []
    if pred is not None:
        conds.append(F.col("pred") == F.lit(pred))
    if min_prob is not None:
        conds.append(F.col("prob") >= F.lit(float(min_prob)))
    if max_prob is not None:
        conds.append(F.col("prob") <= F.lit(float(max_prob)))
    if purpose is not None:
        conds.append(F.col("purpose") == F.lit(purpose))
    if addr_state is not None:
        conds.append(F.col("addr_state") == F.lit(addr_state))
    if date_from is not None:
        conds.append(F.col(ts) >= ts_lit(date_from))
    if date_to is not None:
        conds.append(F.col(ts) <= ts_lit(date_to))
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def get_prediction(df: DataFrame, request_id, inputs, key: str = "request_id") -> DataFrame:
    """Point lookup with the raw inputs gathered in a struct."""
    return df.filter(F.col(key) == F.lit(request_id)).select(
        key, "logged_at", "pred", "prob", F.struct(*[F.col(c) for c in inputs]).alias("raw_input")
    )


def flag_outliers(df: DataFrame, rules: dict | None = None, key: str = "request_id", ts: str = "logged_at",
                  limit: int = specs.OUTLIER_LIST_LIMIT) -> DataFrame:
    """Rows exceeding a rule bound (NULL never flagged); first ``limit`` per rule.

    The rules are unpivoted so all features share one window; each window
    partition holds only flagged rows of one feature, and ``row_number <= limit``
    is planned as a per-partition top-k (WindowGroupLimit), so no group is
    materialised whole.
    """
    rules = rules or specs.OUTLIER_RULES
    feats = [f for f in rules if f in df.columns]
    long = df.select(key, ts, *[F.col(f).cast("double").alias(f) for f in feats]).unpivot(
        [key, ts], feats, "feature", "value"
    )
    bound = None
    for f, b in rules.items():
        if f in feats:
            bound = F.when(F.col("feature") == f, F.lit(float(b))) if bound is None else bound.when(F.col("feature") == f, F.lit(float(b)))
    flagged = long.filter(F.col("value").isNotNull() & (F.col("value") > bound))
    w = Window.partitionBy("feature").orderBy(F.col(ts), F.col(key))
    return flagged.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).drop("rn")


def status_counts(df: DataFrame, start, end, date: str = "issue_d", status: str = "loan_status") -> DataFrame:
    """Status counts of rows strictly inside (start, end)."""
    return (
        df.filter((F.col(date) > ts_lit(start)) & (F.col(date) < ts_lit(end)))
        .groupBy(status)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def complete_cases(df: DataFrame, cols) -> DataFrame:
    """Rows with no NULL in ``cols``."""
    return df.dropna(how="any", subset=list(cols))


def recent_counts(df: DataFrame, as_of, ts: str = "logged_at", hours=(24, 1)) -> DataFrame:
    """Counts of rows within the last N hours of ``as_of`` (explicit parameter)."""
    return df.agg(*[
        F.count_if(F.col(ts) >= ts_lit(as_of) - F.expr(f"INTERVAL {int(h)} HOURS")).cast("bigint").alias(f"last_{h}h")
        for h in hours
    ])


def inspect(df: DataFrame, predicate: Column, cols, n: int) -> DataFrame:
    """P20: filter, project, first n rows (n is the feature: a peek)."""
    return df.filter(predicate).select(*cols).limit(n)
