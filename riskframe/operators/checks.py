"""Table checks as one report frame.

Every check yields rows ``(check, split, column, n_violations, ok)``; data
checks of one table are a single ``groupBy(split)`` aggregate unpivoted to rows,
so a pipeline can gate on them without extra passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    MapType,
    NumericType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

KINDS = {
    "number": (NumericType,),
    "string": (StringType,),
    "datetime": (DateType, TimestampType, TimestampNTZType),
}


def schema_checks(df: DataFrame, required: dict, leakage=()) -> DataFrame:
    """V1 (present), V2 (logical kind), V6 (no leakage column), each with the column's number of values.

    ``n_values`` counts the non-null values of a column that is there (one aggregate over the table); 0 otherwise.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for col, kind in required.items():
        present = col in fields
        rows.append(("V1_required_column", None, col, 0 if present else 1, present))
        ok = present and isinstance(fields[col], KINDS[kind])
        rows.append(("V2_logical_type", None, col, 0 if ok else 1, ok))
    for col in leakage:
        rows.append(("V6_no_leakage", None, col, 1 if col in fields else 0, col not in fields))
    return _with_values(df, rows)


def _with_values(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """Check rows from a schema, joined with the number of non-null values that each of the columns holds."""
    checks = df.sparkSession.createDataFrame(rows, "check string, split string, column string, n_violations long, ok boolean")
    names = sorted({r[2] for r in rows if r[2] in df.columns})
    if not names:
        return checks.withColumn("n_values", F.lit(0).cast("bigint"))
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in names]).unpivot([], names, "column", "n_values")
    return checks.join(counts, "column", "left").select(*checks.columns, F.coalesce("n_values", F.lit(0)).cast("bigint").alias("n_values"))


def data_checks(df: DataFrame, split: str, target: str, ranges: dict, domains: dict, ordered=(),
                extreme=None, rate_bounds=(0.10, 0.25)) -> DataFrame:
    """V3, V5, V8, V9, V10, V11, V12 in one aggregate per split.

    ranges: col -> (lo, hi) with None = open; domains: col -> allowed values;
    ordered: (a, b) pairs with a <= b when both present; extreme: (col, bound, max_share).
    """
    y = F.col(target)
    aggs: list[tuple[str, str, Column]] = [
        ("V3_target_not_null", target, F.count_if(y.isNull())),
        ("V5_target_binary", target, F.count_if(y.isNotNull() & ~y.isin(0, 1))),
    ]
    for c, (lo, hi) in ranges.items():
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (F.col(c) < F.lit(lo))
        if hi is not None:
            bad = bad | (F.col(c) > F.lit(hi))
        aggs.append(("V8_numeric_range", c, F.count_if(F.col(c).isNotNull() & bad)))
    for c, values in domains.items():
        aggs.append(("V9_categorical_domain", c, F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(list(values)))))
    for a, b in ordered:
        aggs.append(("V10_row_order", f"{a}<={b}", F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) > F.col(b)))))
    names = [f"c{i}" for i in range(len(aggs))]
    extra = []
    if extreme:
        c, bound, share = extreme
        extra.append(F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > F.lit(bound)).cast("double"))).alias("__ext"))
    extra.append(F.avg(y.cast("double")).alias("__rate"))
    wide = df.groupBy(split).agg(*[a[2].cast("bigint").alias(n) for a, n in zip(aggs, names)], *extra)
    meta = F.create_map(*[x for (chk, col, _), n in zip(aggs, names) for x in (F.lit(n), F.lit(f"{chk}|{col}"))])
    long = wide.unpivot([split, *[e for e in ("__ext", "__rate") if e in wide.columns]], names, "__k", "n_violations")
    key = F.split(meta[F.col("__k")], r"\|")
    out = long.select(key[0].alias("check"), F.col(split).alias("split"), key[1].alias("column"),
                      F.col("n_violations").cast("bigint").alias("n_violations"), (F.col("n_violations") == 0).alias("ok"))
    parts = [out]
    if extreme:
        c, bound, share = extreme
        ok = F.coalesce(F.col("__ext") < F.lit(share), F.lit(True))
        parts.append(wide.select(F.lit("V11_extreme_share").alias("check"), F.col(split).alias("split"), F.lit(c).alias("column"),
                                 F.when(ok, 0).otherwise(1).cast("bigint").alias("n_violations"), ok.alias("ok")))
    lo, hi = rate_bounds
    ok = (F.col("__rate") >= F.lit(lo)) & (F.col("__rate") <= F.lit(hi))
    parts.append(wide.select(F.lit("V12_default_rate_range").alias("check"), F.col(split).alias("split"), F.lit(target).alias("column"),
                             F.when(ok, 0).otherwise(1).cast("bigint").alias("n_violations"), ok.alias("ok")))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def row_count_matches(df: DataFrame, receipt: DataFrame, split: str = "split") -> DataFrame:
    """V4: rows per split equal the receipt's count."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("__n"))
    j = counts.join(receipt.select(F.col(split), F.col("rows").alias("__r")), split, "full_outer")
    ok = F.coalesce(F.col("__n") == F.col("__r"), F.lit(False))
    return j.select(F.lit("V4_row_count").alias("check"), F.col(split).alias("split"), F.lit(None).cast("string").alias("column"),
                    F.abs(F.coalesce(F.col("__n"), F.lit(0)) - F.coalesce(F.col("__r"), F.lit(0))).cast("bigint").alias("n_violations"),
                    ok.alias("ok"))


def unexpected_null_columns(df: DataFrame, split: str, allowed: dict, cols=None) -> DataFrame:
    """V7: columns 100 % NULL inside a split that are not on that split's allow-list."""
    from riskframe.operators.profile import fully_null

    cols = [c for c in (cols or df.columns) if c != split]
    fn = fully_null(df.select(split, *cols), split)
    allow = df.sparkSession.createDataFrame([(s, c) for s, cs in allowed.items() for c in cs] or [("", "")], f"{split} string, column string")
    bad = fn.join(allow, [split, "column"], "left_anti")
    return bad.select(F.lit("V7_unexpected_all_null").alias("check"), F.col(split).alias("split"), "column",
                      F.lit(1).cast("bigint").alias("n_violations"), F.lit(False).alias("ok"))


def temporal_order(df: DataFrame, date: str, split: str, order) -> DataFrame:
    """Max date of each split < min date of the next split in ``order``."""
    spans = df.groupBy(split).agg(F.min(date).alias("__lo"), F.max(date).alias("__hi"))
    pos = {s: i for i, s in enumerate(order)}
    idx = F.create_map(*[x for s, i in pos.items() for x in (F.lit(s), F.lit(i))])
    a = spans.select(F.col(split).alias("__a"), idx[F.col(split)].alias("__i"), F.col("__hi").alias("__a_hi"))
    b = spans.select(F.col(split).alias("__b"), (idx[F.col(split)] - 1).alias("__i"), F.col("__lo").alias("__b_lo"))
    j = a.join(b, "__i")
    ok = F.col("__a_hi") < F.col("__b_lo")
    return j.select(F.lit("V13_temporal_order").alias("check"), F.concat(F.col("__a"), F.lit("<"), F.col("__b")).alias("split"),
                    F.lit(date).alias("column"), F.when(ok, 0).otherwise(1).cast("bigint").alias("n_violations"), ok.alias("ok"))


def rows_conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows entering the split step equal the rows of all splits together."""
    nb, na = before.agg(F.count(F.lit(1))).scalar(), after.agg(F.count(F.lit(1))).scalar()
    return before.sparkSession.range(1).select(
        F.lit("V15_rows_conserved").alias("check"), F.lit(None).cast("string").alias("split"), F.lit(None).cast("string").alias("column"),
        F.abs(nb - na).cast("bigint").alias("n_violations"), (nb == na).alias("ok"))


def segment_ordering(df: DataFrame, split: str, col: str, low: str, high: str, target: str = "target") -> DataFrame:
    """Default rate of segment ``low`` is below that of ``high`` in every split."""
    g = df.groupBy(split).agg(
        F.avg(F.when(F.col(col) == low, F.col(target).cast("double"))).alias("__lo"),
        F.avg(F.when(F.col(col) == high, F.col(target).cast("double"))).alias("__hi"))
    ok = F.coalesce(F.col("__lo") < F.col("__hi"), F.lit(False))
    return g.select(F.lit("V16_segment_ordering").alias("check"), F.col(split).alias("split"), F.lit(col).alias("column"),
                    F.when(ok, 0).otherwise(1).cast("bigint").alias("n_violations"), ok.alias("ok"))


def sorted_by(df: DataFrame, date: str, order: str) -> DataFrame:
    """Rows taken by the unique column ``order`` (a file position or id) have no later date than their successor.

    Positions come from the two-level running count; each row is compared
    with the next position through an equi-join (no single-partition lag window).
    """
    from riskframe.operators.windowing import running_sums

    p = running_sums(df.select(date, order).withColumn("__one", F.lit(1)), order, ["__one"]).select(date, F.col("cum___one").alias("position"))
    nxt = p.select((F.col("position") - 1).alias("position"), F.col(date).alias("__next"))
    bad = p.join(nxt, "position").filter(F.col(date) > F.col("__next"))
    n = bad.agg(F.count(F.lit(1))).scalar()
    return df.sparkSession.range(1).select(F.lit("V18_sorted_dates").alias("check"), F.lit(None).cast("string").alias("split"),
                                           F.lit(date).alias("column"), n.cast("bigint").alias("n_violations"), (n == 0).alias("ok"))


def column_order(df: DataFrame, spec) -> DataFrame:
    """Column order and arity equal the spec, with each column's number of values."""
    have = df.columns
    rows = [("V19_column_order", None, c, 0 if i < len(have) and have[i] == c else 1, i < len(have) and have[i] == c)
            for i, c in enumerate(spec)]
    rows.append(("V19_column_count", None, None, abs(len(have) - len(spec)), len(have) == len(spec)))
    return _with_values(df, rows)


# ------------------------------------------------------------------ requests


def validate_requests(raw: DataFrame, json_col: str, numeric, nullable=(), dates=(), enums=None, key: str = "request_id"):
    """Parse JSON requests with an all-string schema, type each field, collect errors.

    Rules: a required field must be present and non-null; numeric fields must
    parse as numbers (the string "None" is rejected); nullable numeric fields
    accept an explicit null; dates must parse as yyyy-MM-dd; enums must be in
    their allowed set. Returns (valid rows typed, quarantined rows with errors).
    """
    enums = enums or {}
    fields = list(numeric) + list(dates) + list(enums)
    schema = StructType([StructField(f, StringType(), True) for f in fields])
    p = raw.select(key, F.from_json(F.col(json_col), schema).alias("__r"),
                   F.from_json(F.col(json_col), MapType(StringType(), StringType())).alias("__m"))
    errs = []
    for f in numeric:
        v = F.col("__r")[f]
        present = F.map_contains_key(F.col("__m"), F.lit(f))
        if f in nullable:
            missing = ~present
        else:
            missing = ~present | v.isNull()
        bad_num = v.isNotNull() & v.try_cast("double").isNull()
        errs.append(F.when(missing, F.lit(f"{f}: missing")).when(bad_num, F.lit(f"{f}: not a number")))
    for f in dates:
        v = F.col("__r")[f]
        errs.append(F.when(v.isNull(), F.lit(f"{f}: missing")).when(F.try_to_date(v, "yyyy-MM-dd").isNull(), F.lit(f"{f}: not a date")))
    for f, allowed in enums.items():
        v = F.col("__r")[f]
        errs.append(F.when(v.isNull(), F.lit(f"{f}: missing")).when(~v.isin(list(allowed)), F.lit(f"{f}: not allowed")))
    checked = p.withColumn("errors", F.filter(F.array(*errs), lambda e: e.isNotNull()))
    typed = [F.col("__r")[f].try_cast("double").alias(f) for f in numeric] + \
            [F.try_to_date(F.col("__r")[f], "yyyy-MM-dd").alias(f) for f in dates] + [F.col("__r")[f].alias(f) for f in enums]
    valid = checked.filter(F.size("errors") == 0).select(key, *typed)
    quarantined = checked.filter(F.size("errors") > 0).select(key, "errors")
    return valid, quarantined


def response_contract(responses: DataFrame, t: float, k: int = 5) -> DataFrame:
    """V20 over (p, pred, reasons array): pred in {0,1}, p in [0,1], exactly k reasons in descending |value|, pred = (p >= t)."""
    size = F.transform("reasons", lambda r: F.round(F.abs(r["value"]), 12))
    unsorted = F.exists(F.sequence(F.lit(1), F.greatest(F.size("reasons") - 1, F.lit(1))),
                        lambda i: F.coalesce(F.get(size, i - 1) < F.get(size, i), F.lit(False)))
    bad = (~F.col("pred").isin(0, 1) | (F.col("p") < 0) | (F.col("p") > 1) | (F.coalesce(F.size("reasons"), F.lit(0)) != k)
           | unsorted | (F.col("pred") != (F.col("p") >= F.lit(t)).cast("int")))
    n = responses.agg(F.count_if(bad)).scalar()
    return responses.sparkSession.range(1).select(F.lit("V20_response_contract").alias("check"), F.lit(None).cast("string").alias("split"),
                                               F.lit(None).cast("string").alias("column"), n.cast("bigint").alias("n_violations"), (n == 0).alias("ok"))



def scoring_sanity(scored: DataFrame, optional, y: str = "target", p: str = "p") -> DataFrame:
    """Rows with a NULL optional field are scored all the same, and defaulters score above the others on average.

    One row per optional field (n_rows = rows where it is NULL, n_violations = those without a score) and one for the order.
    """
    aggs = []
    for c in optional:
        gone = F.col(c).isNull()
        aggs += [F.count_if(gone).cast("bigint").alias(f"{c}__n"), F.count_if(gone & F.col(p).isNull()).cast("bigint").alias(f"{c}__v")]
    lift = F.avg(F.when(F.col(y) == 1, F.col(p))) > F.avg(F.when(F.col(y) == 0, F.col(p)))
    one = scored.agg(*aggs, F.count(F.lit(1)).alias("__n"), F.coalesce(lift, F.lit(False)).alias("__ok"))
    rows = [F.struct(F.lit("V21_null_optional_scored").alias("check"), F.lit(c).alias("column"), F.col(f"{c}__n").alias("n_rows"),
                     F.col(f"{c}__v").alias("n_violations"), (F.col(f"{c}__v") == 0).alias("ok")) for c in optional]
    rows.append(F.struct(F.lit("V21_risk_order").alias("check"), F.lit(y).alias("column"), F.col("__n").alias("n_rows"),
                         F.when(F.col("__ok"), 0).otherwise(1).cast("bigint").alias("n_violations"), F.col("__ok").alias("ok")))
    return one.select(F.inline(F.array(*rows)))
