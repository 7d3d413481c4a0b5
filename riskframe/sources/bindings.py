"""Loan-shaped views over the driver's tables, once as Spark DataFrames and once
as DuckDB SQL common-table expressions for the independent oracle.

Both forms use only integer arithmetic, ``+ - * /``, ``%`` and ``CASE`` so the two
engines agree bit for bit; averages are rounded to 6 places inside the view.

* ``loans``            orders x customer x nation, left join per-order lineitem averages
* ``labelled``         loans after observation window, labelling and temporal split
* ``scored``           labelled loans with two deterministic, informative scores
* ``prediction_logs``  events shaped as the scoring log
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import specs
from riskframe.functions.exprs import round6
from riskframe.specs import ColumnRoles, LabelSpec, SplitSpec

# Split ranges, window and as-of time for the driver-table binding.
SPLITS = SplitSpec.by_years({"train": (1995, 1997), "val": (1998, 1998), "test": (1999, 1999)})
WINDOW_MONTHS = 24
LOG_AS_OF = datetime(2024, 1, 31, 0, 0, 0)
LOG_THRESHOLD = 0.16

LOAN_ROLES = ColumnRoles(
    numeric=("loan_amnt", "annual_inc", "dti", "revol_util", "mths_since_last_delinq",
             "fico_range_low", "credit_age_yrs", "fico_mid"),
    categorical=("term", "purpose", "addr_state", "verification_status", "emp_length"),
    target="target",
    date="issue_d",
    key="loan_id",
)

LOG_ROLES = ColumnRoles(
    numeric=("loan_amnt", "annual_inc", "dti", "revol_util", "pub_rec", "delinq_2yrs",
             "mths_since_last_delinq", "mths_since_last_record", "fico_range_low"),
    categorical=("term", "purpose", "addr_state", "emp_length", "home_ownership"),
    target="target",
    date="issue_d",
    key="request_id",
)

# Status by o_orderkey % 20 (fixed binding rule).
_STATUS_BY_MOD = [
    (8, "Fully Paid"), (14, "Current"), (16, "Charged Off"), (17, "Late (31-120 days)"),
    (18, "In Grace Period"), (19, "Late (16-30 days)"), (20, "Default"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------
# Spark forms
# --------------------------------------------------------------------------


def _status(k):
    m = k % F.lit(20)
    expr = None
    for below, name in _STATUS_BY_MOD:
        expr = F.when(m < F.lit(below), F.lit(name)) if expr is None else expr.when(m < F.lit(below), F.lit(name))
    return expr


def _emp_length(k):
    """0 -> NULL, 1..11 -> the 11 levels."""
    return F.when(k > 0, F.element_at(F.array(*[F.lit(v) for v in specs.EMP_LENGTH_LEVELS]), k.cast("int")))


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation is a fixed 25-row dimension: broadcast is size-bounded by definition.
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    li = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            round6(F.lit(300) * F.avg("l_discount")).alias("dti"),
            round6(F.lit(1000) * F.avg("l_tax")).alias("revol_util"),
            F.max("l_shipdate").alias("last_pymnt_d"),
        )
    )
    j = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    k = F.col("o_orderkey")
    ck = F.col("c_custkey")
    fico_low = F.lit(600) + (ck * F.lit(37) % F.lit(50)) * F.lit(5)
    return j.select(
        k.alias("loan_id"),
        F.col("o_orderdate").alias("issue_d"),
        _status(k).alias("loan_status"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit(" 60 months")).otherwise(F.lit(" 36 months")).alias("term"),
        F.col("o_totalprice").alias("loan_amnt"),
        F.when(ck % 50 != 0, (F.col("c_acctbal") + F.lit(1000)) * F.lit(15)).alias("annual_inc"),
        "dti",
        "revol_util",
        F.when(k % 5 != 0, k % 84).alias("mths_since_last_delinq"),
        (F.col("o_orderdate") - F.make_dt_interval(days=(F.lit(1000) + ck % 5000).cast("int"))).alias("earliest_cr_line"),
        fico_low.alias("fico_range_low"),
        (fico_low + F.lit(4)).alias("fico_range_high"),
        F.col("c_mktsegment").alias("purpose"),
        F.col("n_name").alias("addr_state"),
        F.col("o_orderpriority").alias("verification_status"),
        _emp_length(ck % 12).alias("emp_length"),
        "last_pymnt_d",
    )


# Bump when the labelled-table definition changes (part of the stored table's key).
LABELLED_VERSION = 2


def build_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loans -> observation window -> label -> split (rows outside all splits dropped)."""
    from riskframe.operators import prep

    df = loans(spark, sf_dir)
    df = prep.observation_window(df, "issue_d", WINDOW_MONTHS)
    df = prep.label_loans(df, LabelSpec())
    df = prep.temporal_split(df, SPLITS)
    return df.withColumns({
        "credit_age_yrs": round6(F.datediff(F.to_date("issue_d"), F.to_date("earliest_cr_line")) / F.lit(365.25)),
        "fico_mid": (F.col("fico_range_low") + F.col("fico_range_high")) / F.lit(2.0),
    })


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled split table as stored by the dataset build (S3).

    Built once per input folder into the shared checkpoint folder, partitioned
    by ``split`` so later jobs prune partitions and columns at the scan instead
    of recomputing the four-way build join in every plan branch.
    """
    from riskframe.sources.io import stored_table

    inputs = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("orders", "customer", "nation", "lineitem")]
    return stored_table(spark, f"labelled-v{LABELLED_VERSION}", inputs, lambda: build_labelled(spark, sf_dir), ["split"])


def score_expr(id_col="loan_id", target="target"):
    k = F.col(id_col)
    return ((k * F.lit(7919)) % F.lit(1009) + F.lit(250) * F.col(target)).cast("double") / F.lit(1300.0)


def score2_expr(id_col="loan_id", target="target"):
    k = F.col(id_col)
    return ((k * F.lit(104729)) % F.lit(997) + F.lit(200) * F.col(target)).cast("double") / F.lit(1250.0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.functions.exprs import bracket

    df = labelled(spark, sf_dir)
    return df.select(
        F.col("loan_id").alias("id"),
        F.col("target").alias("y"),
        score_expr().alias("p"),
        score2_expr().alias("p2"),
        "split",
        "issue_d",
        "term",
        "purpose",
        "addr_state",
        "annual_inc",
        bracket("annual_inc", specs.INCOME_EDGES, specs.INCOME_LABELS).alias("income_bracket"),
    )


def prediction_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    uid = F.col("user_id")
    prob = F.col("value") / F.lit(500.0)
    fico_low = F.lit(600) + (uid * F.lit(37) % F.lit(50)) * F.lit(5)
    return e.select(
        eid.alias("request_id"),
        F.col("ts").alias("logged_at"),
        F.to_date("ts").alias("issue_d"),
        (F.lit(1000) + (uid * F.lit(37) % F.lit(100)) * F.lit(250)).cast("double").alias("loan_amnt"),
        (F.lit(20000) + (uid * F.lit(53) % F.lit(97)) * F.lit(1500)).cast("double").alias("annual_inc"),
        ((uid * F.lit(7) % F.lit(70)).cast("double") + F.lit(0.5)).alias("dti"),
        (F.col("value") / F.lit(4.0)).alias("revol_util"),
        (eid % F.lit(13)).cast("double").alias("pub_rec"),
        (eid % F.lit(11)).cast("double").alias("delinq_2yrs"),
        F.when(eid % 4 != 0, (eid % F.lit(84)).cast("double")).alias("mths_since_last_delinq"),
        F.when(eid % 3 == 0, (eid % F.lit(120)).cast("double")).alias("mths_since_last_record"),
        fico_low.alias("fico_range_low"),
        (fico_low + F.lit(4)).alias("fico_range_high"),
        (F.to_date("ts") - F.make_interval(days=(F.lit(1000) + uid * F.lit(13) % F.lit(5000)).cast("int"))).cast("date").alias("earliest_cr_line"),
        F.when(uid % 3 == 0, F.lit(" 60 months")).otherwise(F.lit(" 36 months")).alias("term"),
        F.col("event_type").alias("purpose"),
        F.concat(F.lit("S"), (uid % F.lit(50)).cast("string")).alias("addr_state"),
        _emp_length(uid % F.lit(12)).alias("emp_length"),
        F.when(eid % 2500 == 0, F.lit("OTHER")).when(uid % 2 == 0, F.lit("RENT")).otherwise(F.lit("MORTGAGE")).alias("home_ownership"),
        F.when(prob >= F.lit(LOG_THRESHOLD), F.lit(1)).otherwise(F.lit(0)).alias("pred"),
        prob.alias("prob"),
        F.from_json(F.col("props"), "map<string,double>").alias("reason_codes"),
    )


# --------------------------------------------------------------------------
# DuckDB oracle forms (CTEs). ``oracle(body, *names)`` emits WITH ... body.
# --------------------------------------------------------------------------


def _status_sql(k: str) -> str:
    arms = " ".join(f"WHEN {k} % 20 < {b} THEN '{n}'" for b, n in _STATUS_BY_MOD)
    return f"CASE {arms} END"


def _emp_sql(k: str) -> str:
    arms = " ".join(f"WHEN {k} = {i + 1} THEN '{v}'" for i, v in enumerate(specs.EMP_LENGTH_LEVELS))
    return f"CASE {arms} END"


def _income_bracket_sql(x: str) -> str:
    e, lab = specs.INCOME_EDGES, specs.INCOME_LABELS
    arms = []
    for lo, hi, name in zip(e[:-1], e[1:], lab):
        if hi == float("inf"):
            arms.append(f"WHEN {x} > {lo} THEN '{name}'")
        else:
            arms.append(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{name}'")
    return "CASE " + " ".join(arms) + " END"


def _split_sql(d: str) -> str:
    arms = " ".join(
        f"WHEN {d} >= TIMESTAMP '{a:%Y-%m-%d %H:%M:%S}' AND {d} <= TIMESTAMP '{b:%Y-%m-%d %H:%M:%S}' THEN '{n}'"
        for n, a, b in SPLITS.ranges
    )
    return f"CASE {arms} END"


_BAD = ", ".join(f"'{s}'" for s in LabelSpec().bad)
_AMBIGUOUS = ", ".join(f"'{s}'" for s in LabelSpec().ambiguous)

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "li": (
        "SELECT l_orderkey, round(300 * avg(l_discount), 6) AS dti, round(1000 * avg(l_tax), 6) AS revol_util, "
        "max(l_shipdate) AS last_pymnt_d FROM lineitem GROUP BY l_orderkey",
        (),
    ),
    "loans": (
        f"""SELECT o.o_orderkey AS loan_id, o.o_orderdate AS issue_d,
  {_status_sql('o.o_orderkey')} AS loan_status,
  CASE WHEN o.o_custkey % 3 = 0 THEN ' 60 months' ELSE ' 36 months' END AS term,
  o.o_totalprice AS loan_amnt,
  CASE WHEN c.c_custkey % 50 <> 0 THEN (c.c_acctbal + 1000) * 15 END AS annual_inc,
  li.dti, li.revol_util,
  CASE WHEN o.o_orderkey % 5 <> 0 THEN o.o_orderkey % 84 END AS mths_since_last_delinq,
  o.o_orderdate - to_days(CAST(1000 + c.c_custkey % 5000 AS INTEGER)) AS earliest_cr_line,
  600 + (c.c_custkey * 37 % 50) * 5 AS fico_range_low,
  600 + (c.c_custkey * 37 % 50) * 5 + 4 AS fico_range_high,
  c.c_mktsegment AS purpose, n.n_name AS addr_state, o.o_orderpriority AS verification_status,
  {_emp_sql('c.c_custkey % 12')} AS emp_length, li.last_pymnt_d
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN li ON o.o_orderkey = li.l_orderkey""",
        ("li",),
    ),
    "windowed": (
        f"""SELECT * FROM loans
WHERE (SELECT year(max(issue_d)) * 12 + month(max(issue_d)) FROM loans) - (year(issue_d) * 12 + month(issue_d)) >= {WINDOW_MONTHS}""",
        ("loans",),
    ),
    "labelled": (
        f"""SELECT * EXCLUDE (loan_status, split0), split0 AS split,
  round(CAST(date_diff('day', CAST(earliest_cr_line AS DATE), CAST(issue_d AS DATE)) AS DOUBLE) / 365.25, 6) AS credit_age_yrs,
  CAST(fico_range_low + fico_range_high AS DOUBLE) / 2 AS fico_mid
FROM (SELECT *, CASE WHEN loan_status IN ({_BAD}) THEN 1 ELSE 0 END AS target,
             {_split_sql('issue_d')} AS split0
      FROM windowed
      WHERE NOT coalesce(loan_status IN ({_AMBIGUOUS}), false)) t
WHERE split0 IS NOT NULL""",
        ("windowed",),
    ),
    "scored": (
        f"""SELECT loan_id AS id, target AS y,
  CAST((loan_id * 7919) % 1009 + 250 * target AS DOUBLE) / 1300.0 AS p,
  CAST((loan_id * 104729) % 997 + 200 * target AS DOUBLE) / 1250.0 AS p2,
  split, issue_d, term, purpose, addr_state, annual_inc,
  {_income_bracket_sql('annual_inc')} AS income_bracket
FROM labelled""",
        ("labelled",),
    ),
    "logs": (
        f"""SELECT event_id AS request_id, ts AS logged_at, CAST(ts AS DATE) AS issue_d,
  CAST(1000 + (user_id * 37 % 100) * 250 AS DOUBLE) AS loan_amnt,
  CAST(20000 + (user_id * 53 % 97) * 1500 AS DOUBLE) AS annual_inc,
  CAST(user_id * 7 % 70 AS DOUBLE) + 0.5 AS dti,
  value / 4.0 AS revol_util,
  CAST(event_id % 13 AS DOUBLE) AS pub_rec,
  CAST(event_id % 11 AS DOUBLE) AS delinq_2yrs,
  CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 84 AS DOUBLE) END AS mths_since_last_delinq,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 120 AS DOUBLE) END AS mths_since_last_record,
  600 + (user_id * 37 % 50) * 5 AS fico_range_low,
  600 + (user_id * 37 % 50) * 5 + 4 AS fico_range_high,
  CAST(CAST(ts AS DATE) - CAST(1000 + user_id * 13 % 5000 AS INTEGER) AS DATE) AS earliest_cr_line,
  CASE WHEN user_id % 3 = 0 THEN ' 60 months' ELSE ' 36 months' END AS term,
  event_type AS purpose,
  'S' || CAST(user_id % 50 AS VARCHAR) AS addr_state,
  {_emp_sql('user_id % 12')} AS emp_length,
  CASE WHEN event_id % 2500 = 0 THEN 'OTHER' WHEN user_id % 2 = 0 THEN 'RENT' ELSE 'MORTGAGE' END AS home_ownership,
  CASE WHEN value / 500.0 >= {LOG_THRESHOLD} THEN 1 ELSE 0 END AS pred,
  value / 500.0 AS prob,
  props
FROM events""",
        (),
    ),
}


def half_up_rounding(sql: str) -> str:
    """Rewrite every ``round(X, 6)`` as ``floor((X) * 1000000.0 + 0.5) / 1000000.0`` (same steps as ``round6``)."""
    out, i = [], 0
    low = sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, last_comma = 0, j + 5, -1
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            elif ch == "," and depth == 1:
                last_comma = k
            k += 1
        inner = sql[j + 6:last_comma] if last_comma > 0 else None
        digits = sql[last_comma + 1:k].strip() if last_comma > 0 else ""
        if inner is not None and digits == "6":
            out.append(sql[i:j])
            out.append(f"(floor(({half_up_rounding(inner)}) * 1000000.0 + 0.5) / 1000000.0)")
        else:
            out.append(sql[i:j])
            out.append("round(" + half_up_rounding(sql[j + 6:k]) + ")")
        i = k + 1


def oracle(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <needed CTEs in dependency order> [, extra CTEs] <body>`` with half-up 6-place rounding."""
    return half_up_rounding(_with(body, *names, extra=extra))


def _with(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{CTES[n][0]}\n)" for n in order]
    for n, sql in (extra or {}).items():
        parts.append(f"{n} AS (\n{sql}\n)")
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
