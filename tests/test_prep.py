"""Dataset functions on the literal frames of the original tests (FIXTURES A1)."""

from datetime import datetime

from pyspark.sql import functions as F

from riskframe import specs
from riskframe.functions import exprs
from riskframe.operators import prep
from riskframe.specs import LabelSpec, SplitSpec


def test_drop_leakage_keeps_other_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, "CA", 3.0)] * 3, "annual_inc double, total_pymnt double, addr_state string, hardship_amount double")
    out = prep.drop_leakage(df, specs.LEAKAGE_COLUMNS)
    assert set(out.columns) == {"annual_inc", "addr_state"}
    assert prep.dropped_columns(df, specs.LEAKAGE_COLUMNS) == ["total_pymnt", "hardship_amount"]


def test_label_map_all_statuses(spark):
    statuses = list(specs.STATUS_TO_LABEL)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(statuses)], "id int, loan_status string")
    out = prep.label_loans(df, LabelSpec()).orderBy("id")
    assert "loan_status" not in out.columns
    expected = [v for v in specs.STATUS_TO_LABEL.values() if v is not None]
    assert [r.target for r in out.collect()] == expected


def test_label_unknown_and_null_status_are_zero(spark):
    df = spark.createDataFrame([(1, "Something new"), (2, None)], "id int, loan_status string")
    assert [r.target for r in prep.label_loans(df).orderBy("id").collect()] == [0, 0]


def test_temporal_splits_boundaries(spark):
    rows = [(1, datetime(2007, 1, 1)), (2, datetime(2014, 12, 31)), (3, datetime(2015, 6, 15)),
            (4, datetime(2016, 6, 15)), (5, datetime(2006, 12, 31)), (6, datetime(2017, 1, 1)),
            (7, datetime(2014, 12, 31, 12, 0))]
    df = spark.createDataFrame(rows, "id int, issue_d timestamp_ntz")
    spec = SplitSpec.by_years({"train": (2007, 2014), "val": (2015, 2015), "test": (2016, 2016)})
    got = {r.id: r.split for r in prep.temporal_split(df, spec).collect()}
    # midnight of 31 Dec is the upper bound: later times that day fall out
    assert got == {1: "train", 2: "train", 3: "val", 4: "test"}


def test_observation_window(spark):
    rows = [(1, datetime(2007, 6, 11)), (2, datetime(2023, 8, 12)), (3, datetime(2015, 9, 16)),
            (4, datetime(2025, 8, 1)), (5, datetime(2026, 7, 23))]
    df = spark.createDataFrame(rows, "id int, issue_d timestamp_ntz")
    assert prep.snapshot_frame(df).first()[0] == datetime(2026, 7, 23)
    assert sorted(r.id for r in prep.observation_window(df, "issue_d", 24).collect()) == [1, 2, 3]
    assert sorted(r.id for r in prep.observation_window(df, "issue_d", 9).collect()) == [1, 2, 3, 4]


def test_drop_columns_and_derived(spark):
    df = spark.createDataFrame([(1.0, "A", 2.0, 3.0)] * 2, "funded_amnt_inv double, grade string, annual_inc double, dti double")
    assert set(prep.drop_unused(df, ["funded_amnt_inv", "grade", "absent"]).columns) == {"annual_inc", "dti"}
    d = spark.createDataFrame([(datetime(2011, 12, 31), datetime(2007, 12, 31), 10, 30)],
                              "issue_d timestamp_ntz, earliest_cr_line timestamp_ntz, lo int, hi int")
    r = d.select(exprs.credit_age_yrs().alias("age"), exprs.fico_mid("lo", "hi").alias("mid")).first()
    assert abs(r.age - 4.0) < 0.01 and r.mid == 20.0


def test_split_target_and_features(spark):
    df = spark.createDataFrame([(1, 0, 5.0, 1.0), (2, 1, 6.0, 2.0), (3, 0, 7.0, 3.0)], "id int, target int, annual_inc double, dti double")
    x, y = prep.split_xy(df, "id", "target")
    assert "target" not in x.columns and y.columns == ["id", "target"]


def test_month_parse_and_format_round_trip(spark):
    df = spark.createDataFrame([("Dec-2018",), ("bad",), (None,)], "d string")
    got = [r.t for r in df.select(exprs.parse_month("d").alias("t")).collect()]
    assert got == [datetime(2018, 12, 1), None, None]


def test_outlier_rule_limit_and_nulls(spark):
    rows = [(i, datetime(2024, 1, 1, 0, i % 60), 70.0 if i % 2 == 0 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "request_id int, logged_at timestamp_ntz, dti double")
    out = prep.flag_outliers(df, {"dti": 60.0}, limit=20)
    assert out.count() == 20
    assert all(r.value > 60 for r in out.collect())


def test_filter_log_all_optional(spark):
    df = spark.createDataFrame([(1, 0.5, 1, "car", "CA", datetime(2024, 1, 2))], "request_id int, prob double, pred int, purpose string, addr_state string, logged_at timestamp_ntz")
    assert prep.filter_log(df).count() == 1
    assert prep.filter_log(df, min_prob=0.5, max_prob=0.5).count() == 1
    assert prep.filter_log(df, purpose="house").count() == 0


def test_bracket_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (40000.0,), (40000.01,), (150000.0,), (-5.0,)], "x double")
    got = [r.b for r in df.select(exprs.bracket("x", specs.INCOME_EDGES, specs.INCOME_LABELS).alias("b")).collect()]
    assert got == [None, "<40k", "40-80k", ">120k", None]


def test_drift_level_edges(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.3,), (None,), (float("nan"),)], "p double")
    got = [r.l for r in df.select(exprs.drift_level("p").alias("l")).collect()]
    assert got == ["stable", "moderate", "significant", "significant", "significant"]
