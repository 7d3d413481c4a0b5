"""Order of the rows where order is the feature (the oracle sweep compares rows as sets)."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
#: query -> columns of its order; "-" is descending.
ORDER = {
    "A1_null_rates": ["-null_pct", "column"],
    "A4_rate_by_category": ["-default_rate_pct"],
    "O1_sort_by_date": ["issue_d"],
    "H9_O2_list_predictions_page": ["-logged_at", "-request_id"],
    "O4_top_drift": ["-PSI", "feature", "target_label"],
    "D5_O5_flagged_features": ["-PSI", "feature", "target_label"],
    "O8_segments_by_size": ["-n"],
    "O9_categories_by_share": ["-reference_pct", "category"],
    "S13_query_runs": ["-value", "run_name"],
    "D10_drift_history": ["computed_at"],
}


@pytest.mark.parametrize("name", list(ORDER))
def test_rows_come_in_order(spark, name):
    rows = [r.asDict() for r in entry.queries()[name](spark, SF).collect()]
    cols = [c for c in ORDER[name] if c.lstrip("-") in rows[0]]
    assert cols and len(rows) > 1
    for a, b in zip(rows, rows[1:]):
        for c in cols:
            x, y = a[c.lstrip("-")], b[c.lstrip("-")]
            if x == y:
                continue
            assert (x > y) if c.startswith("-") else (x < y), (name, c, x, y)
            break
