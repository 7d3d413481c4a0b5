"""Small parameter objects passed to operators, plus the fixed values that must
equal the original system's for results to agree.

Nothing here holds data; every operator takes its columns, windows, cut
points and costs from these specs or from explicit arguments.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

# --------------------------------------------------------------------------
# Fixed values (must equal the original system's for identical results).
# --------------------------------------------------------------------------

# Loan status -> label. ``None`` marks ambiguous statuses whose rows are removed;
# statuses not listed (and NULL) become 0.
STATUS_TO_LABEL = {
    "Fully Paid": 0,
    "Current": 0,
    "Charged Off": 1,
    "Late (31-120 days)": 1,
    "In Grace Period": None,
    "Late (16-30 days)": None,
    "Does not meet the credit policy. Status:Fully Paid": 0,
    "Does not meet the credit policy. Status:Charged Off": 1,
    "Default": 1,
}

# Post-origination columns that leak the outcome; dropped before labelling.
LEAKAGE_COLUMNS = [
    "total_pymnt", "total_pymnt_inv", "total_rec_prncp", "total_rec_int", "total_rec_late_fee",
    "recoveries", "collection_recovery_fee", "last_pymnt_d", "last_pymnt_amnt", "next_pymnt_d",
    "out_prncp", "out_prncp_inv", "last_credit_pull_d", "last_fico_range_high", "last_fico_range_low",
    "hardship_flag", "hardship_type", "hardship_reason", "hardship_status", "hardship_start_date",
    "hardship_end_date", "hardship_amount", "hardship_length", "hardship_dpd", "hardship_loan_status",
    "payment_plan_start_date", "deferral_term", "orig_projected_additional_accrued_interest",
    "hardship_payoff_balance_amount", "hardship_last_payment_amount", "debt_settlement_flag",
    "debt_settlement_flag_date", "settlement_status", "settlement_date", "settlement_amount",
    "settlement_percentage", "settlement_term", "id", "member_id", "url", "pymnt_plan",
]

# Statuses counted as resolved by the naive (censored) labelling.
RESOLVED_STATUSES = {"Fully Paid": 0, "Charged Off": 1}

# Null tokens of the raw CSV reader (in addition to the empty string).
# The reader's own tokens and the default missing-value tokens of pandas' CSV reader.
NULL_TOKENS = [
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Drift level cut points: psi < 0.1 stable, < 0.25 moderate, otherwise significant.
DRIFT_STABLE_BELOW = 0.1
DRIFT_MODERATE_BELOW = 0.25

# PSI share floor.
PSI_FLOOR = 1e-4

# Log health: categories with at most this many rows are flagged.
SINGLETON_COUNT_THRESHOLD = 5
# Log health: domain outlier rules (feature, lower bound that is exceeded).
OUTLIER_RULES = {"dti": 60.0, "pub_rec": 10.0, "delinq_2yrs": 8.0, "revol_util": 100.0}
# Log health: at most this many outlier rows listed per rule.
OUTLIER_LIST_LIMIT = 20
# Log health: columns excluded from the duplicate-payload comparison.
DUPLICATE_EXCLUDED = ["id", "request_id", "logged_at", "pred", "prob", "reason_codes", "target"]
# Live drift: fewer live rows than this raises a sample-size warning.
MIN_LIVE_SAMPLE_SIZE = 30

# Nullable numeric inputs of the prediction log.
NULLABLE_NUMERIC_COLS = [
    "mths_since_last_delinq",
    "mths_since_last_record",
    "mths_since_last_major_derog",
    "mths_since_recent_bc",
    "mths_since_recent_bc_dlq",
    "mths_since_recent_inq",
    "mths_since_recent_revol_delinq",
]

# Employment-length levels in natural order.
EMP_LENGTH_LEVELS = [
    "< 1 year", "1 year", "2 years", "3 years", "4 years", "5 years",
    "6 years", "7 years", "8 years", "9 years", "10+ years",
]

# Grade order (sub-grades are grade letter + digit 1..5).
GRADES = ["A", "B", "C", "D", "E", "F", "G"]

# Income brackets: right-closed (0,40k], (40k,80k], (80k,120k], (120k, inf).
INCOME_EDGES = [0.0, 40_000.0, 80_000.0, 120_000.0, float("inf")]
INCOME_LABELS = ["<40k", "40-80k", "80-120k", ">120k"]

# Threshold grid of the cost tuner: 99 points 0.01 ... 0.99.
GRID_START = 0.01
GRID_STOP = 0.99
GRID_POINTS = 99

# Demo-payload APR by FICO bucket: (lower FICO bound, APR %), checked top-down.
APR_BY_FICO = [(760, 7.5), (720, 9.5), (680, 12.0), (640, 16.0), (600, 21.0)]
APR_FLOOR = 26.0

# Composite demo risk score weights.
RISK_WEIGHTS = {"fico": 0.35, "dti": 0.25, "util": 0.20, "delinq": 0.12, "inq": 0.08}
# Composite demo risk score scales: fico (820 - low) / (820 - 600), dti / 40,
# util / 100, delinquencies / 5, inquiries / 10.
RISK_FICO_TOP = 820.0
RISK_FICO_SPAN = 220.0
RISK_DTI_SCALE = 40.0
RISK_UTIL_SCALE = 100.0
RISK_DELINQ_SCALE = 5.0
RISK_INQ_SCALE = 10.0

# Reason-code strength cut points relative to the strongest code.
STRENGTH_STRONG_ABOVE = 0.66
STRENGTH_MODERATE_ABOVE = 0.33


# --------------------------------------------------------------------------
# Specs
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnRoles:
    """Which columns play which role; no operator hard-wires a column list."""

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    target: str = "target"
    date: str = "issue_d"
    key: str = "loan_id"
    drop: tuple[str, ...] = ()

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.numeric) + tuple(self.categorical)

    def without(self, *cols: str) -> "ColumnRoles":
        """Regime variant without some features (e.g. the lender's own grade/rate)."""
        gone = set(cols)
        return ColumnRoles(
            numeric=tuple(c for c in self.numeric if c not in gone),
            categorical=tuple(c for c in self.categorical if c not in gone),
            target=self.target,
            date=self.date,
            key=self.key,
            drop=tuple(self.drop) + tuple(cols),
        )


@dataclass(frozen=True)
class LabelSpec:
    status_col: str = "loan_status"
    mapping: dict = field(default_factory=lambda: dict(STATUS_TO_LABEL))
    target: str = "target"

    @property
    def bad(self) -> list[str]:
        return [k for k, v in self.mapping.items() if v == 1]

    @property
    def ambiguous(self) -> list[str]:
        return [k for k, v in self.mapping.items() if v is None]


@dataclass(frozen=True)
class SplitSpec:
    """Inclusive date ranges per split; an upper bound is midnight of its last day."""

    ranges: tuple[tuple[str, datetime, datetime], ...]
    date: str = "issue_d"

    @staticmethod
    def by_years(years: dict[str, tuple[int, int]], date: str = "issue_d") -> "SplitSpec":
        return SplitSpec(
            tuple((name, datetime(a, 1, 1), datetime(b, 12, 31)) for name, (a, b) in years.items()),
            date,
        )


@dataclass(frozen=True)
class CostSpec:
    fn_cost: float = 10_000.0
    fp_cost: float = 2_000.0

    @property
    def theoretical_threshold(self) -> float:
        return self.fp_cost / (self.fp_cost + self.fn_cost)


# ----------------------------------------------------------------- full application (fixed values)

#: The 66 inputs of an application, in the order in which the prediction log stores them.
APPLICATION_FIELDS = """
loan_amnt installment annual_inc dti delinq_2yrs inq_last_6mths open_acc pub_rec revol_bal revol_util total_acc
collections_12_mths_ex_med acc_now_delinq tot_coll_amt tot_cur_bal total_rev_hi_lim acc_open_past_24mths avg_cur_bal bc_open_to_buy
bc_util chargeoff_within_12_mths delinq_amnt mo_sin_old_il_acct mo_sin_old_rev_tl_op mo_sin_rcnt_rev_tl_op mo_sin_rcnt_tl mort_acc
num_accts_ever_120_pd num_actv_bc_tl num_actv_rev_tl num_bc_sats num_bc_tl num_il_tl num_op_rev_tl num_rev_accts num_rev_tl_bal_gt_0
num_sats num_tl_120dpd_2m num_tl_30dpd num_tl_90g_dpd_24m num_tl_op_past_12m pct_tl_nvr_dlq percent_bc_gt_75 pub_rec_bankruptcies
tax_liens tot_hi_cred_lim total_bal_ex_mort total_bc_limit total_il_high_credit_limit fico_range_low fico_range_high
mths_since_last_delinq mths_since_last_record mths_since_last_major_derog mths_since_recent_bc mths_since_recent_bc_dlq
mths_since_recent_inq mths_since_recent_revol_delinq earliest_cr_line term emp_length home_ownership verification_status purpose
addr_state initial_list_status
""".split()

#: 1 where the risk score lies above the bound, else 0.
FLAGS_ABOVE_RISK = {"pub_rec": 0.75, "tax_liens": 0.9, "collections_12_mths_ex_med": 0.7, "chargeoff_within_12_mths": 0.8}
#: 1 from that number of delinquencies in two years, else 0.
FLAGS_FROM_DELINQ = {"acc_now_delinq": 4, "num_accts_ever_120_pd": 2, "num_tl_90g_dpd_24m": 3}
#: Rounded base + a * risk + b * (1 - risk).
RISK_LINES = {
    "num_tl_op_past_12m": (1.0, 3.0, 0.0),
    "delinq_amnt": (200.0, 800.0, 0.0),
    "tot_coll_amt": (0.0, 500.0, 0.0),
    "mths_since_last_record": (30.0, 20.0, 0.0),
    "mths_since_last_major_derog": (20.0, -10.0, 0.0),
    "mths_since_recent_bc": (6.0, 0.0, 30.0),
    "mths_since_recent_bc_dlq": (12.0, 20.0, 0.0),
    "mths_since_recent_revol_delinq": (15.0, 25.0, 0.0),
}
#: Verification status by risk score: below the bound; else the last.
VERIFICATION_BY_RISK = [(0.3, "Verified"), (0.6, "Source Verified")]
VERIFICATION_ELSE = "Not Verified"
#: What the form does not ask.
APPLICATION_CONSTANTS = {"addr_state": "CA", "initial_list_status": "w"}
