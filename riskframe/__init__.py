"""riskframe: loan-portfolio analytics as Spark DataFrame jobs.

Every public operator is a function ``f(df, ...) -> DataFrame`` (or a Column
expression) that stays lazy, runs on executors and never collects rows to the
driver. Parameters (column names, windows, cut points, costs) are explicit.
"""

from riskframe.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
