"""Helpers shared by the bound queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column half-up (engines differ in the last bits of sums)."""
    from riskframe.functions.exprs import round6

    return df.select(*[
        round6(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def union_sql(template: str, items) -> str:
    """``UNION ALL`` of a template formatted once per item (item as ``{c}``)."""
    return " UNION ALL ".join(template.format(c=c) for c in items)
