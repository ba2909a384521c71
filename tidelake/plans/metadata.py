"""Aggregates that file or slice metadata can answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fast_count(df: DataFrame, alias: str = "n") -> DataFrame:
    """count(*): no column is read; the v2 Parquet source takes it from footers."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def fast_min_max(df: DataFrame, column: str) -> DataFrame:
    """lo, hi and n of a numeric column, in a shape the v2 Parquet source takes from footers."""
    return df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"))


def pushed(df: DataFrame) -> list[str]:
    """Aggregates the plan takes from footers, as shown by its scan."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.search(r"PushedAggregation: \[([^\]]*)\]", plan)
    return [x.strip() for x in found[1].split(", ")] if found and found[1] else []
