"""Ordering, limits and one-row-per-key selection with explicit places for nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asc(c: str) -> Column:
    """Ascending with nulls last."""
    return F.col(c).asc_nulls_last()


def desc(c: str) -> Column:
    """Descending with nulls first."""
    return F.col(c).desc_nulls_first()


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(at)).filter("_rn = 1").drop("_rn")


def top_k_per_group(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(at)).filter(F.col("_rn") <= k).drop("_rn")


def top_n(df: DataFrame, n: int, *order: Column, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n) if offset else df.orderBy(*order).limit(n)


def with_ties(df: DataFrame, n: int, keys: dict[str, bool]) -> DataFrame:
    """The first ``n`` rows and all that equal the last of them; keys: column -> ascending.

    The n-th row's keys come from a top-n, so nothing is sorted in one place.
    """
    names = list(keys)
    order = [asc(k) if up else desc(k) for k, up in keys.items()]
    edge = df.select(*names).orderBy(*order).limit(n)
    last = F.broadcast(edge.orderBy(*[F.col(k).desc_nulls_first() if up else F.col(k).asc_nulls_last() for k, up in keys.items()]).limit(1).select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(names)]))  # one row

    keep = F.lit(True)
    for i, (k, up) in reversed(list(enumerate(keys.items()))):
        c, e = F.col(k), F.col(f"_e{i}")
        if up:
            before = F.when(c.isNull(), False).when(e.isNull(), True).otherwise(c < e)
        else:
            before = F.when(e.isNull(), False).when(c.isNull(), True).otherwise(c > e)
        keep = before | (c.eqNullSafe(e) & keep)
    return df.join(last, keep).drop(*[f"_e{i}" for i in range(len(names))])


def limit_by_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """LIMIT by the single value of a one-row DataFrame; null means no limit."""
    n = scalar.first()[0]
    return df if n is None else df.limit(int(n))
