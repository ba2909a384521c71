"""Aggregates that differ from the built-in ones in nulls, types or cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _edge(pick, value: Column | str, ts: Column | str, tie: Column | str | None) -> Column:
    v, t = _col(value), _col(ts)
    order = t if tie is None else F.struct(t, _col(tie))
    return pick(F.when(v.isNotNull() & t.isNotNull(), F.struct(v.alias("v"))), F.when(v.isNotNull() & t.isNotNull(), order))["v"]


def first(value: Column | str, ts: Column | str, tie: Column | str | None = None) -> Column:
    """Value at the earliest time; rows with a null value or time are passed over; null if there is none.

    ``tie`` settles equal times (the smallest wins).
    """
    return _edge(F.min_by, value, ts, tie)


def last(value: Column | str, ts: Column | str, tie: Column | str | None = None) -> Column:
    """Value at the latest time; otherwise as ``first`` (of equal times the largest ``tie`` wins)."""
    return _edge(F.max_by, value, ts, tie)


def sum_exact(c: Column | str) -> Column:
    """Sum of bigints that cannot overflow."""
    return F.sum(_col(c).cast("decimal(38,0)"))


def sum_plus(c: Column | str, constants: list[int], prefix: str) -> list[Column]:
    """``sum(c + k)`` for many k from one sum and one count."""
    s, n = F.sum(_col(c).cast("long")), F.count(_col(c))
    return [(s + F.lit(k).cast("long") * n).alias(f"{prefix}{k}") for k in constants]


def ordered_array_agg(value: Column | str, *order: Column | str) -> Column:
    """Array of values in the order of ``order`` (ascending)."""
    rows = F.array_sort(F.collect_list(F.struct(*[_col(o).alias(f"o{i}") for i, o in enumerate(order)], _col(value).alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def distinct_count_with(df: DataFrame, keys: list[str], distinct: str, sums: dict[str, Column], alias: str) -> DataFrame:
    """count(distinct) beside sums, by two plain aggregations instead of an expanded one."""
    inner = df.groupBy(*keys, distinct).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    return inner.groupBy(*keys).agg(F.count(distinct).alias(alias), *[F.sum(k).alias(k) for k in sums])
