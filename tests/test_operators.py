"""Selection and join operators, nulls and ties included."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelake.operators import asc, asof_join, desc, distinct_on, lateral_top_k, limit_by_scalar, not_in, pair_counts, range_join, top_n, with_ties


@pytest.fixture
def scores(spark):
    return spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, 7), (5, 5), (6, None), (7, 1)], "id int, x int")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(("n", "up", "want"), [(1, True, [7]), (2, True, [1, 5, 7]), (4, True, [1, 3, 4, 5, 7]), (6, True, list(range(1, 8))), (1, False, [2, 6]), (3, False, [2, 3, 4, 6]), (9, True, list(range(1, 8))), (0, True, [])])
def test_with_ties(scores, n, up, want):
    assert ids(with_ties(scores, n, {"x": up})) == want


def test_with_ties_two_keys(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 2, 0)], "id int, a int, b int")
    assert ids(with_ties(df, 1, {"a": True, "b": True})) == [1, 2]
    assert ids(with_ties(df, 3, {"a": False, "b": False})) == [1, 2, 3, 4]


def test_null_order(scores):
    assert [r["id"] for r in top_n(scores, 3, desc("x"), asc("id")).collect()] == [2, 6, 3]
    assert [r["id"] for r in top_n(scores, 2, asc("x"), asc("id"), offset=5).collect()] == [2, 6]


def test_distinct_on(scores):
    assert ids(distinct_on(scores, ["x"], desc("id"))) == [4, 5, 6, 7]


def test_limit_by_scalar(spark, scores):
    assert limit_by_scalar(scores, spark.range(3).agg(F.count("*"))).count() == 3
    assert limit_by_scalar(scores, spark.sql("select cast(null as int)")).count() == 7


def test_asof(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    left = spark.createDataFrame([("a", t(1), 1), ("a", t(5), 2), ("b", t(9), 3)], "k string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("a", t(2), 10), ("a", t(5), 11), ("a", t(6), 12)], "k string, at timestamp_ntz, v int")
    got = {r["id"]: r["v"] for r in asof_join(left, right, ["k"], "ts", "at", "").collect()}
    assert got == {1: None, 2: 11, 3: None}


def test_asof_strict(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    left = spark.createDataFrame([("a", t(2), 1), ("a", t(5), 2), ("a", t(5), 3), ("b", t(9), 4)], "k string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("a", t(2), 10), ("a", t(5), 11), ("b", t(1), 12)], "k string, at timestamp_ntz, v int")
    got = {r["id"]: r["v"] for r in asof_join(left, right, ["k"], "ts", "at", "", strict=True).collect()}
    assert got == {1: None, 2: 10, 3: 10, 4: 12}


def test_not_in(spark):
    left = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, k int")
    right = spark.createDataFrame([(2,), (5,), (5,)], "v int")
    assert ids(not_in(left, "k", right, "v")) == [1]
    assert ids(not_in(left, "k", right.limit(0), "v")) == [1, 2, 3]
    assert ids(not_in(left, "k", right.union(spark.sql("select cast(null as int)")), "v")) == []
    assert not_in(left, "k", right, "v").columns == ["id", "k"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_range_join_by_bins(spark, how):
    at = lambda m: datetime(2024, 1, 1 + m // 1440, m // 60 % 24, m % 60)
    points = spark.createDataFrame([(i % 3, at(37 * i), i) for i in range(60)] + [(0, None, 60), (None, at(5), 61)], "k int, ts timestamp_ntz, id int")
    spans = [(i % 2, at(200 * i), at(200 * i + n), i) for i, n in enumerate((0, 1, 60, 61, 700, 120, 1500))] + [(0, None, at(9), 7), (1, at(60), at(30), 8)]
    ranges = spark.createDataFrame(spans, "k int, lo timestamp_ntz, hi timestamp_ntz, r int")
    want, got = (range_join(points, ranges, ["k"], "ts", "lo", "hi", how, w) for w in (None, "60 minutes"))
    assert got.columns == want.columns
    key = lambda rows: sorted(map(str, rows))
    assert key(got.collect()) == key(want.collect())


def test_pair_counts(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (None, "x"), (1, None), (3, "x")], "k int, t string")
    b = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, "y"), (None, "x"), (1, None), (3, "x")], "k int, t string")
    assert sorted(pair_counts(a, b, ["k", "t"], "n").collect()) == sorted(a.join(b, ["k", "t"]).groupBy("k", "t").agg(F.count("*")).collect()) == [(1, "x", 6), (3, "x", 1)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lateral_top_k(spark, how):
    left = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, None), (5, 1)], "id int, k int")
    right = spark.createDataFrame([(1, 10, 5), (1, 11, 9), (1, 12, 9), (2, 13, None), (2, 14, 1), (None, 15, 9), (9, 16, 9)], "r int, v int, x int")
    got = lateral_top_k(left, right, "k", "r", 2, F.col("x").desc_nulls_last(), asc("v"), how=how).select("id", "v").collect()
    want = [(1, 11), (1, 12), (2, 13), (2, 14), (5, 11), (5, 12)] + ([(3, None), (4, None)] if how == "left" else [])
    assert sorted(got, key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        lateral_top_k(left, right, "k", "r", 1, asc("v"), how="full")
