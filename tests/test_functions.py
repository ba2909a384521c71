"""Column functions on small fixtures."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelake.functions import contains_all, extract_leaf, first, json_text, last, ordered_array_agg, replace_first, similar_to, sum_plus, time_bucket
from tidelake.functions.json import leaves, resolve
from tidelake.functions.text import similar_regex
from tidelake.functions.time import interval_micros


def one(df):
    return [tuple(r) for r in df.collect()]


def test_intervals():
    assert interval_micros("1 day 6 hours") == 108_000_000_000
    for bad in ("1 month", "nonsense", "2 fortnights", ""):
        with pytest.raises(ValueError):
            interval_micros(bad)


@pytest.mark.parametrize(
    ("width", "offset", "at", "want"),
    [
        ("7 days", None, datetime(2024, 1, 10, 5), datetime(2024, 1, 6)),
        ("1 day", "6 hours", datetime(2024, 1, 10, 5), datetime(2024, 1, 9, 6)),
        ("1 hour", None, datetime(1999, 12, 31, 23, 59, 59, 999999), datetime(1999, 12, 31, 23)),
        ("1 hour", None, datetime(2000, 1, 1), datetime(2000, 1, 1)),
    ],
)
def test_time_bucket(spark, width, offset, at, want):
    df = spark.createDataFrame([(at,)], "ts timestamp_ntz").select(time_bucket(width, "ts", offset))
    assert one(df) == [(want,)]


def test_time_bucket_rejects():
    for width in ("0 days", "-1 hour", "1 month"):
        with pytest.raises(ValueError):
            time_bucket(width, "ts")


def test_first_last_nulls_and_ties(spark):
    t = datetime(2024, 1, 1)
    rows = [(None, t, 1), (5.0, None, 2), (1.0, t, 4), (2.0, t, 3)]
    df = spark.createDataFrame(rows, "v double, ts timestamp_ntz, id int")
    assert one(df.agg(first("v", "ts", "id"), last("v", "ts", "id"))) == [(2.0, 1.0)]
    assert one(df.filter("v is null").agg(first("v", "ts"), last("v", "ts"))) == [(None, None)]
    assert one(df.filter("false").agg(first("v", "ts"))) == [(None,)]


def test_sum_plus_counts_only_known(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert one(df.agg(*sum_plus("x", [0, 10], "s"))) == [(4, 24)]


def test_ordered_array(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), (None, 3)], "v string, o int")
    assert one(df.agg(ordered_array_agg("v", "o"))) == [(["a", "b", None],)]


def test_similar_to(spark):
    df = spark.createDataFrame([("abc",), ("xabc",), ("a_c",), ("a\nc",), (None,)], "s string")
    assert one(df.select(similar_to("s", "a%c"))) == [(True,), (False,), (True,), (True,), (None,)]
    assert one(df.select(similar_to("s", r"a\_c")))[:3] == [(False,), (False,), (True,)]
    assert similar_regex("[[:digit:]]+").endswith(r"[\p{Digit}]+)\z")


def test_replace_first(spark):
    df = spark.createDataFrame([("aaa",), ("bab",), ("xyz",)], "s string")
    assert one(df.select(replace_first("s", "a", "b"))) == [("baa",), ("bbb",), ("xyz",)]
    assert one(df.select(replace_first("s", "^(.)(.*)$", r"\2\1"))) == [("aaa",), ("abb",), ("yzx",)]


LEAVES = [
    ('{"a": {"n": 7, "s": "x", "b": true, "f": 1.5, "i": "12", "t": "2024-01-02 03:04:05", "big": 99999999999}}', True),
    ('{"a": {"n": null}}', True), ("not json", True), (None, True), ('{"a": 3}', True),
]


def test_leaves(spark):
    df = spark.createDataFrame(LEAVES, "d string, x boolean")
    kinds = [("n", "bigint"), ("s", "bigint"), ("i", "bigint"), ("big", "int"), ("f", "float"), ("i", "float"), ("b", "boolean"), ("s", "boolean"), ("n", "text"), ("b", "text"), ("t", "timestamp"), ("n", "timestamp")]
    got = one(df.select(*[extract_leaf("d", ("a", p), k).alias(f"c{i}") for i, (p, k) in enumerate(kinds)]))
    assert got[0] == (7, None, 12, None, 1.5, None, True, None, "7", "true", datetime(2024, 1, 2, 3, 4, 5), None)
    assert all(set(r) == {None} for r in got[1:])


def test_contains_all(spark):
    df = spark.createDataFrame([('{"s": ["a", "b", "c"]}',), ('{"s": ["a"]}',), ('{"s": []}',)], "d string")
    assert one(df.select(contains_all("d", ("s",), ["a", "b"]))) == [(True,), (False,), (False,)]
    assert one(df.select(json_text("d", "s")))[1] == ('["a"]',)


@pytest.mark.parametrize(
    "bad",
    [
        {"src": "nope", "path": ["k"], "name": "x", "type": "text"}, {"src": "d", "path": [], "name": "x", "type": "text"},
        {"src": "d", "path": [1], "name": "x", "type": "text"}, {"src": "d", "path": ["k"], "name": "d", "type": "text"},
        {"src": "d", "path": ["k"], "name": "1x", "type": "text"}, {"src": "d", "path": ["k"], "name": "x", "type": "jsonb"}, {"src": "d"},
    ],
)
def test_leaf_specification(bad):
    with pytest.raises(ValueError):
        leaves([bad], ["d"])


def test_resolve(spark):
    spec = leaves([{"src": "d", "path": ["k"], "name": "d_k", "type": "bigint"}], ["d"])
    df = spark.createDataFrame([('{"k": 1, "z": 2}', 1)], "d string, d_k long")
    assert one(df.select(resolve(spec, "d", "k"), resolve(spec, "d", "z"))) == [(1, "2")]
    assert "get_json_object" not in df.select(resolve(spec, "d", "k"))._jdf.queryExecution().optimizedPlan().toString()


def test_no_python_in_plans(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), "{}")], "ts timestamp_ntz, d string")
    plan = df.select(time_bucket("1 hour", "ts"), extract_leaf("d", ("a",), "bigint"), F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
