"""Plans are the ones that were meant."""

import re

from pyspark.sql import functions as F

from tidelake import queries as core
from tidelake.operators import distinct_on
from tidelake.plans.explain import cost, summary


def test_summary(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("wide")).write.parquet(f"file://{tmp_path}/t")
    t = spark.read.parquet(f"file://{tmp_path}/t")
    one = summary(t.filter("id > 5").groupBy("k").agg(F.sum("id")))
    assert one["columns"] == [["id", "k"]] and "GreaterThan(id,5)" in one["pushed_filters"][0]
    assert (one["exchanges"], one["broadcasts"], one["python"], one["joins"]) == (1, 0, 0, [])
    assert one["files"] >= 1
    two = summary(t.join(t.select("k").distinct(), "k", "left_semi"))
    assert len(two["joins"]) == 1
    assert "WindowGroupLimit" in distinct_on(t, ["k"], F.col("id").desc())._jdf.queryExecution().executedPlan().toString()
    assert "sizeInBytes" in cost(t)


def test_c15_counts_pairs_without_making_them(spark, tmp_path):
    n = 1 << 18  # 2^34 pairs
    e = spark.range(2 * n).select((F.col("id") * 10).alias("user_id"), F.when(F.col("id") < n, "error").otherwise("signup").alias("event_type"))
    e.write.parquet(f"file://{tmp_path}/events.parquet")
    got = core.queries()["c15_using"](spark, f"file://{tmp_path}")
    assert got._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == 4  # both sides, before the join
    assert [tuple(r) for r in got.collect()] == [(0, n * n)]


def test_d12_keeps_one_sketch_a_task(spark, tmp_path):
    e = spark.range(20000).select(F.when(F.col("id") % 9 > 0, F.col("id") % 7919).alias("user_id"))
    e.write.parquet(f"file://{tmp_path}/events.parquet")
    got = core.queries()["d12_approx_distinct"](spark, f"file://{tmp_path}")
    aggregates = re.findall(r"Aggregate\(keys=\[(.*?)\], functions=\[(.*?)\], output", got._jdf.queryExecution().executedPlan().toString())
    sketches = [keys for keys, functions in aggregates if "approx_count_distinct" in functions]
    assert len(sketches) == 2 and not any(sketches)  # no sketch is kept by key
    assert [tuple(r) for r in got.collect()] == [(True,)]
    e.limit(0).write.parquet(f"file://{tmp_path}/none/events.parquet")
    assert [tuple(r) for r in core.queries()["d12_approx_distinct"](spark, f"file://{tmp_path}/none").collect()] == [(True,)]
