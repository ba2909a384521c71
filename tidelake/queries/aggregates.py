"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions import date_trunc, distinct_count_with, extract, first, last, ordered_array_agg, replace_first, sum_exact, sum_plus, time_bucket
from tidelake.plans.metadata import fast_count, fast_min_max
from tidelake.queries.base import Registry

Q = Registry()


@Q.frame("d34_d35_bucket_first_last", """select time_bucket(interval '1 hour', ts, timestamp '2000-01-01') as bucket, event_type, count(*) as n,
  round(avg(value), 6) as avg_value, arg_min(value, ts) as first_value, arg_max(value, ts) as last_value from events group by 1, 2""")
def _bucket(_, load):
    e = load("events").groupBy(time_bucket("1 hour", "ts").alias("bucket"), "event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"), first("value", "ts", "event_id").alias("first_value"), last("value", "ts", "event_id").alias("last_value"))


@Q.frame("d01_count_star", "select count(*) as n from lineitem")
def _count(_, load):
    return fast_count(load("lineitem"), "n")


@Q.frame("d02_min_max_numeric", "select min(l_quantity) as lo, max(l_quantity) as hi, count(l_quantity) as n from lineitem")
def _extremes(_, load):
    return fast_min_max(load("lineitem"), "l_quantity")


Q.same("d02_min_max_time", "select min(ts) as lo, max(ts) as hi, count(ts) as n from events")
Q.same("d03_meta_time_range", "select count(*) as n, max(value) as hi from events where ts >= timestamp '2024-01-04 00:00:00' and ts < timestamp '2024-01-11 00:00:00'")
Q.same("d04_filtered_sums", "select count(*) as n, cast(sum(user_id) as bigint) as s from events where value > 50 and user_id between 10 and 400")


@Q.frame("d05_sum_plus_const", "select " + ", ".join(f"cast(sum(user_id + {k}) as bigint) as s{k}" for k in range(90)) + " from events")
def _wide(_, load):
    return load("events").agg(*sum_plus("user_id", list(range(90)), "s"))


Q.same("d06_int_key", "select user_id, count(*) as n, cast(sum(event_id) as bigint) as s, min(value) as lo, max(value) as hi from events group by user_id")
Q.same("d07_text_key", "select event_type, count(*) as n, round(avg(value), 6) as a from events group by event_type")
Q.same("d07_mixed_keys", "select event_type, user_id % 10 as k, cast(ts as date) as d, count(*) as n from events group by event_type, user_id % 10, cast(ts as date)")
Q.same("d08_count_distinct_only", "select count(distinct user_id) as u, count(distinct event_type) as t from events")
Q.same("d11_count_distinct_text", "select count(distinct p_name) as n from part")
Q.same("d11_count_distinct_grouped", "select event_type, count(distinct user_id) as u from events group by event_type")
Q.same("d13_sum_avg_min_max", "select cast(sum(l_linenumber) as bigint) as s, round(avg(l_quantity), 6) as a, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem")
Q.same("d14_min_max_text", "select min(p_name) as lo, max(p_name) as hi, min(p_brand) as b0, max(p_type) as t1 from part")
Q.same("d15_avg_length", "select p_brand, round(avg(length(p_name)), 6) as a, cast(sum(length(p_name)) as bigint) as s from part group by p_brand")
Q.same("d17_null_group", "select nullif(event_type, 'click') as k, count(*) as n from events group by nullif(event_type, 'click')")
Q.same("d17_multi_key", "select l_returnflag, l_linestatus, count(*) as n, cast(sum(l_quantity) as double) as q, round(avg(l_discount), 6) as d from lineitem group by l_returnflag, l_linestatus")
Q.same("d23_case_key", "select case when user_id < 100 and value > 50 then event_type when user_id < 200 then 'middle' end as k, count(*) as n from events group by 1")
Q.same("d24_literal_key", "select 1 as one, event_type, count(*) as n from events group by 1, event_type")
Q.same("d25_having", "select user_id, count(*) as n from events group by user_id having count(*) > 12 and min(value) < 5")
Q.same("d26_having_null", "select user_id, max(nullif(event_type, 'click')) as m from events group by user_id having max(nullif(event_type, 'click')) is null")
Q.same("d27_filter_clause", "select user_id % 5 as k, count(*) filter (where event_type = 'click') as clicks, max(value) filter (where event_type = 'purchase') as top from events group by user_id % 5")
Q.same("d28_rollup", "select event_type, coalesce(user_id % 3, -1) as k, count(*) as n, cast(grouping(event_type) as bigint) as g from events group by rollup(event_type, user_id % 3)")
Q.sql("d28_grouping_sets", "select event_type, coalesce(k, -1) as k, count(*) as n, cast(grouping_id(event_type, k) as bigint) as g from (select *, user_id % 3 as k from events) group by grouping sets ((event_type, k), (event_type), ())", "select event_type, coalesce(k, -1) as k, count(*) as n, grouping_id(event_type, k) as g from (select *, user_id % 3 as k from events) group by grouping sets ((event_type, k), (event_type), ())")
Q.same("d29_cube", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube(l_returnflag, l_linestatus)")
Q.same("d31_expressions", "select event_type, cast(sum(abs(user_id - 500) * 2) as bigint) as s, round(avg(value * value), 4) as sq from events group by event_type")
Q.same("d32_empty", "select count(*) as n, sum(value) as s, coalesce(max(user_id), -1) as m, avg(value) as a from events where user_id < 0")
Q.same("d32_empty_grouped", "select event_type, count(*) as n from events where user_id < 0 group by event_type")
Q.same("d36_distinct", "select distinct event_type, user_id % 4 as k from events")


@Q.frame("d13_sum_exact", "select cast(sum(cast(event_id as hugeint) * 1000000000000) as varchar) as s from events")
def _exact(_, load):
    return load("events").agg(sum_exact(F.col("event_id").cast("decimal(38,0)") * F.lit(10**12)).cast("string").alias("s"))


@Q.frame("d12_approx_distinct", "select true as near from (select 1)")
def _approx(_, load):
    e = load("events")
    a = e.agg(F.approx_count_distinct("user_id", 0.01).alias("a"))  # a sketch a task; beside a count of distinct values it would be one a value
    n = e.select("user_id").distinct().agg(F.count("user_id").alias("n"))
    return a.crossJoin(n).select((F.abs(F.col("a") - F.col("n")) <= F.lit(0.05) * F.col("n")).alias("near"))


@Q.frame("d16_epoch_shift", "select min(timestamp '1970-01-01' + to_microseconds(event_id * 1000)) as lo, max(timestamp '1970-01-01' + to_microseconds(event_id * 1000)) as hi from events")
def _shift(_, load):
    from tidelake.functions import micros_to_timestamp

    ends = load("events").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))  # the shift is monotone: it can wait
    return ends.select(micros_to_timestamp(F.col("a") * 1000).alias("lo"), micros_to_timestamp(F.col("b") * 1000).alias("hi"))


for _unit in ("minute", "hour", "day", "month"):

    @Q.frame(f"d18_date_trunc_{_unit}", f"select date_trunc('{_unit}', ts) as t, count(*) as n from events group by 1")
    def _by_unit(_, load, unit=_unit):
        return load("events").groupBy(date_trunc(unit, "ts").alias("t")).agg(F.count("*").alias("n"))


for _field in ("minute", "hour", "dow", "epoch", "second", "millisecond", "microsecond"):
    _duck = {"epoch": "cast(floor(epoch(ts)) as bigint)"}.get(_field, f"cast(extract({_field} from ts) as bigint)")

    @Q.frame(f"d19_extract_{_field}", f"select {_duck} as f, count(*) as n from events group by 1")
    def _by_field(_, load, field=_field):
        return load("events").groupBy(extract(field, "ts").alias("f")).agg(F.count("*").alias("n"))


Q.sql("d20_hour_of_epoch", "select cast(hour(timestamp_seconds(event_id * 977 div 10)) as bigint) as h, count(*) as n from events group by 1", "select extract(hour from (timestamp '1970-01-01' + to_seconds(event_id * 977 // 10))) as h, count(*) as n from events group by 1")


@Q.frame("d21_regexp_key", r"select regexp_replace(p_name, '^([a-z]+) .*$', '\1') as k, count(*) as n, min(p_name) as m from part group by 1")
def _regexp(_, load):
    return load("part").groupBy(replace_first("p_name", r"^([a-z]+) .*$", r"\1").alias("k")).agg(F.count("*").alias("n"), F.min("p_name").alias("m"))


@Q.frame("d22_derived_keys", "select user_id, user_id - 1 as k1, user_id - 2 as k2, user_id - 3 as k3, count(*) as n from events group by 1, 2, 3, 4")
def _derived(_, load):
    one = load("events").groupBy("user_id").agg(F.count("*").alias("n"))  # the other keys follow from it
    return one.select("user_id", *[(F.col("user_id") - k).alias(f"k{k}") for k in (1, 2, 3)], "n")


@Q.frame("d30_ordered_array_agg", "select user_id, array_to_string(list(event_id order by ts, event_id), ',') as ids from events group by user_id")
def _ordered(_, load):
    ids = ordered_array_agg(F.col("event_id").cast("string"), "ts", "event_id")
    return load("events").groupBy("user_id").agg(F.array_join(ids, ",").alias("ids"))


@Q.frame("d33_distinct_beside", "select event_type, count(distinct user_id) as u, count(*) as n, cast(sum(event_id) as bigint) as s from events group by event_type")
def _beside(_, load):
    return distinct_count_with(load("events"), ["event_type"], "user_id", {"n": F.lit(1).cast("long"), "s": F.col("event_id")}, "u")
