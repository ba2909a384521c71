"""Shapes of web-analytics, order-tracking and JSON benchmarks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions import date_trunc, extract, json_text, micros_to_timestamp, replace_first
from tidelake.queries.base import Registry

Q = Registry()

# web analytics over events and part
for _name, _sql in {
    "w01_count_where": "select count(*) as n from events where user_id <> 0",
    "w02_sums": "select cast(sum(user_id) as bigint) as s, count(*) as n, round(avg(value), 6) as a from events",
    "w07_group_filter": "select event_type, count(*) as n from events where value <> 0 group by event_type order by n desc, event_type",
    "w08_top_distinct": "select event_type, count(distinct user_id) as u from events group by event_type order by u desc, event_type limit 10",
    "w09_multi_agg": "select user_id % 20 as region, cast(sum(event_id) as bigint) as s, count(*) as c, round(avg(value), 6) as a, count(distinct user_id) as u from events group by user_id % 20 order by c desc, region limit 10",
    "w11_two_keys": "select p_brand, p_size, count(distinct p_name) as u from part where p_type <> '' group by p_brand, p_size order by u desc, p_brand, p_size limit 10",
    "w12_top_text": "select p_name, count(*) as c from part where p_name <> '' group by p_name order by c desc, p_name limit 10",
    "w15_top_key": "select l_partkey, count(*) as c from lineitem group by l_partkey order by c desc, l_partkey limit 10",
    "w16_two_key_top": "select l_partkey, l_returnflag, count(*) as c from lineitem group by l_partkey, l_returnflag order by c desc, l_partkey, l_returnflag limit 10",
    "w19_point_lookup": "select user_id, event_id from events where user_id = 123",
    "w20_like_count": "select count(*) as n from part where p_name like '%an%'",
    "w21_like_group": "select p_brand, min(p_name) as m, count(*) as c from part where p_name like '%e%' and p_brand <> '' group by p_brand order by c desc, p_brand limit 10",
    "w22_like_not_like": "select p_brand, min(p_name) as m, min(p_type) as t, count(*) as c, count(distinct p_size) as u from part where p_name like '%e%' and p_type not like '%x%' group by p_brand order by c desc, p_brand limit 10",
    "w23_star_like_top": "select * from part where p_name like '%o%' order by p_retailprice desc, p_partkey limit 10",
    "w24_text_by_time": "select event_type, event_id from events where event_type <> '' order by ts, event_id limit 10",
    "w27_avg_length_having": "select p_brand, round(avg(length(p_name)), 6) as l, count(*) as c from part where p_name <> '' group by p_brand having count(*) > 5 order by l desc, p_brand limit 25",
    "w30_two_key_sums": "select l_suppkey, l_linenumber, count(*) as c, cast(sum(l_quantity) as double) as q, round(avg(l_discount), 6) as d from lineitem where l_returnflag <> 'N' group by l_suppkey, l_linenumber order by c desc, l_suppkey, l_linenumber limit 10",
    "w34_literal_group": "select 1 as one, p_name, count(*) as c from part group by 1, p_name order by c desc, p_name limit 10",
    "w36_many_filters": "select event_type, count(*) as v from events where user_id between 60 and 400 and ts >= timestamp '2024-01-03 00:00:00' and ts <= timestamp '2024-01-25 00:00:00' and value > 1 and event_type <> '' group by event_type order by v desc, event_type limit 10",
    "w38_offset_deep": "select user_id, count(*) as v from events where ts >= timestamp '2024-01-02 00:00:00' group by user_id order by v desc, user_id limit 10 offset 100",
    "w39_case_key": "select event_type, case when (user_id % 2 = 0 and value > 50) then props else '' end as src, count(*) as v from events group by event_type, case when (user_id % 2 = 0 and value > 50) then props else '' end order by v desc, event_type, src limit 10 offset 5",
    "w40_in_list": "select user_id, cast(ts as date) as d, count(*) as v from events where user_id in (1, 6, 62, 77) group by user_id, cast(ts as date)",
    # order tracking
    "r02_max_in_range": "select max(value) as m from events where ts >= timestamp '2024-01-04 00:00:00' and ts < timestamp '2024-01-09 00:00:00'",
    "r03_exists_join": "select exists(select 1 from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' and c_mktsegment = 'BUILDING') as found",
    "r09_point_count": "select count(*) as n from events where user_id = 77 and event_type = 'purchase'",
    "r14_sum_product": "select p_type, cast(sum(cast(p_size as decimal(18,0)) * cast(p_retailprice as decimal(18,2))) as double) as v from part group by p_type",
    "r16_most_orders": "select c_custkey, c_name, count(*) as n from customer join orders on o_custkey = c_custkey group by c_custkey, c_name order by n desc, c_custkey limit 10",
    "r18_value_by_month": "select c_custkey, cast(month(o_orderdate) as bigint) as m, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as v from customer join orders on o_custkey = c_custkey where c_custkey < 50 group by c_custkey, month(o_orderdate)",
    "r19_out_of_stock": "select p_partkey, p_name from part join lineitem on l_partkey = p_partkey where not exists (select 1 from supplier where s_suppkey = l_suppkey and s_acctbal < 0) group by p_partkey, p_name, p_size having sum(l_quantity) < p_size * 10",
    "r22_volume_sets": "select r_name, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by grouping sets ((r_name, n_name), (r_name), ())",
    "r24_best_parts": "select p_name, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as v from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey where o_orderstatus <> 'P' group by p_name order by v desc, p_name limit 10",
    "r26_average_order": "select round(sum(l_extendedprice) / count(distinct l_orderkey), 4) as v from lineitem",
}.items():
    Q.same(_name, _sql)

Q.sql("r28_age_groups", "select count(*) filter (where add_months(d, 12 * 18) <= date '2012-06-15') as a18, count(*) filter (where add_months(d, 12 * 16) <= date '2012-06-15' and add_months(d, 12 * 18) > date '2012-06-15') as a16 from (select cast(o_orderdate as date) as d from orders) o", "select count(*) filter (where d + interval 18 year <= date '2012-06-15') as a18, count(*) filter (where d + interval 16 year <= date '2012-06-15' and d + interval 18 year > date '2012-06-15') as a16 from (select cast(o_orderdate as date) as d from orders) o")


@Q.frame("w18_minute_key", "select user_id, extract(minute from ts) as m, event_type, count(*) as n from events group by 1, 2, 3 order by n desc, user_id, m, event_type limit 10")
def _minute(_, load):
    e = load("events").groupBy("user_id", extract("minute", "ts").alias("m"), "event_type").agg(F.count("*").alias("n"))
    return e.orderBy(F.desc("n"), "user_id", "m", "event_type").limit(10)


@Q.frame("w28_regexp_having", r"select regexp_replace(p_name, '^(\w+)\W.*$', '\1') as k, round(avg(length(p_name)), 6) as l, count(*) as c, min(p_name) as m from part group by 1 having count(*) > 3")
def _regexp(_, load):
    k = replace_first("p_name", r"^(\w+)\W.*$", r"\1").alias("k")
    return load("part").groupBy(k).agg(F.round(F.avg(F.length("p_name")), 6).alias("l"), F.count("*").alias("c"), F.min("p_name").alias("m")).filter("c > 3")


@Q.frame("w42_minute_series", "select date_trunc('minute', ts) as m, count(*) as v from events where ts >= timestamp '2024-01-14 00:00:00' and ts < timestamp '2024-01-16 00:00:00' group by 1 order by m limit 10 offset 100")
def _series(_, load):
    day = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")
    e = load("events").filter((F.col("ts") >= day(14)) & (F.col("ts") < day(16)))
    return e.groupBy(date_trunc("minute", "ts").alias("m")).agg(F.count("*").alias("v")).orderBy("m").offset(100).limit(10)


@Q.frame("r00_hourly_stats", """with h as (select date_trunc('hour', ts) as h, props ->> '$.k' as k, count(*) as n from events group by 1, 2)
  select h, k, n, round(avg(n) over (partition by k order by h rows between 3 preceding and current row), 6) as a from h""")
def _hourly(_, load):
    return hourly(load("events"))


def hourly(events):
    from pyspark.sql import Window

    h = events.groupBy(date_trunc("hour", "ts").alias("h"), json_text("props", "k").alias("k")).agg(F.count("*").alias("n"))
    return h.withColumn("a", F.round(F.avg("n").over(Window.partitionBy("k").orderBy("h").rowsBetween(-3, 0)), 6))


@Q.frame("r13_filter_by_month", "select date_trunc('month', ts) as m, round(avg(value) filter (where event_type = 'click'), 6) as a, round(avg(value) filter (where event_type <> 'click'), 6) as b from events group by 1")
def _months(_, load):
    click = F.col("event_type") == "click"
    e = load("events").groupBy(date_trunc("month", "ts").alias("m"))
    return e.agg(F.round(F.avg(F.when(click, F.col("value"))), 6).alias("a"), F.round(F.avg(F.when(~click, F.col("value"))), 6).alias("b"))


@Q.frame("n00_json_group", "select props ->> '$.k' as k, count(*) as n from events group by 1")
def _json_group(_, load):
    return load("events").groupBy(json_text("props", "k").alias("k")).agg(F.count("*").alias("n"))


@Q.frame("n01_json_distinct", "select props ->> '$.k' as k, count(*) as n, count(distinct user_id) as u from events where event_type = 'click' group by 1")
def _json_distinct(_, load):
    return load("events").filter("event_type = 'click'").groupBy(json_text("props", "k").alias("k")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))


@Q.frame("n02_json_hour", "select event_type, extract(hour from make_timestamp(try_cast(props ->> '$.k' as bigint) * 3600000000)) as h, count(*) as n from events where event_type in ('click', 'error') group by 1, 2")
def _json_hour(_, load):
    t = micros_to_timestamp(json_text("props", "k").try_cast("long") * 3_600_000_000)
    return load("events").filter(F.col("event_type").isin("click", "error")).groupBy("event_type", extract("hour", t).alias("h")).agg(F.count("*").alias("n"))


@Q.frame("n03_json_first", "select user_id, min(make_timestamp(event_id * 1000000)) as first_at from events where props ->> '$.k' is not null group by 1 order by first_at, user_id limit 3")
def _json_first(_, load):
    e = load("events").filter(json_text("props", "k").isNotNull()).groupBy("user_id").agg(F.min("event_id").alias("e"))
    return e.select("user_id", micros_to_timestamp(F.col("e") * 1_000_000).alias("first_at")).orderBy("first_at", "user_id").limit(3)


@Q.frame("n04_json_span", "select user_id, max(event_id) - min(event_id) as span from events where props ->> '$.k' is not null group by 1 order by span desc, user_id limit 3")
def _json_span(_, load):
    e = load("events").filter(json_text("props", "k").isNotNull()).groupBy("user_id").agg((F.max("event_id") - F.min("event_id")).alias("span"))
    return e.orderBy(F.desc("span"), "user_id").limit(3)
