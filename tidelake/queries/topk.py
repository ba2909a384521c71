"""Ordering and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.operators import asc, desc, distinct_on, limit_by_scalar, top_k_per_group, top_n, with_ties
from tidelake.queries.base import Registry

Q = Registry()
_E = "select event_id, ts, user_id, event_type, value from events "
_COLS = ["event_id", "ts", "user_id", "event_type", "value"]

Q.same("g01_top_time", _E + "where user_id < 500 order by ts desc, event_id limit 10")
Q.same("g01_top_number", _E + "order by value desc nulls last, event_id limit 25")
Q.same("g02_top_text", "select p_partkey, p_name from part order by p_name, p_partkey limit 20")
Q.same("g02_top_text_desc", "select p_partkey, p_name from part where p_size > 10 order by p_name desc, p_partkey limit 20")
Q.same("g03_limit_offset", _E + "order by ts, event_id limit 10 offset 990")
Q.same("g04_grouped_top", "select user_id, count(*) as n from events group by user_id order by n desc, user_id limit 10")
Q.same("g04_grouped_top_offset", "select l_partkey, cast(sum(l_quantity) as double) as q from lineitem group by l_partkey order by q desc, l_partkey limit 10 offset 5")
Q.sql("g05_span_sort", "select user_id, (unix_micros(max(cast(ts as timestamp))) - unix_micros(min(cast(ts as timestamp)))) div 1000 as span from events group by user_id order by span desc, user_id limit 10", "select user_id, cast((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 as bigint) as span from events group by user_id order by span desc, user_id limit 10")
Q.sql("g06_bare_limit", "select count(*) as groups, bool_and(n = m) as exact from (select user_id, count(*) as n from events group by user_id limit 10) a join (select user_id, count(*) as m from events group by user_id) b using (user_id)", "select count(*) as groups, bool_and(n = m) as exact from (select user_id, count(*) as n from events group by user_id limit 10) a join (select user_id, count(*) as m from events group by user_id) b using (user_id)")
Q.same("g07_sorted_by_time", _E + "where ts < timestamp '2024-01-02 00:00:00' order by ts, event_id")
Q.same("g09_limit_zero", _E + "order by event_id limit 0")
Q.same("g09_offset_past_end", _E + "order by event_id limit 5 offset 100000000")
Q.same("g11_order_expression", "select event_id, lower(event_type) as t, user_id % 17 as k from events order by user_id % 17 desc, t, event_id limit 30")
Q.same("g11_order_ordinal", "select event_type, count(*) as n from events group by 1 order by 2 desc, 1 limit 3")
Q.same("g14_top_reordered", "select * from (" + _E + "order by value desc, event_id limit 50) t order by event_id")

for _name, _order in {"asc_nulls_last": "asc nulls last", "asc_nulls_first": "asc nulls first", "desc_nulls_last": "desc nulls last", "desc_nulls_first": "desc nulls first"}.items():
    Q.same(f"g08_{_name}", f"select event_id, nullif(event_type, 'click') as k from events order by k {_order}, event_id limit 40")


@Q.frame("g08_host_order", "select event_id, nullif(event_type, 'click') as k, nullif(user_id, 7) as u from events order by k desc nulls first, u asc nulls last, event_id limit 60")
def _host(_, load):
    e = load("events").select("event_id", F.nullif(F.col("event_type"), F.lit("click")).alias("k"), F.nullif(F.col("user_id"), F.lit(7)).alias("u"))
    return top_n(e, 60, desc("k"), asc("u"), asc("event_id"))


@Q.frame("g10_with_ties", "select l_orderkey, l_linenumber, l_quantity from (select *, rank() over (order by l_quantity desc) as r from lineitem) where r <= 25")
def _ties(_, load):
    return with_ties(load("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 25, {"l_quantity": False})


@Q.frame("g12_limit_scalar", _E + "order by event_id limit (select 17)")
def _scalar(spark, load):
    return limit_by_scalar(load("events").select(*_COLS).orderBy("event_id"), spark.sql("select 17"))


@Q.frame("g13_distinct_on", "select distinct on (user_id) user_id, ts, event_id, event_type from events order by user_id, ts desc, event_id")
def _distinct(_, load):
    return distinct_on(load("events"), ["user_id"], desc("ts"), asc("event_id")).select("user_id", "ts", "event_id", "event_type")


@Q.frame("e01_top_k_per_group", "select event_type, event_id, value from (select *, row_number() over (partition by event_type order by value desc nulls last, event_id) as rn from events) where rn <= 3")
def _per_group(_, load):
    return top_k_per_group(load("events"), ["event_type"], 3, F.col("value").desc_nulls_last(), asc("event_id")).select("event_type", "event_id", "value")
