"""Joins and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions.time import micros
from tidelake.operators import asc, asof_join, lateral_top_k, not_in, pair_counts, range_join
from tidelake.queries.base import Registry

Q = Registry()

Q.same("c01_star_join", """select n_name, r_name, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as q from lineitem
  join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where o_orderdate >= timestamp '1995-01-01 00:00:00' group by n_name, r_name""")
Q.same("c01_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_acctbal > 9000")
Q.same("c02_left_agg", "select c_custkey, count(o_orderkey) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as s from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by c_custkey")
Q.same("c03_right_extra_on", "select coalesce(o_orderkey, -1) as o_orderkey, c_custkey from (select * from orders where o_orderkey < 300) o right join customer on o_custkey = c_custkey and o_totalprice > 50000 and c_acctbal > 0")
Q.same("c04_full_outer", "select coalesce(a.k, -1) as ka, coalesce(b.k, -1) as kb, coalesce(a.n, -1) as na, coalesce(b.n, -1) as nb from (select user_id as k, count(*) as n from events where event_type = 'click' and user_id % 3 <> 0 group by user_id) a full join (select user_id as k, count(*) as n from events where event_type = 'error' and user_id % 2 <> 0 group by user_id) b on a.k = b.k")
Q.same("c05_exists", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
Q.same("c05_in_subquery", "select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity = 50)")
Q.same("c06_not_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
Q.same("c08_nested_exists", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R'))")
Q.same("c09_self_theta", "select a.event_id as a, b.event_id as b from events a join events b on a.user_id = b.user_id and b.ts > a.ts where a.event_type = 'signup' and b.event_type = 'purchase'")
Q.same("c13_null_safe", "select a.k as ka, count(*) as n from (select nullif(event_type, 'click') as k from events where user_id < 40) a join (select distinct nullif(event_type, 'click') as k from events) b on a.k is not distinct from b.k group by a.k")
Q.same("c13_plain_equal", "select a.k as ka, count(*) as n from (select nullif(event_type, 'click') as k from events where user_id < 40) a join (select distinct nullif(event_type, 'click') as k from events) b on a.k = b.k group by a.k")
Q.same("c14_multi_column", "select count(*) as n from lineitem a join (select l_orderkey, l_linenumber, max(l_quantity) as q from lineitem group by l_orderkey, l_linenumber) b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber and a.l_quantity = b.q")
Q.same("c14_grouped_subquery", "select o_orderkey, o_totalprice, t.n from orders join (select l_orderkey, count(*) as n from lineitem group by l_orderkey having count(*) > 5) t on l_orderkey = o_orderkey")
Q.same("c15_values", "select event_type, v.w, count(*) as n from events join (values ('click', 1), ('purchase', 5)) as v(kind, w) on event_type = v.kind group by event_type, v.w")
Q.same("c17_scalar_count", "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n from customer")
Q.same("c17_scalar_max", "select n_nationkey, (select max(c_acctbal) from customer where c_nationkey = n_nationkey) as m from nation")
Q.same("c17_scalar_avg", "select o_orderkey from orders o where o_totalprice > (select avg(o_totalprice) * 1.5 from orders i where i.o_custkey = o.o_custkey)")
Q.same("c19_nullable_dimension", "select coalesce(n.nm, 'none') as nm, count(*) as k from customer left join (select n_nationkey, nullif(n_name, 'FRANCE') as nm from nation where n_nationkey < 15) n on c_nationkey = n.n_nationkey group by coalesce(n.nm, 'none')")
Q.same("h01_with", "with t as (select user_id, count(*) as n from events group by user_id), u as (select max(n) as m from t) select t.user_id, t.n from t join u on t.n = u.m")
Q.same("h02_select_exists", "select exists(select 1 from events where event_type = 'purchase' and value > 99) as found")
Q.sql("h05_series", "select d.day, count(event_id) as n from (select explode(sequence(date '2024-01-01', date '2024-01-31', interval 1 day)) as day) d left join events on cast(ts as date) = d.day group by d.day", "select cast(d.day as date) as day, count(event_id) as n from (select unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 1 day)) as day) d left join events on cast(ts as date) = cast(d.day as date) group by d.day")


@Q.frame("h03_parameters", "select event_id from events where user_id = 42 and event_type = 'click'")
def _prepared(spark, load):
    load("events").createOrReplaceTempView("events")
    return spark.sql("select event_id from events where user_id = :u and event_type = :t", args={"u": 42, "t": "click"})


@Q.frame("c10_range_join", """select a.event_id as a, b.event_id as b from events a join events b on a.user_id = b.user_id
  and b.ts >= a.ts and b.ts < a.ts + interval 30 hour where a.event_type = 'signup' and b.event_type = 'click'""")
def _range(_, load):
    e = load("events")
    start = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("lo"), (F.col("ts") + F.expr("interval 30 hours")).alias("hi"))
    points = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("b"), "ts")
    return range_join(points, start, ["user_id"], "ts", "lo", "hi", width="30 hours").select("a", "b")


@Q.frame("c18_asof_join", """select p.event_id, coalesce(c.event_id, -1) as click_id from (select * from events where event_type = 'purchase') p
  asof left join (select * from events where event_type = 'click') c on p.user_id = c.user_id and p.ts >= c.ts""")
def _asof(_, load):
    e = load("events")
    p = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    c = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("cts"))
    return asof_join(p, c, ["user_id"], "ts", "cts", "").select("event_id", F.coalesce("click_id", F.lit(-1).cast("long")).alias("click_id"))


@Q.frame("c11_lateral_top1", "select c_custkey, t.o_orderkey from customer cross join lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 1) t")
def _lateral(_, load):
    return _dearest(load("customer"), load("orders"), "inner")


@Q.frame("c12_left_lateral", "select c_custkey, coalesce(t.o_orderkey, -1) as o_orderkey from customer left join lateral (select o_orderkey from orders where o_custkey = c_custkey and o_orderstatus = 'P' order by o_totalprice desc, o_orderkey limit 1) t on true")
def _left_lateral(_, load):
    best = _dearest(load("customer"), load("orders").filter("o_orderstatus = 'P'"), "left")
    return best.select("c_custkey", F.coalesce("o_orderkey", F.lit(-1).cast("long")).alias("o_orderkey"))


def _dearest(customer, orders, how):
    o = orders.select("o_custkey", "o_orderkey", "o_totalprice")
    order = F.col("o_totalprice").desc_nulls_last(), asc("o_orderkey")
    return lateral_top_k(customer.select("c_custkey"), o, "c_custkey", "o_custkey", 1, *order, how=how).select("c_custkey", "o_orderkey")


@Q.frame("c15_using", "select k, count(*) as n from (select user_id % 10 as k from events where event_type = 'error') a join (select user_id % 10 as k from events where event_type = 'signup') b using (k) group by k")
def _using(_, load):
    e = load("events").withColumn("k", F.expr("user_id % 10"))
    return pair_counts(e.filter("event_type = 'error'"), e.filter("event_type = 'signup'"), ["k"], "n")


@Q.frame("c16_pairing", "select a.user_id, min(cast((epoch_us(b.ts) - epoch_us(a.ts)) // 1000000 as bigint)) as wait from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and b.ts > a.ts group by a.user_id")
def _pairing(_, load):
    e = load("events").filter("user_id is not null and ts is not null")
    b = e.filter("event_type = 'purchase'").select("user_id", "ts")
    a = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click"))
    last = asof_join(b, a, ["user_id"], "ts", "click", "", strict=True).filter("click is not null")  # the shortest wait is since the latest click
    return last.groupBy("user_id").agg(F.min(micros("ts") - micros("click")).alias("wait")).withColumn("wait", F.expr("wait div 1000000"))


@Q.frame("c07_not_in", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def _not_in(_, load):
    return not_in(load("part"), "p_partkey", load("lineitem").filter("l_quantity > 45"), "l_partkey").select("p_partkey")


@Q.frame("c07_not_in_null", "select p_partkey from part where p_partkey not in (select nullif(l_partkey, 1) from lineitem)")
def _not_in_null(_, load):
    keys = load("lineitem").select(F.nullif("l_partkey", F.lit(1)).alias("l_partkey"))
    return not_in(load("part"), "p_partkey", keys, "l_partkey").select("p_partkey")
