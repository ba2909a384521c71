"""Scalar functions: numbers, text, JSON and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions import age_at_least, contains_all, date_trunc, epoch, extract_leaf, json_text, micros_to_timestamp, replace_first, seconds_between, time_bucket
from tidelake.queries.base import Registry

Q = Registry()

Q.sql("i01_integer_division", "select event_id, (user_id - 500) div 7 as q, (user_id - 500) % 7 as r from events", "select event_id, (user_id - 500) // 7 as q, (user_id - 500) % 7 as r from events")
Q.same("i02_rounding", "select event_id, abs(value - 50) as a, floor(value) as f, round(value, 1) as r from events".replace("floor(value)", "cast(floor(value) as bigint)"))
Q.same("i03_coalesce", "select event_id, coalesce(nullif(event_type, 'click'), 'none') as k from events")
Q.same("i04_case", "select event_id, case when value < 10 then 'low' when value < 90 then 'mid' else 'high' end as band, case event_type when 'click' then 1 when 'error' then 2 else 0 end as c from events")
Q.same("i05_casts", "select event_id, cast(user_id as varchar(20)) as t, cast(cast(user_id as varchar(20)) as bigint) as b, cast(value as decimal(20,2)) = value as same from events")
Q.same("i06_nan_negative_zero", "select max(x) > 1e300 as nan_is_largest, count(*) filter (where z = 0) as zeros from (select case when event_id % 2 = 0 then cast('NaN' as double) else value end as x, case when event_id % 3 = 0 then -0.0 else 0.0 end as z from events) t")
Q.same("j01_length", "select r_name, cast(length(concat(r_name, 'é☃')) as bigint) as n from region")
Q.same("j02_lower_upper", "select p_partkey, lower(p_brand) as l, upper(p_name) as u, trim(concat(' ', p_type, ' ')) as t from part")
Q.same("j03_concat_pad", "select n_nationkey, n_name || '-' || cast(n_regionkey as varchar(5)) as c, lpad(n_name, 12, '.') as p, repeat('ab', 3) as r, chr(65) as a from nation")
Q.same("j03_substring", "select p_partkey, substring(p_name, 1, 4) as s, replace(p_type, 'E', '3') as x, position('e' in p_name) as at from part".replace("position('e' in p_name)", "cast(position('e' in p_name) as bigint)"))


@Q.frame("j04_json_path", "select event_id, props ->> '$.k' as k from events")
def _path(_, load):
    return load("events").select("event_id", json_text("props", "k").alias("k"))


@Q.frame("j05_json_typed", "select event_id, try_cast(props ->> '$.k' as bigint) as k, cast(null as double) as none from events")
def _typed(_, load):
    return load("events").select("event_id", extract_leaf("props", ("k",), "bigint").alias("k"), extract_leaf("props", ("missing", "x"), "float").alias("none"))


@Q.frame("j06_json_contains", "select event_id, event_id % 2 = 0 as found from events")
def _contains(_, load):
    doc = F.when(F.col("event_id") % 2 == 0, F.lit('{"s": ["Delayed", "x", "Priority"]}')).otherwise(F.lit('{"s": ["Priority"]}'))
    return load("events").withColumn("doc", doc).select("event_id", contains_all("doc", ("s",), ["Delayed", "Priority"]).alias("found"))


@Q.frame("j08_replace_first", "select p_partkey, regexp_replace(p_name, '([aeiou])', '<\\1>') as r from part")
def _replace(_, load):
    return load("part").select("p_partkey", replace_first("p_name", "([aeiou])", r"<\1>").alias("r"))


for _name, _width, _offset in (("7d", "7 days", None), ("1d6h", "1 day", "6 hours"), ("15m", "15 minutes", None), ("90s", "90 seconds", "10 seconds")):
    _origin = f"timestamp '2000-01-01' + interval {_offset}" if _offset else "timestamp '2000-01-01'"

    @Q.frame(f"k01_time_bucket_{_name}", f"select time_bucket(interval {_width}, ts, {_origin}) as b, count(*) as n from events group by 1")
    def _bucket(_, load, width=_width, offset=_offset):
        return load("events").groupBy(time_bucket(width, "ts", offset).alias("b")).agg(F.count("*").alias("n"))


@Q.frame("k02_date_trunc_units", "select event_id, date_trunc('hour', ts) as h, date_trunc('week', ts) as w, date_trunc('month', ts) as m, date_trunc('year', ts) as y from events")
def _units(_, load):
    return load("events").select("event_id", *[date_trunc(u, "ts").alias(u[0]) for u in ("hour", "week", "month", "year")])


@Q.frame("k03_epoch_fraction", "select event_id, epoch_us(ts) / 1000000.0 as e from events")
def _epoch(_, load):
    return load("events").select("event_id", epoch("ts").alias("e"))


@Q.frame("k05_micros", "select event_id, make_timestamp(event_id * 1234567) as t from events")
def _micros(_, load):
    return load("events").select("event_id", micros_to_timestamp(F.col("event_id") * 1234567).alias("t"))


@Q.frame("k06_difference", "select event_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1000000.0 as s from events")
def _difference(_, load):
    return load("events").select("event_id", seconds_between("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("s"))


Q.same("k07_interval_arithmetic", "select event_id, ts + interval '30' hour as later, ts - interval '2' day as sooner from events")


@Q.frame("k08_age", "select o_orderkey, o_orderdate + interval 18 year <= timestamp '2012-06-15' as grown from (select o_orderkey, cast(o_orderdate as date) as o_orderdate from orders)")
def _age(_, load):
    return load("orders").select("o_orderkey", age_at_least("o_orderdate", 18, "2012-06-15").alias("grown"))


Q.same("k09_dates", "select event_id, cast(ts as date) as d, cast(ts as date) = date '2024-01-05' as fifth from events")
Q.sql("k10_zone_literal", "select event_id from events where ts < cast(to_utc_timestamp(timestamp_ntz'2024-01-10 01:00:00', 'Europe/Berlin') as timestamp_ntz)", "select event_id from events where ts < timestamp '2024-01-10 00:00:00'")
Q.sql("k11_parse_time", "select event_id, cast(concat('2024-01-0', cast(event_id % 9 + 1 as string), ' 10:20:30.5') as timestamp_ntz) as t from events", "select event_id, cast('2024-01-0' || (event_id % 9 + 1) || ' 10:20:30.5' as timestamp) as t from events")
