"""Filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions import date_trunc, similar_to
from tidelake.queries.base import Registry

Q = Registry()
_E = "select event_id, user_id, event_type, value from events where "

for _name, _where in {
    "b01_eq_int": "user_id = 42",
    "b01_ne_text": "event_type <> 'click'",
    "b01_lt_double": "value < 10.5",
    "b01_le_ge": "value >= 20 and value <= 30",
    "b01_timestamp_gt": "ts > timestamp '2024-01-20 00:00:00'",
    "b02_const_left": "100 > user_id",
    "b03_in_numbers": "user_id in (1, 2, 3, 5, 8, 13)",
    "b03_in_text": "event_type in ('click', 'purchase')",
    "b04_text_eq": "event_type = 'signup'",
    "b04_text_empty": "event_type = ''",
    "b04_text_not_empty": "event_type <> ''",
    "b05_like_contains": "event_type like '%rch%'",
    "b05_like_prefix": "event_type like 'p%'",
    "b05_like_suffix": "event_type like '%up'",
    "b05_like_general": "event_type like '_l%k'",
    "b05_not_like": "event_type not like '%c%'",
    "b07_ilike": "event_type ilike 'CLI%'",
    "b10_between": "value between 5 and 15",
    "b10_not_between": "value not between 1 and 99",
    "b10_between_time": "ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-06 12:00:00'",
    "b11_is_null": "props is null",
    "b11_is_not_null": "props is not null",
    "b12_is_true": "(value > 50) is true",
    "b12_is_not_true": "(value > 50) is not true",
    "b12_is_not_false": "(nullif(value, value) > 50) is not false",
    "b13_is_distinct": "nullif(event_type, 'click') is distinct from 'purchase'",
    "b13_is_not_distinct": "nullif(event_type, 'click') is not distinct from null",
    "b14_not_in_null": "user_id not in (1, 2, null)",
    "b17_or_tree": "(event_type = 'click' and value > 50) or (event_type = 'error' and not (value > 20 or user_id < 30))",
    "b17_not_tree": "not (event_type = 'click' or not (value < 40 and user_id >= 10))",
    "b17_or_ranges": "(ts >= timestamp '2024-01-03 00:00:00' and ts < timestamp '2024-01-04 00:00:00') or (ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-11 00:00:00')",
    "b18_expr_vs_expr": "floor(value) > user_id + 3",
    "b19_cast_int": "cast(floor(value) as bigint) = 7",
    "b19_cast_date": "cast(ts as date) = date '2024-01-09'",
    "b22_residual": "value > 10 and length(event_type) * 10 < value",
}.items():
    Q.same(_name, _E + _where)

Q.sql("b06_like_escape", "select p_partkey, p_name from part where replace(p_name, ' ', '_') like '%!_%' escape '!'", "select p_partkey, p_name from part where replace(p_name, ' ', '_') like '%!_%' escape '!'")
Q.sql("b09_regex", _E + "event_type rlike '^(cl|si).*[kp]$'", _E + "regexp_matches(event_type, '^(cl|si).*[kp]$')")
Q.sql("b09_not_regex", _E + "not event_type rlike 'r{2}|u'", _E + "not regexp_matches(event_type, 'r{2}|u')")
Q.sql("b16_row_in", _E + "(user_id, event_type) in ((1L, 'click'), (2L, 'error'), (7L, 'click'))", _E + "(user_id, event_type) in ((1, 'click'), (2, 'error'), (7, 'click'))")
Q.sql("b16_row_greater", _E + "struct(user_id, event_id) > struct(900L, 500L)", _E + "(user_id, event_id) > (900, 500)")
Q.same("b21_subset_reorder", "select event_type, event_id from events")
Q.same("b21_star", "select * from nation")
Q.same("b21_expressions", "select event_id, round(value * 2 + 1, 4) as twice, concat(event_type, ':', cast(user_id as varchar(20))) as tag, user_id % 7 as week_day from events")
Q.same("b21_no_column", "select count(*) as n from lineitem")


@Q.frame("b08_similar_to", _E + "regexp_full_match(event_type, '(click|sign.*|.*or)')")
def _similar(_, load):
    return load("events").filter(similar_to("event_type", "(click|sign%|%or)")).select("event_id", "user_id", "event_type", "value")


@Q.frame("b15_any_array", _E + "user_id = any([3, 5, 7])")
def _any(_, load):
    return load("events").filter(F.col("user_id").isin(3, 5, 7)).select("event_id", "user_id", "event_type", "value")


@Q.frame("b15_all_array", _E + "event_type <> all(['click', 'error'])")
def _all(_, load):
    wanted = F.array(F.lit("click"), F.lit("error"))
    return load("events").filter(F.forall(wanted, lambda x: F.col("event_type") != x)).select("event_id", "user_id", "event_type", "value")


@Q.frame("b20_date_trunc_lt", _E + "date_trunc('day', ts) < timestamp '2024-01-03 00:00:00'")
def _trunc(_, load):
    day = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    # the plain range beside it is what the scan can use
    kept = load("events").filter((date_trunc("day", "ts") < day) & (F.col("ts") < day))
    return kept.select("event_id", "user_id", "event_type", "value")


@Q.frame("b23_late_materialisation", "select * from events where event_type = 'purchase' and value > 95")
def _late(_, load):
    return load("events").filter("event_type = 'purchase' and value > 95")
