"""Window functions and set operations."""

from __future__ import annotations

from tidelake.queries.base import Registry

Q = Registry()
_W = "partition by user_id order by ts, event_id"

Q.same("e02_moving_avg", "select h, n, round(avg(n) over (order by h rows between 3 preceding and current row), 6) as a from (select cast(ts as date) as h, count(*) as n from events group by cast(ts as date)) t")
Q.same("e03_running_sum", f"select event_id, cast(sum(user_id * event_id) over ({_W} rows unbounded preceding) as bigint) as s from events")
Q.same("e04_count_over", "select event_id, count(*) over (partition by event_type, user_id) as n from events")
Q.same("e05_ranks", "select event_id, cast(rank() over (partition by event_type order by user_id) as bigint) as r, cast(dense_rank() over (partition by event_type order by user_id) as bigint) as d from events")
Q.same("e05_ntile", f"select event_id, cast(ntile(4) over ({_W}) as bigint) as q from events")
Q.same("e05_lag_lead", f"select event_id, lag(event_id, 1, -1) over ({_W}) as p, lead(event_id, 2, -1) over ({_W}) as x from events")
Q.same("e05_first_nth", f"select event_id, first_value(event_id) over ({_W}) as f, last_value(event_id) over ({_W} rows between unbounded preceding and unbounded following) as l, coalesce(nth_value(event_id, 2) over ({_W} rows between unbounded preceding and unbounded following), -1) as x from events")
Q.same("e05_range_frame", "select event_id, count(*) over (partition by event_type order by user_id range between 5 preceding and 5 following) as n from events")
Q.same("f01_union_all", "select user_id from events where event_type = 'click' union all select user_id from events where event_type = 'error'")
Q.same("f02_intersect", "select user_id from events where event_type = 'click' intersect select user_id from events where event_type = 'error'")
Q.same("f03_except", "select user_id from events except select user_id from events where event_type = 'signup'")
Q.same("f03_except_all", "select user_id % 7 as k from events where event_type = 'click' except all select user_id % 7 from events where event_type = 'error'")
Q.same("f04_union", "select user_id % 50 as k from events where event_type = 'click' union select user_id % 60 from events where event_type = 'error'")
