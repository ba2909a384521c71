"""Every core query against its SQL in DuckDB, on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

from tidelake import queries as core
from tidelake.queries.base import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in found:
        row = []
        for i in order:
            v = r[i]
            if isinstance(v, float):
                v = "nan" if math.isnan(v) else f"{v:.9g}"
            row.append(str(v).replace(" 00:00:00", ""))
        out.append(tuple(row))
    return sorted(columns), sorted(out)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_same_rows(spark, duck, name):
    df = core.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = core.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql)
    assert got == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["c11_lateral_top1", "c12_left_lateral"])
def test_lateral_order(spark, tmp_path, name):
    """Nulls, ties and keys in many partitions; the rows of a key are ranked by the whole order after the last shuffle."""
    con = duckdb.connect()
    con.sql(f"""copy (select k::bigint as c_custkey from (values (1), (1), (2), (3), (4), (5), (6), (null), (8)) t(k)) to '{tmp_path}/customer.parquet'""")
    con.sql(f"""copy (select o::bigint as o_orderkey, c::bigint as o_custkey, s as o_orderstatus, p::double as o_totalprice from (values (2, 1, 'P', '5'), (1, 1, 'P', '5'), (3, 1, 'P', null),
      (4, 2, 'P', null), (5, 2, 'P', '1'), (6, 3, 'P', null), (null, 3, 'P', null), (null, 4, 'P', '7'), (9, 4, 'P', '7'), (10, null, 'P', '3'), (11, 5, 'P', 'nan'), (12, 5, 'F', 'inf'),
      (15, 6, 'P', '0'), (14, 6, 'P', '-0'), (20, 8, null, '9'), (21, 8, 'F', '1')) t(o, c, s, p)) to '{tmp_path}/orders.parquet'""")
    for t in ("customer", "orders"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got, want = core.queries()[name](spark, f"file://{tmp_path}"), con.sql(core.oracle_sql()[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(o_custkey#\w+, o_totalprice#\w+ DESC NULLS LAST, o_orderkey#\w+ ASC NULLS LAST", plan)
    assert "rangepartitioning" not in plan


def test_pairing_without_pairs(spark, tmp_path):
    """Busy users, equal times and nulls; as a join of clicks and purchases it would make 10^10 pairs."""
    con = duckdb.connect()
    con.sql(f"""copy (select nullif(i // 2 % 3, 2) as user_id, if(i % 2 = 0, 'click', 'purchase') as event_type,
      if(i % 97 = 0, null, timestamp '2024-01-01' + to_microseconds(i // 60000 * 3000000000 + i * 7919 % 60000 // 7 * 350001)) as ts from range(600000) t(i)) to '{tmp_path}/events.parquet'""")
    got = core.queries()["c16_pairing"](spark, f"file://{tmp_path}")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    e = f"select *, max(ts) filter (where event_type = 'click') over (partition by user_id order by ts range between unbounded preceding and interval 1 microsecond preceding) as c from '{tmp_path}/events.parquet'"
    want = con.sql(f"select user_id, min(cast((epoch_us(ts) - epoch_us(c)) // 1000000 as bigint)) as wait from ({e}) where event_type = 'purchase' and c < ts and user_id is not null group by user_id")
    assert len(want.fetchall()) == 2
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
