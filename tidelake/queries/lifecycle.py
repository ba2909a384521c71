"""The life of a sliced table, seen through queries whose answers SQL can give on the plain table."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.catalog import Files
from tidelake.functions.json import leaves, resolve
from tidelake.queries.base import Registry
from tidelake.storage import Store

Q = Registry()
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
_JSON = [{"src": "props", "path": ["k"], "name": "props_k", "type": "bigint"}]


_ROOTS: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    """The tables of these queries go when the driver ends."""
    while _ROOTS:
        spark, root = _ROOTS.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            Files(spark, root).delete(root)


def _root(spark: SparkSession) -> str:
    """A folder all executors share, or one of this machine where Spark is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = "file://" + tempfile.gettempdir()
    root = f"{shared.rstrip('/')}/tidelake-tables-{uuid.uuid4().hex}"
    _ROOTS.append((spark, root))
    return root


def sealed_events(spark: SparkSession, events: DataFrame, seal_until: datetime = datetime(2024, 1, 21)) -> Store:
    """events in slices of five days: those that ended by ``seal_until`` sealed, later ones open, rows before 2024-01-03 in the default slice."""
    store = Store(spark, _root(spark))
    store.create_table("events", SCHEMA, "ts", "5 days", now=datetime(2024, 1, 10))
    store.set_layout("events", ["event_type"], ["ts", "event_id"], 2_000, _JSON)
    cut = F.col("ts") < F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    store.append("events", events.filter(~cut), make_slices=True)
    table = store.catalog.load("events")
    for s in [s for s in table.ranged() if s.start < 1_704_240_000_000_000 and not s.paths]:
        table.slices.remove(s)
    store.catalog.save(table)
    store.append("events", events.filter(cut))
    store.seal_closed("events", seal_until)
    return store


@Q.frame("a06_mixed_scan", "select event_id, user_id, event_type, value from events where value > 20")
def _mixed(spark, load):
    return sealed_events(spark, load("events")).read("events").filter("value > 20").select("event_id", "user_id", "event_type", "value")


@Q.frame("r01_pruned_range", "select event_id, value from events where ts >= timestamp '2024-01-08 00:00:00' and ts < timestamp '2024-01-12 12:00:00'")
def _pruned(spark, load):
    return sealed_events(spark, load("events")).read("events", datetime(2024, 1, 8), datetime(2024, 1, 12, 12)).select("event_id", "value")


@Q.frame("a14_sealed_group", "select event_type, count(*) as n, count(distinct user_id) as u from events group by event_type")
def _sealed(spark, load):
    return sealed_events(spark, load("events"), datetime(2025, 1, 1)).read("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))


@Q.frame("a16_unsealed", "select count(*) as n, cast(sum(event_id) as bigint) as s from events")
def _unsealed(spark, load):
    store = sealed_events(spark, load("events"))
    for s in store.catalog.load("events").slices:
        if s.sealed:
            store.unseal("events", s.name)
    return store.read("events").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))


@Q.frame("r08_stats_aggregate", "select count(*) as n_rows, count(user_id) as n, min(user_id) as \"min\", max(user_id) as \"max\", cast(sum(user_id) as bigint) as \"sum\" from events where ts >= timestamp '2024-01-04 00:00:00' and ts < timestamp '2024-01-28 00:00:00'")
def _stats(spark, load):
    got = sealed_events(spark, load("events")).aggregate("events", "user_id", datetime(2024, 1, 4), datetime(2024, 1, 28))
    return got.withColumn("sum", F.col("sum").cast("long"))


@Q.frame("d02_stats_time", "select count(*) as n_rows, count(ts) as n, min(ts) as \"min\", max(ts) as \"max\" from events")
def _time(spark, load):
    return sealed_events(spark, load("events")).aggregate("events", "ts").drop("sum")


@Q.frame("r16_newest", "select event_id, ts, value from events order by ts desc, event_id limit 20")
def _newest(spark, load):
    return sealed_events(spark, load("events"), datetime(2025, 1, 1)).newest("events", 20).select("event_id", "ts", "value")


@Q.frame("j09_json_column", "select try_cast(props ->> '$.k' as bigint) as k, count(*) as n from events group by 1")
def _json(spark, load):
    events = load("events")
    store = sealed_events(spark, events.filter("ts >= timestamp_ntz'2024-01-03 00:00:00'"), datetime(2025, 1, 1))
    rest = events.filter("ts < timestamp_ntz'2024-01-03 00:00:00'").select(F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    spec = leaves(_JSON, events.columns)
    own = store.read("events", json_columns=True).select(resolve(spec, "props", "k").alias("k"))
    return own.unionByName(rest).groupBy("k").agg(F.count("*").alias("n"))


@Q.frame("n05_drained", "select date_trunc('day', ts) as d, count(*) as n from events group by 1")
def _drained(spark, load):
    from tidelake.functions import date_trunc

    store = sealed_events(spark, load("events"))
    store.drain_default("events")
    return store.read("events").groupBy(date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n"))


@Q.frame("n06_retention", "select count(*) as n, min(event_id) as lo from events where ts >= timestamp '2024-01-13 00:00:00'")
def _retention(spark, load):
    store = sealed_events(spark, load("events"))
    store.drain_default("events")
    store.set_retention("events", "17 days")
    store.maintain("events", datetime(2024, 1, 31))
    # whole slices go: what is left of the slice at the edge is cut by the query
    return store.read("events", datetime(2024, 1, 13)).agg(F.count("*").alias("n"), F.min("event_id").alias("lo"))


@Q.frame("n14_added_column", "select event_type, 'none' as tag, count(*) as n from events group by event_type")
def _added(spark, load):
    store = sealed_events(spark, load("events"))
    store.add_column("events", "tag", "string", "'none'")
    return store.read("events").groupBy("event_type", "tag").agg(F.count("*").alias("n"))


@Q.frame("n13_dropped_column", "select event_id, ts, user_id, event_type, value from events where user_id = 5")
def _dropped(spark, load):
    store = sealed_events(spark, load("events"))
    store.set_layout("events", ["event_type"], ["ts", "event_id"], 2_000)
    store.drop_column("events", "props")
    return store.read("events").filter("user_id = 5")


_SLICES = "select time_bucket(interval 5 days, ts, timestamp '2024-01-03 00:00:00') as range_start, count(*) as n from events where ts >= timestamp '2024-01-03 00:00:00' group by 1"


@Q.frame("n03_slice_info", f"select range_start, range_start + interval 5 days as range_end, range_start + interval 5 days <= timestamp '2024-01-21 00:00:00' as sealed from ({_SLICES})")
def _info(spark, load):
    got = sealed_events(spark, load("events")).slice_info("events").filter("range_end > timestamp_ntz'2024-01-03 00:00:00'")
    return got.select("range_start", "range_end", "sealed")


@Q.frame("n09_compression_stats", f"select range_start, n as rows, true as packed from ({_SLICES}) where range_start + interval 5 days <= timestamp '2024-01-21 00:00:00'")
def _compression(spark, load):
    store = sealed_events(spark, load("events"))
    got = store.compression_stats("events").filter("sealed").join(store.slice_info("events").select("name", "range_start"), "name")
    return got.select("range_start", "rows", (F.col("bytes") > 0).alias("packed"))


def text_loaded(spark: SparkSession, events: DataFrame) -> DataFrame:
    """All events, written as text and loaded."""
    from tidelake.sources import load_text

    store = Store(spark, _root(spark))
    store.create_table("events", SCHEMA, "ts", now=datetime(2024, 1, 10))
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in events.columns])
    events.select(line).write.text(f"{store.catalog.root}/in")
    load_text(store, "events", f"{store.catalog.root}/in/part-*")
    return store.read("events")


def csv_loaded(spark: SparkSession, events: DataFrame) -> DataFrame:
    """All events, written as CSV and loaded."""
    from tidelake.sources import load_csv

    store = Store(spark, _root(spark))
    store.create_table("events", SCHEMA, "ts", now=datetime(2024, 1, 10))
    lines = events.withColumn("ts", F.col("ts").cast("string"))
    lines.write.option("header", True).option("escape", '"').csv(f"{store.catalog.root}/in")
    load_csv(store, "events", f"{store.catalog.root}/in/part-*", header=True)
    return store.read("events")


def parquet_loaded(spark: SparkSession, events: DataFrame) -> DataFrame:
    """All events, written as Parquet and loaded."""
    from tidelake.functions.time import micros
    from tidelake.sources import load_parquet

    store = Store(spark, _root(spark))
    store.create_table("events", SCHEMA, "ts", now=datetime(2024, 1, 10))
    # other order and case of columns, one too many, times as integers
    some = events.select(F.col("props"), F.col("value").alias("VALUE"), "event_type", "user_id", micros("ts").alias("ts"), "event_id", F.lit(1).alias("extra"))
    some.write.parquet(f"{store.catalog.root}/in")
    load_parquet(store, "events", f"{store.catalog.root}/in/part-*")
    return store.read("events")


@Q.frame("a07_text_load", "select event_id, ts, user_id, event_type, value, props from events")
def _text(spark, load):
    return text_loaded(spark, load("events"))


@Q.frame("a08_csv_load", "select event_id, ts, user_id, event_type, value, props from events")
def _csv(spark, load):
    return csv_loaded(spark, load("events"))


@Q.frame("a09_parquet_load", "select event_id, ts, user_id, event_type, value, props from events")
def _parquet(spark, load):
    return parquet_loaded(spark, load("events"))
