"""Streaming forms, run to the end of their input."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tidelake.queries.base import Registry
from tidelake.queries.lifecycle import SCHEMA, _root
from tidelake.storage import Store
from tidelake.streaming import sessions, sliding, stream_into, tumbling

Q = Registry()


def _zoned(df):
    return df.withColumn("t", F.col("ts").cast("timestamp"))


@Q.frame("m01_tumbling", "select time_bucket(interval 7 days, ts, timestamp '2000-01-01') as bucket, event_type, count(*) as n from events group by 1, 2")
def _tumbling(_, load):
    got = tumbling(_zoned(load("events")), "t", "7 days", ["event_type"], F.count("*").alias("n"))
    return got.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n")


@Q.frame("m02_sliding", """select w as start, count(*) as n from (select *, unnest([time_bucket(interval 1 day, ts, timestamp '1970-01-01'),
  time_bucket(interval 1 day, ts, timestamp '1970-01-01') - interval 1 day]) as w from events) where ts >= w and ts < w + interval 2 day group by w""")
def _sliding(_, load):
    got = sliding(_zoned(load("events")), "t", "2 days", "1 day", [], F.count("*").alias("n"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@Q.frame("m03_sessions", """with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 6 hour then 0 else 1 end as fresh from events),
  s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
  select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def _sessions(_, load):
    got = sessions(_zoned(load("events")), "t", "6 hours", ["user_id"], F.count("*").alias("n"))
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@Q.frame("m04_stream_into_table", "select event_type, count(*) as n, cast(sum(event_id) as bigint) as s from events group by event_type")
def _stream(spark, load):
    store = Store(spark, _root(spark))
    store.create_table("events", SCHEMA, "ts", "5 days", now=datetime(2024, 1, 10))
    store.set_layout("events", ["event_type"], ["ts"])
    store.set_compression_policy("events", "5 days")
    folder = f"{store.catalog.root}/feed"
    load("events").write.parquet(folder)
    feed = spark.readStream.schema(SCHEMA).parquet(folder)
    stream_into(store, "events", feed, f"{store.catalog.root}/progress-{uuid.uuid4().hex}", lambda: datetime(2024, 1, 20)).awaitTermination()
    return store.read("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))
