"""Structured Streaming: appending to sliced tables with maintenance, and windowed aggregation."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelake.functions.time import interval_micros
from tidelake.storage import Store

#: 2000-01-01 00:00 in microseconds since 1970: buckets count from there.
_ORIGIN = 946_684_800_000_000


def stream_into(store: Store, name: str, stream: DataFrame, checkpoint: str, now: Callable[[], datetime] | None = None, once: bool = True) -> StreamingQuery:
    """Append every batch of a stream to a table and run one round of maintenance after it.

    Rows later than their sealed slice are kept in the default slice.  Batches that were
    already applied (by their number, kept in the catalog's folder) are skipped.
    """
    done = f"{store.catalog.root}/{name}.batch"

    def apply(batch: DataFrame, number: int) -> None:
        files = store.catalog.files
        if files.exists(done) and int(files.read(done)) >= number:
            return
        table = store.catalog.load(name)
        us = store._us(table)
        start = us - F.pmod(us, F.lit(table.width).cast("long"))
        sealed = [s.start for s in table.slices if s.sealed]
        late = start.isin(sealed) if sealed else F.lit(False)
        batch.persist()
        store.append(name, batch.filter(~F.coalesce(late, F.lit(False))), make_slices=True)
        if sealed:
            table = store.catalog.load(name)
            rest = store._fitting(table, batch.filter(late))
            if not rest.isEmpty():
                out = f"{table.root}/late-{number}"
                rest.write.mode("overwrite").parquet(out)
                table.default.paths.append(out)
                table.default.columns = table.default.columns or rest.columns
                store.catalog.save(table)
        batch.unpersist()
        files.write(done, str(number))
        if now:
            store.maintain(name, now())

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


def tumbling(stream: DataFrame, ts: str, width: str, keys: list[str], *aggs, late: str = "0 seconds") -> DataFrame:
    """Aggregates by buckets that count from 2000-01-01, as ``time_bucket`` does; streams and tables alike."""
    shift = _ORIGIN % interval_micros(width)
    w = F.window(ts, width, width, f"{shift} microseconds") if shift else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*aggs).withColumn("bucket", F.col("w.start")).drop("w")


def sliding(stream: DataFrame, ts: str, width: str, slide: str, keys: list[str], *aggs, late: str = "0 seconds") -> DataFrame:
    w = F.window(ts, width, slide)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "*").drop("w")


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], *aggs, late: str = "0 seconds") -> DataFrame:
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "*").drop("w")
