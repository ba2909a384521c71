"""Shared pieces of the text operators: shared-folder tables, row keys, skew-proof group joins."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDERS: list[tuple[SparkSession, str]] = []
_OWN_TABLES: list[tuple[SparkSession, str]] = []
_OWN_LOCAL: list[str] = []
_SCRATCH: ContextVar[list | None] = ContextVar("scratch", default=None)

#: Slots of the filter before rows are taken out: its table has so many rows at most, whatever the data.
SLOTS = 1 << 20

#: Rows and bytes of the batches that go to Python while a table is written.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

#: A group is "large" when it holds at least this share of all rows, so there
#: can be at most 1 / LARGE_SHARE of them: that bounds what is broadcast.
LARGE_SHARE = 1.0 / 2000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset and the master is local is a folder of this machine taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _OWN_LOCAL:
        _OWN_LOCAL.append(tempfile.mkdtemp(prefix="tidelake-"))
    return f"file://{_OWN_LOCAL[0]}"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, batches that go to Python have BATCH_ROWS rows and BATCH_BYTES bytes at most."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in most}
    for k, v in most.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs a re-read, not a recomputation.
    The tables are removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidelake-{uuid.uuid4().hex}/{name}"
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    _OWN_FOLDERS.append((spark, path.rpartition("/")[0]))
    if (own := _SCRATCH.get()) is not None:
        own.append(_OWN_FOLDERS[-1])
    return spark.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``materialize``, in files by hash of ``key``: a join on it reads this side without a shuffle."""
    spark = df.sparkSession
    own = uuid.uuid4().hex
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidelake-{own}/{name}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key)
    with _small_batches(spark):
        writer.saveAsTable(f"tidelake_{name}_{own}")
    _OWN_FOLDERS.append((spark, path.rpartition("/")[0]))
    _OWN_TABLES.append((spark, f"tidelake_{name}_{own}"))
    return spark.table(f"tidelake_{name}_{own}")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that this thread materialises inside are deleted at the end, but for those written by the function it gives."""
    own: list = []
    outer = _SCRATCH.set(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        own.pop()
        return out

    try:
        yield keep
    finally:
        _SCRATCH.reset(outer)
    for x in own:
        _OWN_FOLDERS.remove(x)
        _delete(*x)


def release_tables() -> None:
    """Delete every table ``materialize`` has written in this process."""
    while _OWN_TABLES:
        spark, name = _OWN_TABLES.pop()
        try:
            spark.sql(f"drop table if exists {name}")
        except Exception:  # the session has ended, and its catalog with it
            pass
    while _OWN_FOLDERS:
        spark, path = _OWN_FOLDERS.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: only a local folder of our own can still be cleared
            pass
    for path in _OWN_LOCAL:
        import shutil

        shutil.rmtree(path, ignore_errors=True)
    _OWN_LOCAL.clear()


atexit.register(release_tables)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner-join ``groups`` (one row a ``key``; ``size``: how many of ``rows``) without a hot task.

    Groups of at least ``LARGE_SHARE`` of ``total`` rows number 1 / LARGE_SHARE at most,
    whatever the data, so they are broadcast; the others go by a shuffle in which no key
    is hot.  ``rows`` is read twice: give it materialised.
    """
    least = max(int(total * LARGE_SHARE), 50)
    large, small = groups.filter(F.col(size) >= least), groups.filter(F.col(size) < least)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti")
    return rows.join(F.broadcast(large), key).unionByName(rest.join(small.hint("shuffle_merge"), key))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(docs: DataFrame, text: str, id_col: str) -> list[Column]:
    """doc_id and h: what a row is told by, its id and a hash of its text."""
    return [quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(quoted(text).cast("string")).alias("h")]


def in_slots(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have the keys of ``wanted``, and those that surely have not; nothing is shuffled.

    The keys are hashed to SLOTS slots; the taken ones are a table of SLOTS rows at most,
    which is broadcast.  Where there are far more keys than slots, most rows may have them.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    taken = F.broadcast(wanted.select(slot.alias("_slot")).distinct())
    rows = rows.withColumn("_slot", slot)
    return rows.join(taken, "_slot", "left_semi").drop("_slot"), rows.join(taken, "_slot", "left_anti").drop("_slot")


def without_rows(docs: DataFrame, gone: DataFrame, once: DataFrame | None, text: str, id_col: str) -> DataFrame:
    """``docs`` without the rows of ``gone``, and one copy of each row of ``once`` (both doc_id, h); all columns as given.

    Rows in no slot of theirs stay where they are; only the others are shuffled and compared.
    """
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), *row_key(docs, text, id_col))
    named = gone.select("doc_id", "h") if once is None else gone.select("doc_id", "h").union(once.select("doc_id", "h"))
    some, stay = in_slots(rows, named, ["doc_id", "h"])

    def same(other: DataFrame, kind: str) -> DataFrame:
        x, y = some.alias("x"), other.alias("y")
        return x.join(y.hint("shuffle_merge"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.h") == F.col("y.h")), kind)

    some = same(gone, "left_anti")
    if once is not None and not once.isEmpty():
        some = same(once, "left_anti").unionByName(same(once, "left_semi").dropDuplicates(["doc_id", "h"]))
    return stay.unionByName(some).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def lean(run: Callable) -> Callable:
    """An Arrow function whose worker gives back the memory that it no longer needs when a task ends."""

    @wraps(run)
    def wrapped(batches: Iterator, *args, **kwargs) -> Iterator:
        yield from run(batches, *args, **kwargs)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return wrapped


def n_parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def packaged(name: str) -> str:
    """Path of a public tokenizer's vocabulary file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def file_bytes(path: str) -> bytes:
    with open(os.fspath(path), "rb") as f:
        return f.read()
