"""Exact de-duplication by two-pass Bloom filtering.

Pass one sets, for every text's hash, a few positions of a two-level bitmap (seen
once, seen again); the levels of all partitions are merged by blocks.  Pass two
tests every hash against the second level: only rows whose positions were all seen
again are possibly repeated and go through a shuffle, the rest pass straight on.
A false positive costs the shuffle of a 40-byte row and never changes a result.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Defined cases: of equal texts the row with the largest doc_id stays (null is less
than any id); of repeated rows with that id one stays; an empty table gives no rows;
other columns, whatever their names, are carried along; texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import attach_groups, lower_ascii, materialize, n_parts, quoted, row_key, scratch, table, without_rows

#: Bits a row, positions a hash, and the most bits the bitmap may have (16 MB: what is broadcast).
#: With far more rows than MAX_BITS / BITS_PER_ROW the bitmap fills up and more hashes are
#: possibly repeated, at worst all: then all fingerprints are shuffled, still never a text.
BITS_PER_ROW, POSITIONS, MAX_BITS = 16, 3, 1 << 27
BLOCK_BITS = 1 << 15


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """POSITIONS bit numbers of each hash; double hashing of its two halves, mixed."""
    h = hashes.astype(np.uint64)
    a = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    b = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    return np.stack([((a + np.uint64(i) * b) >> np.uint64(20)) & np.uint64(bits - 1) for i in range(POSITIONS)])


def _distinct_positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """All positions, but none twice for one hash: a row alone must not look repeated."""
    p = np.sort(_positions(hashes, bits), axis=0)
    fresh = np.ones(p.shape, bool)
    fresh[1:] = p[1:] != p[:-1]
    return p[fresh].astype(np.int64)


def _mark(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = twos = None
        for batch in batches:
            if ones is None:
                ones, twos = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
            at, n = np.unique(_distinct_positions(batch.column(0).to_numpy(), bits), return_counts=True)
            bit = (1 << (at & 7)).astype(np.uint8)
            seen = (ones[at >> 3] & bit) > 0
            np.bitwise_or.at(twos, (at >> 3)[seen | (n > 1)], bit[seen | (n > 1)])
            np.bitwise_or.at(ones, at >> 3, bit)
        if ones is None:
            return
        size = min(BLOCK_BITS, bits) // 8
        for k in range(0, bits // 8, size):
            o = ones[k : k + size]
            if o.any():
                yield pa.RecordBatch.from_pydict({"block": [k // size], "ones": [o.tobytes()], "twos": [twos[k : k + size].tobytes()]})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            o, t = np.frombuffer(row["ones"], np.uint8), np.frombuffer(row["twos"], np.uint8)
            if row["block"] in found:
                have = found[row["block"]]
                have[1] |= t | (have[0] & o)
                have[0] |= o
            else:
                found[row["block"]] = [o.copy(), t.copy()]
    for k, (_, t) in found.items():
        if t.any():
            yield pa.RecordBatch.from_pydict({"block": [k], "twos": [t.tobytes()]})


def _test(bits: int, level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twos = np.frombuffer(level.value, np.uint8)
        for batch in batches:
            at = _positions(batch.column("_h").to_numpy(), bits).astype(np.int64)
            hit = ((twos[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
            yield batch.append_column("_maybe", pa.array(hit, pa.bool_()))

    return run


def possibly_repeated(rows: DataFrame, total: int) -> DataFrame:
    """Adds boolean ``_maybe`` to rows with a long ``_h``: false only where no other row has that hash."""
    spark = rows.sparkSession
    bits = max(1 << 10, min(MAX_BITS, 1 << int(np.ceil(np.log2(max(1, total) * BITS_PER_ROW)))))
    blocks = rows.select("_h").mapInArrow(_mark(bits), "block long, ones binary, twos binary")
    merged = blocks.repartition(n_parts(spark), "block").mapInArrow(_merge, "block long, twos binary")
    level = np.zeros(bits // 8, np.uint8)
    size = min(BLOCK_BITS, bits) // 8
    for row in merged.collect():  # bits / 8 bytes in all, whatever the rows
        level[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["twos"], np.uint8)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_test(bits, spark.sparkContext.broadcast(level.tobytes())), f"{schema}, _maybe boolean")


def _tested(docs: DataFrame, text: str, id_col: str) -> tuple[DataFrame, int]:
    """doc_id, h, _sha and _maybe of every row, and how many there are."""
    sha = F.sha2(lower_ascii(F.coalesce(quoted(text).cast("string"), F.lit(""))), 256)
    rows = docs.select(*row_key(docs, text, id_col), F.unhex(sha).alias("_sha"))
    rows = materialize(rows.withColumn("_h", F.xxhash64("_sha")), "fingerprints")
    total = rows.count()
    return materialize(possibly_repeated(rows, total), "tested"), total


def equal_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each different (id, normalised text): its group's keep_id and size, and ``n_same`` such rows."""
    tested, total = _tested(docs, text, id_col)
    alone = tested.filter(~F.col("_maybe")).select("doc_id", "_sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("n_same"))
    maybe = tested.filter("_maybe").groupBy("doc_id", "_sha").agg(F.count(F.lit(1)).alias("n_same"))
    maybe = materialize(maybe, "maybe")
    groups = maybe.groupBy("_sha").agg(F.max("doc_id").alias("keep_id"), F.sum("n_same").alias("group_size"))
    return alone.unionByName(attach_groups(maybe, groups, "_sha", "group_size", total).select(alone.columns))


def report(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = equal_groups(docs, text, id_col)
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "n_same")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_k") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without repeated texts; all columns as given, whatever their names.

    Only possibly repeated hashes are grouped, and texts stay where they are but for those
    that go and the few that share a slot with them (``without_rows``).  Of rows that also
    share the id that stays, the one whose text has the highest hash stays.
    """
    with scratch() as keep:
        tested, total = _tested(docs, text, id_col)
        maybe = materialize(tested.filter("_maybe").groupBy("_sha", "doc_id", "h").agg(F.count(F.lit(1)).alias("n")), "maybe")
        groups = maybe.groupBy("_sha").agg(F.max(F.struct("doc_id", "h")).alias("stays"), F.sum("n").alias("size")).filter("size > 1")
        rows = attach_groups(maybe, groups, "_sha", "size", total).withColumn("stays", F.struct("doc_id", "h").eqNullSafe(F.col("stays")))
        rows = keep(rows.filter("not stays or n > 1").select("doc_id", "h", "stays"), "repeated")
    return without_rows(docs, rows.filter("not stays"), rows.filter("stays"), text, id_col)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h
  from documents),
g as (select h, max(doc_id) as keep_id, count(*) as group_size from d group by h),
r as (select d.*, row_number() over (partition by h, doc_id) as k from d)
select r.doc_id, g.keep_id, g.group_size,
       (r.doc_id is not distinct from g.keep_id and r.k = 1) as kept, r.h as text_sha256
from r join g using (h)
"""
