"""Connected components of a link table.

Blocks of at most BLOCK links are first reduced to stars where they lie, without a
shuffle.  If the links that are left fit one block, one more such step ends it: rounds of
small shuffles would cost far more than the work.  Any more links go by alternating
large-star and small-star steps, which hold no more than a vertex's smallest neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import lean, materialize

#: Links that are held at once: 16 bytes each, and several numbers more meanwhile.
BLOCK = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (vertex, smallest vertex of its component) of a graph, none for the smallest itself."""
    vertex, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(vertex))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root != (further := root[root])).any():
            root = further
    own = np.flatnonzero(root != np.arange(len(vertex)))
    return vertex[own], vertex[root[own]]


@lean
def _stars(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Stars of each block of ``most`` links, which have the same components together."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        a, b = stars(table.column(0).to_numpy(), table.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - n)
            batch = batch.slice(part.num_rows)
            held, n = [*held, part], n + part.num_rows
            if n == most:
                yield block(held)
                held, n = [], 0
    if held:
        yield block(held)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each vertex to the smallest of them."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(low.hint("shuffle_merge"), "a")
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """vid -> comp (the smallest vertex of its component) for every vertex of ``links`` (a, b)."""
    run = partial(_stars, most=BLOCK)
    edges = materialize(links.select("a", "b").mapInArrow(run, "a long, b long"), "stars")
    if edges.count() <= BLOCK:
        edges = materialize(edges.coalesce(1).mapInArrow(run, "a long, b long"), "stars")
        return edges.select(F.col("a").alias("vid"), F.col("b").alias("comp"))
    edges = materialize(edges.distinct(), "edges")  # (a, b) with a > b
    before = None
    for _ in range(most_rounds):
        edges = materialize(_star(_star(edges, True), False), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("vid"), F.col("b").alias("comp"))
