"""Near-duplicate groups by MinHash bands, odd sketches and exact checks.

1. Documents with the same shingle set form a class; one signature stands for it.
2. MinHash samples make bands; classes that share a band's bucket are candidates.
3. The samples are also folded into a parity bitmap (odd sketch): the population count
   of the XOR of two of them grows with the number of differing samples, so a pair
   far below the threshold is seen without its sets.
4. What remains is compared on the full sets: ``100 * |A & B| >= threshold * |A | B|``.

In a bucket the members are first compared with a hub, the member with the fullest buckets.
Only components that share a bucket and are then still apart are compared member by
member, in tiles of bounded size, where pairs never become rows: no candidate is left out.
The threshold sets the number of bands and the sketch limit: a link of exactly the
threshold is missed by all bands with probability MISS at most ((1 - 0.85^4)^32, 32
bands at 85; 45 at 80); higher similarities by less.

Defined cases: a text without words is linked with nothing; null is empty; the
smallest doc_id of a component names it (nulls are passed over); an empty table gives
no rows; other columns are carried along, whatever their names; very long texts are one
set each, made whole.  Shingles are 64-bit hashes of hashed words; sets are compared on them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute is used below
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import attach_groups, in_slots, lean, materialize, n_parts, quoted, row_key, scratch, table, without_rows
from tidelake.llm.graph import components
from tidelake.llm.shingles import U, mix, shingle_sets, slices

WORDS, THRESHOLD = 5, 85
PER_BAND, MISS = 4, 6.2e-11
#: Samples that an odd sketch folds, and its bits.
SAMPLES, SKETCH_BITS = 128, 256
#: Bytes of text whose sets are made at once; each takes several 64-bit numbers meanwhile.
SLICE = 1 << 20
#: Members of a tile, and the shingles after which it is closed.
TILE_ROWS, TILE_SHINGLES = 256, 1 << 19


def n_bands(threshold: int) -> int:
    """Bands of PER_BAND samples that a link of exactly the threshold misses with probability MISS at most."""
    return math.ceil(math.log(MISS) / math.log1p(-((threshold / 100) ** PER_BAND)))


def sketch_most(threshold: int) -> int:
    """Most differing sketch bits that a pair at the threshold may show: 84 at 85, 95 at 80.

    Of SAMPLES samples, d differ: the mean and six deviations.  They give 2 * d flips, whose
    odd bits are taken up to four deviations over their mean.
    """
    t, m = threshold / 100, SKETCH_BITS
    d = math.ceil(SAMPLES * (1 - t) + 6 * math.sqrt(SAMPLES * t * (1 - t)))
    one, two = (1 - 2 / m) ** (2 * d), (1 - 4 / m) ** (2 * d)
    spread = m / 4 * (1 - one * one) + m * (m - 1) / 4 * (two - one * one)
    return round(m / 2 * (1 - one) + 4 * math.sqrt(spread))


@lru_cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(977))
    a = rng.integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)
    return a, rng.integers(1, 1 << 63, n, dtype=np.uint64)


def samples(values: np.ndarray, starts: np.ndarray, n: int = SAMPLES) -> np.ndarray:
    """MinHash samples, one row a set; ``values`` are the sets, one after the other, none empty."""
    out = np.empty((len(starts), n), np.uint64)
    a, b = _hashes(n)
    for k in range(n):
        x = (values ^ b[k]) * a[k]
        out[:, k] = np.minimum.reduceat(x ^ (x >> U(32)), starts)
    return out


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the first SAMPLES samples: SKETCH_BITS / 64 words a set."""
    s = s[:, :SAMPLES]
    at = mix(s + np.arange(SAMPLES, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) & U(SKETCH_BITS - 1)
    out = np.zeros((len(s), SKETCH_BITS // 64), np.uint64)
    rows = np.arange(len(s))
    for k in range(s.shape[1]):
        np.bitwise_xor.at(out, (rows, (at[:, k] >> U(6)).astype(np.int64)), U(1) << (at[:, k] & U(63)))
    return out


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity that so many differing sketch bits speak for."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * np.asarray(differing) / SKETCH_BITS, 1e-9))


def bands(s: np.ndarray) -> np.ndarray:
    out = np.zeros((len(s), s.shape[1] // PER_BAND), np.uint64)
    for b in range(out.shape[1]):
        h = np.full(len(s), U(b * 0x9E37 + 1))
        for k in range(b * PER_BAND, (b + 1) * PER_BAND):
            h = mix(h * U(0xD6E8FEB86659FD93) + s[:, k])
        out[:, b] = h
    return out


def set_keys(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a whole set."""
    return tuple(mix(np.add.reduceat(mix(values ^ U(c)), starts)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


_SIGNATURE = "doc_id long, h long, n long, k0 long, k1 long, " + ", ".join(f"s{i} long" for i in range(SKETCH_BITS // 64)) + ", bands array<long>"


@lean
def _signatures(batches: Iterator[pa.RecordBatch], n_bands: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            sets = list(shingle_sets(batch.column("text"), WORDS))
            n = np.array([len(x) for x in sets], np.int64)
            some = np.flatnonzero(n)
            cols = {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "n": n}
            k = np.zeros((2, len(n)), np.uint64)
            sk, bd = np.zeros((len(n), SKETCH_BITS // 64), np.uint64), np.zeros((len(n), n_bands), np.uint64)
            if len(some):
                values = np.concatenate([sets[i] for i in some])
                starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                got = samples(values, starts, max(n_bands * PER_BAND, SAMPLES))
                k[:, some], sk[some], bd[some] = np.stack(set_keys(values, starts)), odd_sketch(got), bands(got[:, : n_bands * PER_BAND])
            cols |= {"k0": k[0].view(np.int64), "k1": k[1].view(np.int64)}
            cols |= {f"s{i}": sk[:, i].copy().view(np.int64) for i in range(sk.shape[1])}
            flat = pa.array(bd.reshape(-1).view(np.int64))
            cols["bands"] = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * n_bands), flat)
            yield pa.RecordBatch.from_pydict({c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in cols.items()})


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            sets = [x for x in shingle_sets(batch.column("text"), WORDS) if len(x)]
            if not sets:
                continue
            n = np.array([len(x) for x in sets])
            values, ends = np.concatenate(sets), np.cumsum(n)
            k0, k1 = set_keys(values, ends - n)
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_pydict({"k0": pa.array(k0.view(np.int64)), "k1": pa.array(k1.view(np.int64)), "set": lists.cast(pa.list_(pa.int64()))})


def _alike(a: str, b: str, threshold: int):
    """Sizes and sketches allow the threshold."""
    bits = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    sizes = (F.col(f"{a}.n") * 100 >= F.col(f"{b}.n") * threshold) & (F.col(f"{b}.n") * 100 >= F.col(f"{a}.n") * threshold)
    return sizes & (bits <= sketch_most(threshold))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cluster and size get the number of their tile."""
    tile, cluster, rows, total = TaskContext.get().partitionId() << 32, None, 0, 0
    for batch in batches:
        out = []
        for c, n in zip(batch.column("cluster").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if c != cluster or rows >= TILE_ROWS or total >= TILE_SHINGLES:
                tile, cluster, rows, total = tile + 1, c, 0, 0
            rows, total = rows + 1, total + n
            out.append(tile)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *batch.columns], ["tile", *batch.schema.names])


@lean
def _compare(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile pair and side: links between members of different components."""
    most = sketch_most(threshold)

    def links(x: list[dict], y: list[dict]) -> pa.RecordBatch:
        every = np.concatenate([r["set"] for r in y])
        universe, at = np.unique(every, return_inverse=True)
        size = np.array([len(r["set"]) for r in y])
        starts = np.cumsum(size) - size
        comp, vid = np.array([r["comp"] for r in y]), np.array([r["vid"] for r in y])
        sketch = np.array([r["sketch"] for r in y], np.int64)
        flag = np.zeros(len(universe) + 1, np.int32)
        a, b = [], []
        for r in x:
            n = len(r["set"])
            may = (comp != r["comp"]) & (size * 100 >= n * threshold) & (n * 100 >= size * threshold)
            may &= np.bitwise_count(sketch ^ np.array(r["sketch"], np.int64)).sum(axis=1) <= most
            if not may.any():
                continue
            own = np.searchsorted(universe, r["set"])
            own = own[universe[np.minimum(own, len(universe) - 1)] == r["set"]]
            flag[own] = 1
            same = np.add.reduceat(flag[at], starts)
            flag[own] = 0
            hit = np.flatnonzero(may & (same * 100 >= (n + size - same) * threshold))
            _, first = np.unique(comp[hit], return_index=True)  # one link to each component will do
            a += [r["vid"]] * len(first)
            b += vid[hit[first]].tolist()
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    now, sides = None, ([], [])
    for batch in batches:
        names = [f"s{i}" for i in range(SKETCH_BITS // 64)]
        values = batch.column("set").flatten().to_numpy()
        ends = np.cumsum(pa.compute.list_value_length(batch.column("set")).to_numpy(zero_copy_only=False))
        table_ = batch.drop_columns(["set"]).to_pylist()
        for row, a, b in zip(table_, [0, *ends[:-1]], ends, strict=True):
            if (row["t0"], row["t1"]) != now:
                if now is not None:
                    yield links(*sides)
                now, sides = (row["t0"], row["t1"]), ([], [])
            sides[row["side"]].append({"vid": row["vid"], "comp": row["comp"], "sketch": [row[k] for k in names], "set": values[a:b]})
    if now is not None:
        yield links(*sides)


class _Search:
    """Links between classes, found round by round."""

    def __init__(self, docs: DataFrame, classes: DataFrame, threshold: int):
        self.docs, self.classes, self.threshold = docs, classes, threshold
        self.info = classes.select("vid", "n", *[f"s{i}" for i in range(SKETCH_BITS // 64)])

    def sets_of(self, vids: DataFrame) -> DataFrame:
        """vid, set: the full shingle set of each of some classes, made from their texts again."""
        need = materialize(self.classes.select("vid", "first_id", "k0", "k1").join(vids, "vid"), "need")
        ids = need.select(F.col("first_id").alias("doc_id")).distinct()
        some, _ = in_slots(self.docs, ids, ["doc_id"])  # other texts stay where they are
        x, y = some.alias("x"), ids.hint("shuffle_merge").alias("y")
        texts = x.join(y, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")), "left_semi")
        sets = texts.mapInArrow(_sets, "k0 long, k1 long, set array<long>").join(need.select("vid", "k0", "k1"), ["k0", "k1"])
        return materialize(sets.select("vid", "set").dropDuplicates(["vid"]), "sets")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those linked on their full sets."""
        pairs = materialize(pairs, "pairs")
        sets = self.sets_of(pairs.select(F.col("a").alias("vid")).union(pairs.select("b")).distinct())
        both = pairs.join(sets.select(F.col("vid").alias("b"), F.col("set").alias("sb")).hint("shuffle_merge"), "b")
        both = both.join(sets.select(F.col("vid").alias("a"), F.col("set").alias("sa")).hint("shuffle_merge"), "a")
        same = F.size(F.array_intersect("sa", "sb"))
        linked = both.select("a", "b", ((same * 100) >= (F.size("sa") + F.size("sb") - same) * self.threshold).alias("linked"))
        linked = materialize(linked, "linked")
        return linked.filter("linked").select("a", "b")

    def rest(self, live: DataFrame) -> DataFrame:
        """Links that are still missing between components which share a bucket.

        Such components' members form clusters; a cluster is cut into tiles by set size,
        and every two tiles that can hold a link are compared in one task of bounded
        memory.  Pairs are not rows: only links leave the task.
        """
        parts = n_parts(live.sparkSession)
        mixed = live.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("vid").alias("low")).filter("lo < hi")
        some = materialize(live.join(mixed.select("bucket", "low").hint("shuffle_merge"), "bucket").select("vid", "comp", "low"), "rest")
        cluster = components(some.select(F.col("vid").alias("a"), F.col("low").alias("b")))
        members = some.select("vid", "comp").distinct().join(self.info.hint("shuffle_merge"), "vid")
        members = _labelled(members.withColumnRenamed("comp", "own"), cluster).withColumnsRenamed({"comp": "cluster", "own": "comp"})
        members = members.select("cluster", "n", "vid", "comp", *[f"s{i}" for i in range(SKETCH_BITS // 64)])
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields)
        tiled = members.repartitionByRange(parts, "cluster", "n", "vid").sortWithinPartitions("cluster", "n", "vid").mapInArrow(_tiles, f"tile long, {schema}")
        tiled = materialize(tiled, "tiles")
        tiles = tiled.groupBy("cluster", "tile").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        x, y = tiles.alias("x"), tiles.alias("y")
        sizes = (F.col("x.n1") * 100 >= F.col("y.n0") * self.threshold) & (F.col("y.n1") * 100 >= F.col("x.n0") * self.threshold)
        differ = (F.col("x.c0") != F.col("x.c1")) | (F.col("y.c0") != F.col("y.c1")) | (F.col("x.c0") != F.col("y.c0"))
        both = x.join(y.hint("shuffle_merge"), (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.tile") <= F.col("y.tile")) & sizes & differ)
        both = materialize(both.select(F.col("x.tile").alias("t0"), F.col("y.tile").alias("t1")), "tile_pairs")
        sides = both.select("t0", "t1", F.lit(0).alias("side"), F.col("t0").alias("tile")).union(both.select("t0", "t1", F.lit(1), F.col("t1")))
        sets = self.sets_of(tiled.select("vid"))
        rows = sides.join(tiled.drop("cluster", "n").join(sets.hint("shuffle_merge"), "vid").hint("shuffle_merge"), "tile")
        rows = rows.repartition(parts, "t0", "t1").sortWithinPartitions("t0", "t1", "side")
        return materialize(rows.mapInArrow(partial(_compare, threshold=self.threshold), "a long, b long"), "more_links")

    def screened(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and sketches allow a link."""
        left = pairs.join(self.info.select(F.struct("*").alias("x"), F.col("vid").alias("a")).hint("shuffle_merge"), "a")
        right = self.info.select(F.struct("*").alias("y"), F.col("vid").alias("b")).hint("shuffle_merge")
        return left.join(right, (left["b"] == right["b"]) & _alike("x", "y", self.threshold)).select(left["a"], left["b"])


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their component so far (themselves, if in no link)."""
    found = rows.join(labels, "vid", "left")
    return found.withColumn("comp", F.coalesce("comp", "vid"))


def _grouped(docs: DataFrame, text: str, id_col: str, threshold: int) -> DataFrame:
    """One row per document: doc_id, h (of its text), n_shingles, comp (null: linked with nothing), component_id."""
    docs = docs.select(*row_key(docs, text, id_col), quoted(text).cast("string").alias("text"))
    sig = materialize(docs.mapInArrow(partial(_signatures, n_bands=n_bands(threshold)), _SIGNATURE), "signatures")
    some = sig.filter("n > 0")
    other = ["n", *[f"s{i}" for i in range(SKETCH_BITS // 64)], "bands"]
    classes = some.groupBy("k0", "k1").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"), *[F.first(c).alias(c) for c in other])
    classes = materialize(classes.withColumn("vid", F.monotonically_increasing_id()), "classes")

    search = _Search(docs, classes.drop("bands"), threshold)
    rows = materialize(classes.select("vid", F.explode("bands").alias("bucket")), "bands")
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    live = materialize(rows.join(buckets.hint("shuffle_merge"), "bucket"), "live")
    # the member whose buckets are the fullest: of edited copies of one text, that text
    weight = live.groupBy("vid").agg(F.sum("m").alias("weight"))
    live = live.select("bucket", "vid").join(weight.hint("shuffle_merge"), "vid")
    live = materialize(live.withColumn("rank", F.struct("weight", (-F.col("vid")).alias("less"))).drop("weight"), "ranked")
    hubs = live.groupBy("bucket").agg(F.max_by("vid", "rank").alias("hub"))
    first = live.join(hubs.hint("shuffle_merge"), "bucket").filter("vid != hub")
    first = first.select(F.least("vid", "hub").alias("a"), F.greatest("vid", "hub").alias("b")).distinct()
    links = search.verify(search.screened(first))
    labels = components(links)

    labels = components(links.union(search.rest(_labelled(live.drop("rank"), labels))))

    named = _labelled(classes.select("k0", "k1", "vid", "first_id", "size"), labels)
    lowest = named.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("_m"))
    named = materialize(named, "named")
    named = attach_groups(named, lowest, "comp", "_m", named.count())
    groups = materialize(named.select(F.struct("k0", "k1").alias("_key"), "size", "comp", "component_id"), "class_components")
    small = materialize(sig.select("doc_id", "h", F.col("n").alias("n_shingles"), F.struct("k0", "k1").alias("_key")), "documents")
    found = attach_groups(small.filter("n_shingles > 0"), groups, "_key", "size", small.count()).select("doc_id", "h", "n_shingles", "comp", "component_id")
    none = small.filter("n_shingles = 0").select("doc_id", "h", "n_shingles", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    return found.unionByName(none)


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; linked from ``threshold`` percent on."""
    found = _grouped(docs, text, id_col, threshold).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each near-duplicate group; all columns as given, whatever their names.

    The row with the smallest id of the group stays (null comes last; of several with that
    id, the one whose text has the lowest hash).  Repeated rows of one id and text count as
    one document: one of them is returned.
    """
    with scratch() as keep:
        rows = _grouped(docs, text, id_col, threshold).groupBy("comp", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
        rows = materialize(rows, "near")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
        first = rows.filter("comp is not null").groupBy("comp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size"))
        linked = attach_groups(rows.filter("comp is not null"), first, "comp", "size", rows.count())
        linked = linked.select("doc_id", "h", "n", order.eqNullSafe(F.col("first")).alias("stays"))
        every = linked.unionByName(rows.filter("comp is null").select("doc_id", "h", "n", F.lit(True).alias("stays")))
        every = keep(every.filter("not stays or n > 1").select("doc_id", "h", "stays"), "near_repeated")
    return without_rows(docs, every.filter("not stays"), every.filter("stays"), text, id_col)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
