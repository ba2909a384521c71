"""Removal of repeated 200-byte strings, with suffix arrays over small shared regions.

1. Every 200-byte window has an anchor: the 32-byte string in it with the smallest hash.
   Consecutive windows of one anchor form a run.  Equal windows have equal anchors, so
   only anchors that occur twice anywhere matter; equal runs are kept as one with a count.
2. Runs of a repeated anchor that differ are cut out of their texts, brought together by
   anchor, and searched by a suffix array (``suffix_array``) of the places where a hash of
   the next bytes is low: a window is repeated if what follows the first such place in it is
   shared with a neighbour in suffix order, and the bytes before are the same.
3. An anchor with over ``MOST_TEXTS`` different runs (a passage in very many documents) is
   split: blocks of its windows are told apart by 128-bit hashes of their whole texts and
   of the middle their windows share, and halved where only the middle repeats.
4. Repeated windows become byte spans of the documents, which are cut out.

Texts are judged as they came, whole, as UTF-8 bytes; matches never cross documents.
Defined cases: null is empty; texts under 200 bytes lose nothing; repeated rows are
copies of each other and so lose everything a copy loses; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import materialize, n_parts, table
from tidelake.llm.shingles import _BASE, _BASE_INV, _BYTE, U, _power, mix
from tidelake.llm.suffix_array import LEAST, repeated_starts

ANCHOR = 32
#: Bytes of text taken at once in a task; different runs of an anchor that go to one suffix array.
PIECE_BYTES, MOST_TEXTS, BATCH_BYTES = 4 << 20, 1000, 2 << 20
#: Windows in a block of a split anchor.
BLOCK = 16
#: Windows whose anchors are found at once: their hashes stay in a core's cache.
STEP = 1 << 14


#: Base and byte table of a second hash, so that two of them tell texts apart by 128 bits.
_BASE_2 = U(0xC2B2AE3D27D4EB4F | 5)
_BASE_2_INV = U(pow(int(_BASE_2), -1, 1 << 64))
_BYTE_2 = np.random.Generator(np.random.PCG64(20240608)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


class _Hashes:
    """Hashes of all substrings of a byte array."""

    def __init__(self, raw: np.ndarray, second: bool = False):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        byte, up, down = (_BYTE_2, ("up2", _BASE_2), ("down2", _BASE_2_INV)) if second else (_BYTE, ("up", _BASE), ("down", _BASE_INV))
        np.cumsum(byte[raw] * _power(*up, n), out=self.sums[1:])
        self.down = _power(*down, n + 1)

    def of(self, begin: np.ndarray, length, salt: int = 0) -> np.ndarray:
        h = (self.sums[begin + length] - self.sums[begin]) * self.down[begin]
        return mix(mix(h ^ U(salt)) + np.asarray(length).astype(np.uint64))

    def side_by_side(self, first: int, stop: int, length: int) -> np.ndarray:
        """``of`` all positions from ``first`` to before ``stop``, by slices."""
        h = (self.sums[first + length : stop + length] - self.sums[first:stop]) * self.down[first:stop]
        return mix(mix(h) + U(length))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _anchors(hashes: _Hashes) -> np.ndarray:
    """Where the anchor of each window begins: its ANCHOR-byte string with the smallest hash, the first of equal ones."""
    n, wide, low = len(hashes.sums) - 1, LEAST - ANCHOR + 1, U((1 << 27) - 1)
    out = np.empty(n - LEAST + 1, np.int32)
    for o in range(0, len(out), STEP):
        stop = min(o + STEP, len(out))
        grams = hashes.side_by_side(o, stop + wide - 1, ANCHOR) & ~low
        grams |= np.arange(o, stop + wide - 1, dtype=np.uint64)
        out[o:stop] = _window_min(grams, wide) & low
    return out


def runs_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
    """Runs of windows in texts side by side: piece number, first window, how many, anchor, hash of the run."""
    none = np.zeros(0, np.int64)
    if not np.any(ends - starts >= LEAST):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = _Hashes(raw)
    at = _anchors(hashes)
    windows = np.maximum(ends - starts - LEAST + 1, 0)
    begins = starts[windows > 0]
    inside = np.repeat(np.tile([True, False], len(starts)), np.stack([windows, ends - starts - windows], 1).ravel())[: len(at)]
    new = np.append(True, at[1:] != at[:-1])
    new[begins] = True
    first = np.flatnonzero(new & inside)
    piece = np.searchsorted(ends, first, side="right")
    many = np.minimum(np.append(first[1:], len(at)), (starts + windows)[piece]) - first
    return piece, first, many, hashes.of(at[first].astype(np.int64), ANCHOR), hashes.of(first, many + LEAST - 1, 0x5DEECE66D)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Texts in groups of about PIECE_BYTES: (doc_id, h, offset in the text) of each piece, and its bytes.

    A longer text comes in several pieces that overlap so far that no window is lost.
    """
    tags: list[tuple] = []
    parts: list[bytes] = []
    held = 0
    for batch in batches:
        for doc, h, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            data = (text or "").encode()
            for o in range(0, max(1, len(data) - LEAST + 1), PIECE_BYTES):
                part = data[o : o + PIECE_BYTES + LEAST - 1]
                if parts and held + len(part) > PIECE_BYTES:
                    yield tags, parts
                    tags, parts, held = [], [], 0
                tags.append((doc, h, o))
                parts.append(part)
                held += len(part)
    if parts:
        yield tags, parts


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tags, parts in _pieces(batches):
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        piece, first, many, anchor, text = runs_of(np.frombuffer(b"".join(parts), np.uint8), starts, ends)
        begin = first - starts[piece] + np.array([t[2] for t in tags], np.int64)[piece]
        docs = pa.array([t[0] for t in tags], pa.int64()).take(pa.array(piece))
        h = np.array([t[1] for t in tags], np.int64)[piece]
        yield pa.RecordBatch.from_pydict({"key": anchor.view(np.int64), "th": text.view(np.int64), "doc_id": docs, "h": h, "a": begin, "m": many})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted runs: rows of (text, [key, th, many, hot, a, m])."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("key", "th", "many", "hot", "bytes")}
        held = 0
        for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
            data = (text.as_py() or "").encode()
            for w in wanted.as_py():
                for k in ("key", "th", "many", "hot"):
                    out[k].append(w[k])
                out["bytes"].append(data[w["a"] : w["a"] + w["m"] + LEAST - 1])
                held += w["m"] + LEAST
            if held > PIECE_BYTES:
                yield pa.RecordBatch.from_pydict(out)
                out, held = {k: [] for k in out}, 0
        if out["key"]:
            yield pa.RecordBatch.from_pydict(out)


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: whole groups of keys, batch by batch, through a suffix array."""

    def done(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("key", "th", "lo", "hi")}
        for (key, th, many, _), flags in zip(group, repeated_starts([g[3] for g in group]), strict=True):
            for lo, hi in [(0, len(flags))] if many > 1 else _spans(flags):
                for k, v in zip(out, (key, th, lo, hi), strict=True):
                    out[k].append(v)
        if out["key"]:
            yield pa.RecordBatch.from_pydict(out)

    group: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("key", "th", "many", "bytes")), strict=True):
            if held > BATCH_BYTES and row[0] != group[-1][0]:
                yield from done(group)
                group, held = [], 0
            group.append(row)
            held += len(row[3])
    if group:
        yield from done(group)


def _blocks(size: int):
    """Texts of a split anchor in blocks of ``size`` windows, with hashes of the middle that all
    windows of a block share (c0, c1) and of the block's whole text (f0, f1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("key", "th", "off", "c0", "c1", "f0", "f1", "bytes")}
            for key, th, base, data in zip(*(batch.column(k).to_pylist() for k in ("key", "th", "off", "bytes")), strict=True):
                raw = np.frombuffer(data, np.uint8)
                hashes, others = _Hashes(raw), _Hashes(raw, second=True)
                grams = hashes.of(np.arange(len(raw) - ANCHOR + 1), ANCHOR)
                at = int(np.flatnonzero(grams.view(np.int64) == key)[0])
                # blocks by the distance from window to anchor, so that equal windows are in equal blocks
                block = (at - np.arange(len(raw) - LEAST + 1)) // size
                first = np.flatnonzero(np.concatenate([[True], np.diff(block) != 0]))
                many = np.diff(np.append(first, len(block)))
                # the middle: from the nearest possible window's start to the farthest one's end
                begin, middle = at - block[first] * size, LEAST - size + 1
                c0, c1 = hashes.of(begin, middle, 3).view(np.int64), others.of(begin, middle, 5).view(np.int64)
                f0, f1 = hashes.of(first, many + LEAST - 1, 7).view(np.int64), others.of(first, many + LEAST - 1, 9).view(np.int64)
                for i, (o, m) in enumerate(zip(first.tolist(), many.tolist(), strict=True)):
                    for k, v in zip(out, (key, th, base + o, int(c0[i]), int(c1[i]), int(f0[i]), int(f1[i]), data[o : o + m + LEAST - 1]), strict=True):
                        out[k].append(v)
            if out["key"]:
                yield pa.RecordBatch.from_pydict(out)

    return run


def _split_search(hot: DataFrame) -> DataFrame:
    """(key, th, lo, hi) of repeated windows under split anchors.

    A block whose whole text repeats is repeated in all its windows; one whose middle
    repeats is halved and looked at again; others hold no repeated window.
    """
    parts = n_parts(hot.sparkSession)
    found, left, size = None, hot.select("key", "th", F.lit(0).cast("long").alias("off"), "bytes"), BLOCK
    schema = "key long, th long, off long, c0 long, c1 long, f0 long, f1 long, bytes binary"
    while size:
        blocks = materialize(left.repartition(parts).mapInArrow(_blocks(size), schema), f"blocks{size}")
        middle = blocks.groupBy("c0", "c1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        some = blocks.join(middle.hint("shuffle_merge"), ["c0", "c1"], "left_semi")
        whole = blocks.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("times"))
        some = materialize(some.join(whole.hint("shuffle_merge"), ["f0", "f1"]).select("key", "th", "off", "bytes", "times", "f0", "f1"), f"some{size}")
        own = some.filter("times > 1").select("key", "th", F.col("off").alias("lo"), (F.col("off") + F.octet_length("bytes") - (LEAST - 1)).alias("hi"))
        found = own if found is None else found.unionByName(own)
        # of equal blocks one goes on, for parts of it may be equal to parts of others
        left = some.filter("times = 1").unionByName(some.filter("times > 1").dropDuplicates(["f0", "f1"])).select("key", "th", "off", "bytes")
        size //= 2
    return found


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "spans", "kept")}
        held = 0
        for doc, text, spans in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "spans")), strict=True):
            data = (text or "").encode()
            merged: list[list[int]] = []
            for s in sorted((s["lo"], s["hi"]) for s in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            edges = [0, *(x for s in merged for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            for k, v in zip(out, (doc, len(data), [{"lo": a, "hi": b} for a, b in merged], kept), strict=True):
                out[k].append(v)
            held += len(data)
            if held > PIECE_BYTES:
                yield _removed(out)
                out, held = {k: [] for k in out}, 0
        if out["doc_id"]:
            yield _removed(out)


def _removed(out: dict) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), span, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of repeated anchors in ``docs`` (doc_id, h, text), and (key, th, lo, hi): their repeated windows."""
    spark = docs.sparkSession
    parts = n_parts(spark)
    runs = materialize(docs.mapInArrow(_runs, "key long, th long, doc_id long, h long, a long, m long"), "runs")
    again = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    live = materialize(runs.join(again.hint("shuffle_merge"), "key", "left_semi"), "live")

    kinds = live.groupBy("key", "th").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("doc_id", "h", "a", "m")).alias("x"))
    kinds = materialize(kinds, "kinds")
    per_key = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = kinds.join(per_key.hint("shuffle_merge"), "key")
    copies = kinds.filter("kinds = 1").select("key", "th", F.lit(0).cast("long").alias("lo"), F.col("x.m").alias("hi"))

    differ = kinds.filter("kinds > 1").select("key", "th", "many", (F.col("kinds") > MOST_TEXTS).alias("hot"), "x.*")
    wanted = differ.groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "th", "many", "hot", "a", "m")).alias("wanted"))
    x, y = docs.alias("x"), wanted.alias("y")
    texts = x.join(y.hint("shuffle_merge"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.h") == F.col("y.h"))).select("x.text", "wanted")
    cut = texts.mapInArrow(_cut, "key long, th long, many long, hot boolean, bytes binary").dropDuplicates(["key", "th"])
    cut = materialize(cut, "cut")

    near = cut.filter("not hot").repartition(parts, "key").sortWithinPartitions("key")
    found = copies.unionByName(near.mapInArrow(_search, "key long, th long, lo long, hi long"))
    hot = cut.filter("hot")
    if not hot.isEmpty():
        whole = hot.filter("many > 1").select("key", "th", F.lit(0).cast("long").alias("lo"), (F.octet_length("bytes") - (LEAST - 1)).cast("long").alias("hi"))
        found = found.unionByName(whole).unionByName(_split_search(hot))
    return live, found


def substring_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, spans (removed, as lo and hi) and kept (the remaining bytes) of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("text"))
    live, found = repeated_windows(docs)
    spans = live.join(found.hint("shuffle_merge"), ["key", "th"]).select("doc_id", "h", F.struct((F.col("a") + F.col("lo")).alias("lo"), (F.col("a") + F.col("hi") + (LEAST - 1)).alias("hi")).alias("s"))
    spans = materialize(spans.groupBy("doc_id", "h").agg(F.collect_list("s").alias("spans")), "spans")
    x, y = docs.alias("x"), spans.alias("y")
    both = x.join(y.hint("shuffle_merge"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.h") == F.col("y.h")), "left")
    schema = "doc_id long, n_bytes long, spans array<struct<lo: long, hi: long>>, kept binary"
    return both.select("x.doc_id", "x.text", "y.spans").mapInArrow(_remove, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
