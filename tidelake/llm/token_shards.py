"""Token ids in training order, as fixed-stride binary shards.

Documents are encoded (an end token after each) and cut into sequences of at most
``LENGTH`` ids.  A keyed Feistel permutation of [0, N) with cycle-walking gives every
sequence its global slot: no sort keys are stored, the order can be recomputed from the
key, and it can be inverted.  Range partitions by shard then hold whole shards in slot
order; every record has the same number of bytes, so a reader that has to resume seeks
to ``HEADER + (slot - first) * stride``.

Sequences are numbered in the order of the input's splits before they are permuted; the
numbers are kept in a table, so a lost executor cannot change them.

Defined cases: null is empty: such a document is one sequence with the end token only;
repeated rows are documents of their own; a null doc_id stays null; an empty table gives
no rows; other columns are not used.
"""

from __future__ import annotations

import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.byte_pairs import PairMerges, runs
from tidelake.llm.common import file_bytes, materialize, packaged, table
from tidelake.llm.distinct_words import SLICE, WordSplitter
from tidelake.llm.shingles import U, mix, slices

VOCABULARY, END = "byte_bpe_50k.json", 50256
LENGTH, PER_SHARD, KEY, ROUNDS = 256, 8192, 20240229, 6
MAGIC, HEADER = b"TIDESEQ1", 64
#: Words whose ids a task keeps; beyond that number it forgets them all before the next slice.
_KEPT_WORDS = 1_000_000
_BATCH = 2048


def feistel(x: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of [0, n): balanced Feistel rounds on an even number of bits,

    walked along its cycle until the value is below n.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    with np.errstate(over="ignore"):
        keys = [mix(np.array([U(key & (2**64 - 1)) + U(0x9E3779B97F4A7C15) * U(r + 1)]))[0] for r in range(ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> U(half), v & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                a, b = b ^ (mix(a ^ k) & mask), a
            else:
                a, b = b, a ^ (mix(b ^ k) & mask)
        return (a << U(half)) | b

    out = once(np.asarray(x).astype(np.uint64))
    far = np.flatnonzero(out >= U(n))
    while len(far):
        out[far] = once(out[far])
        far = far[out[far] >= U(n)]
    return out.astype(np.int64)


class _Ids:
    """Ids of texts; a word has a code, and its ids are found once, for all new words together."""

    def __init__(self, split: WordSplitter, merges: PairMerges | None):
        self._split, self._merges = split, merges
        self.known: defaultdict = defaultdict(count().__next__)
        for x in (None, *range(len(split.special))):  # None ends a text
            self.known[x]  # noqa: B018  the first codes
        self._ids = np.array([END, *(t for _, t in split.special)], "<u2")
        self._ends = np.arange(len(self._ids) + 1)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, in the order of their codes; words the merges do not take go to the library."""
        spelled = [w.encode() for w in words]
        far = np.fromiter(map(len, spelled), np.int64, len(spelled)) > (self._merges.LONGEST if self._merges else 0)
        long, short = np.flatnonzero(far), np.flatnonzero(~far)
        found = [np.array(self._split.pieces(words[k]), "<u2") for k in long.tolist()]
        size = np.zeros(len(words), np.int64)
        size[long] = [len(x) for x in found]
        if len(short):
            ids, size[short] = self._merges([spelled[k] for k in short.tolist()] if found else spelled)
            found.append(ids)
        ends = np.cumsum(size)
        order = np.concatenate([long, short])
        more = np.empty(ends[-1], "<u2")
        more[runs((ends - size)[order], size[order])] = np.concatenate(found)
        self._ids, self._ends = np.concatenate([self._ids, more]), np.concatenate([self._ends, self._ends[-1] + ends])

    def __call__(self, texts: list[str | None]) -> tuple[bytes, list[int]]:
        """Ids of all texts as bytes, an end token after each, and where each text ends."""
        codes = []
        for text in texts:
            words = self._split(text or "")
            words.append(None)
            codes.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        new = len(self.known) - len(self._ends) + 1
        if new:
            self._learn(list(islice(reversed(self.known), new))[::-1])
        every = np.concatenate(codes)
        begin = self._ends[every]
        size = self._ends[every + 1] - begin
        ends = np.cumsum(size)[np.cumsum([len(x) for x in codes]) - 1]
        return self._ids[runs(begin, size)].tobytes(), (2 * ends).tolist()


@lru_cache(maxsize=1)
def _tools(vocabulary: bytes) -> tuple[WordSplitter, PairMerges | None]:
    """Made once a worker: it takes most of a second."""
    split = WordSplitter(vocabulary)
    return split, PairMerges.of(vocabulary, split.letters)


def _encode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, part = _tools(vocabulary.value), TaskContext.get().partitionId()
        encode, number = _Ids(*tools), 0
        for batch in (x for whole in batches for x in slices(whole, "text", SLICE)):
            out: dict[str, list] = {k: [] for k in ("split", "number", "doc_id", "part", "ids")}
            if len(encode.known) > _KEPT_WORDS:
                encode = _Ids(*tools)
            ids, ends = encode(batch.column(1).to_pylist())
            for doc, (begin, end) in zip(batch.column(0).to_pylist(), pairwise([0, *ends]), strict=True):
                for k, at in enumerate(range(begin, end, 2 * LENGTH)):
                    for c, v in zip(out, (part, number, doc, k, ids[at : min(end, at + 2 * LENGTH)]), strict=True):
                        out[c].append(v)
                    number += 1
                if len(out["ids"]) > _BATCH:
                    yield _rows(out)
                    out = {k: [] for k in out}
            if out["ids"]:
                yield _rows(out)

    return run


def _rows(out: dict) -> pa.RecordBatch:
    kinds = {"split": pa.int64(), "number": pa.int64(), "doc_id": pa.int64(), "part": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], list(out))


def sequences(docs: DataFrame, vocabulary_path: str, key: int = KEY, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """slot, shard, doc_id, part, ids of every sequence, in partitions of whole shards, in slot order."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(file_bytes(vocabulary_path))  # a vocabulary file: a few MB
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = materialize(docs.mapInArrow(_encode(vocabulary), "split long, number long, doc_id long, part long, ids binary"), "sequences")
    counts = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per input split
    base, total = {}, 0
    for s in sorted(counts):
        base[s], total = total, total + counts[s]
    bases = spark.sparkContext.broadcast(base)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = bases.value
        for batch in batches:
            at = np.array([first[s] for s in batch.column("split").to_pylist()], np.int64) + batch.column("number").to_numpy()
            slot = feistel(at, total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // PER_SHARD), *(batch.column(c) for c in ("doc_id", "part", "ids"))], ["slot", "shard", "doc_id", "part", "ids"])

    shards = max(1, -(-total // PER_SHARD))
    placed = rows.mapInArrow(place, "slot long, shard long, doc_id long, part long, ids binary")
    return placed.repartitionByRange(shards, "shard").sortWithinPartitions("slot")


def records(rows: DataFrame) -> DataFrame:
    """Sequences with their record (``LENGTH`` little-endian 16-bit ids, filled up with the end token) and its place in its shard."""
    n = F.expr("octet_length(ids) div 2").cast("long")
    fill = F.unhex(F.lit(np.array([END], "<u2").tobytes().hex() * LENGTH))
    offset = F.lit(HEADER) + (F.col("slot") - F.col("shard") * PER_SHARD) * (2 * LENGTH)
    record = F.expr("substring(concat(ids, _fill), 1, {})".format(2 * LENGTH))
    return rows.withColumn("_fill", fill).select("slot", "shard", offset.alias("offset"), "doc_id", "part", n.alias("n_tokens"), record.alias("record"))


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` as shard files to a folder all executors share; a row for each file.

    A file appears under its name only when it is whole, so a repeated task changes nothing.
    """
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shard, out, temp, n = None, None, "", 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(temp, f"{root}/shard-{shard:08d}.bin")
            return pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{root}/shard-{shard:08d}.bin"], "n": [n]})

        for batch in batches:
            for s, record in zip(batch.column("shard").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if s != shard:
                    if out is not None:
                        yield close()
                    shard, n, temp = s, 0, f"{root}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp)
                    out.write((MAGIC + struct.pack("<qqq", s * PER_SHARD, LENGTH, 2 * LENGTH)).ljust(HEADER, b"\0"))
                out.write(record)
                n += 1
        if out is not None:
            yield close()

    return materialize(rows.select("shard", "record").mapInArrow(run, "shard long, path string, n long"), "shards")


def read_shards(folder: str, start: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) in slot order from slot ``start`` on, by one seek and sequential reads."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    shard = start // PER_SHARD
    while store.get_file_info(path := f"{root}/shard-{shard:08d}.bin").type == fs.FileType.File:
        with store.open_input_file(path) as f:
            head = f.read(HEADER)
            first, length, stride = struct.unpack("<qqq", head[len(MAGIC) : len(MAGIC) + 24])
            if head[: len(MAGIC)] != MAGIC:
                raise ValueError(f"{path} is not a shard")
            slot = max(first, start)
            f.seek(HEADER + (slot - first) * stride)
            while len(record := f.read(stride)) == stride:
                yield slot, np.frombuffer(record, "<u2", length)
                slot += 1
        shard += 1


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, shard, offset, doc_id, part, n_tokens and record of every sequence."""
    return records(sequences(table(spark, sf_dir, "documents"), packaged(VOCABULARY)))
