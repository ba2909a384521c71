"""A corpus as distinct words and positions, for work that is done once per distinct word.

A task cuts its texts into chunks of bounded size.  In a chunk every word has a code
(frequent words the small ones); its documents are code sequences, or code counts.  The
distinct words of a chunk are dealt into buckets by a hash of the word, so that all
chunks' copies of one word meet in one bucket and are worked on once; what was found
goes back to each chunk under the words' codes.  The chunk table is bucketed by chunk:
in that join only the results move.

    chunks(docs)  ->  rows of words by bucket + rows of documents
    per_word()    ->  words by bucket, each distinct word once  ->  results by chunk
    named()       ->  the ids in a chunk's results, joined with a table of names
    per_chunk()   ->  documents of a chunk with the results for all their codes

A word occurs at most once a chunk, so no key is hot; only distinct words and compressed
codes are shuffled, never one row per occurrence.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import lean, materialize_buckets, n_parts
from tidelake.llm.shingles import slices

#: Text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Text of a batch that is taken out of Arrow at once.
SLICE = 1 << 20
#: Bucket of the row that holds a chunk's documents: after those of its words.
DOCS = 1 << 30
_TABLE = "chunk long, bucket int, n long, a binary, b binary, c binary"
#: Below this code point the quick patterns are checked against the library, character by character.
PLAIN = 0x250

#: L, N and S stand for the letters, numbers and white space below PLAIN, lower-cased too: explicit classes are quicker than properties.
_QUICK = {
    "byte": (False, r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"),
    "word": (True, r"'s|'t|'re|'ve|'m|'ll|'d|[L]+|[N]|[^SLN]+"),
}


def _quick_pattern(template: str) -> re.Pattern:
    classes = {}
    seen = sorted({ord(x) for c in range(PLAIN) for x in (chr(c), *chr(c).lower())})
    for name, kind in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
        own = [c for c in seen if regex.fullmatch(kind, chr(c))]
        runs = [[x for _, x in g] for _, g in groupby(enumerate(own), lambda x: x[1] - x[0])]
        classes[name] = "".join(re.escape(chr(r[0])) + (f"-{re.escape(chr(r[-1]))}" if len(r) > 1 else "") for r in runs)
    return re.compile(re.sub("[LNS]", lambda m: classes[m[0]], template))


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: printable ones are themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordSplitter:
    """Words (pre-tokens) of texts, as the library for a vocabulary file gives them."""

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.decode())
        self.library.no_truncation()
        self.library.no_padding()
        added = sorted(self.library.get_added_tokens_decoder().items())
        if any(a.single_word or a.lstrip or a.rstrip or a.normalized for _, a in added):
            raise NotImplementedError("added tokens with conditions")
        #: Special strings in texts are tokens of their own: code i stands for the i-th.
        self.special = [(a.content, i) for i, a in added]
        self._cut = re.compile("(" + "|".join(re.escape(s) for s, _ in sorted(self.special, key=lambda x: -len(x[0]))) + ")") if added else None
        self.letters = _byte_letters()
        self._odd = re.compile(f"[^\x00-{chr(PLAIN - 1)}]")
        quick = ((low, _quick_pattern(p)) for low, p in _QUICK.values())
        self.quick = next((q for q in quick if self._agrees(*q)), None)
        if self.quick:
            self._low, self._find = self.quick[0], self.quick[1].findall

    def _by_library(self, text: str) -> list[str]:
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _agrees(self, low: bool, pattern: re.Pattern) -> bool:
        find = pattern.findall
        for c in map(chr, range(PLAIN)):
            for s in (f"a{c}b '{c}s", f" {c} {c}{c}", f"1{c}2 \n{c}\t x", f"! {c}!{c}"):
                if find(s.lower() if low else s) != self._by_library(s):
                    return False
        return True

    def _plain(self, text: str) -> list[str]:
        if self.quick is None or self._odd.search(text):
            return self._by_library(text)
        return self._find(text.lower() if self._low else text)

    def __call__(self, text: str) -> list[str | int]:
        """Words in order; a special string is its number."""
        if self._cut is None or "<" not in text and all("<" in s for s, _ in self.special) or not self._cut.search(text):
            return self._plain(text)
        numbers = {s: i for i, (s, _) in enumerate(self.special)}
        out: list[str | int] = []
        for part in self._cut.split(text):
            out += [numbers[part]] if part in numbers else self._plain(part) if part else []
        return out

    def pieces(self, word: str) -> list[int]:
        """Ids of one word."""
        return [t.id for t in self.library.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(data: bytes, dtype, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, codec="zstd"), dtype) if n else np.zeros(0, dtype)


def _ipc(**columns) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read_ipc(data: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(data)))


class _Chunk:
    """Documents of a chunk as codes in the order words were first seen."""

    def __init__(self, specials: int):
        self.known: defaultdict = defaultdict(count().__next__)
        self.specials, self.held = specials, 0
        for i in range(specials):
            self.known[i]  # noqa: B018  the first codes
        self.ids: list = []
        self.sizes: list[int] = []
        self.codes: list[np.ndarray] = []

    def add(self, doc_id, size: int, words: list) -> None:
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.codes.append(np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words)))
        self.held += size


def _chunk_rows(number: int, chunk: _Chunk, buckets: int, counts: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk: words by bucket, then its documents."""
    ids, sizes, specials = chunk.ids, chunk.sizes, chunk.specials
    every = np.concatenate(chunk.codes)
    seen = list(chunk.known)
    often = np.bincount(every, minlength=len(seen))
    often[:specials] = len(every) + 1  # these keep their codes
    order = np.argsort(-often, kind="stable")
    code = np.empty(len(seen), np.uint32)
    code[order] = np.arange(len(seen), dtype=np.uint32)
    dealt: list[list[int]] = [[] for _ in range(buckets)]
    rows: dict[str, list] = {k: [] for k in ("chunk", "bucket", "n", "a", "b", "c")}
    spelled = [b"" if isinstance(w, int) else w.encode() for w in seen]
    for i in order[specials:].tolist():
        dealt[zlib.crc32(spelled[i]) % buckets].append(i)
    for b, own in enumerate(dealt):
        if own:
            words = [spelled[i] for i in own]
            for k, v in zip(rows, (number, b, len(own), _pack(np.diff(code[own], prepend=np.uint32(0))), _pack(np.fromiter(map(len, words), np.uint32, len(words))), pa.compress(b"".join(words), codec="zstd", asbytes=True)), strict=True):
                rows[k].append(v)
    every = code[every]
    n = np.fromiter(map(len, chunk.codes), np.int64, len(ids))
    times = np.zeros(0, np.uint32)
    if counts and len(every):
        got = [np.unique(x, return_counts=True) for x in np.split(every, np.cumsum(n)[:-1])]
        every, times = np.concatenate([x for x, _ in got]).astype(np.uint32), np.concatenate([x for _, x in got]).astype(np.uint32)
        n = np.array([len(x) for x, _ in got], np.int64)
        every = np.diff(every, prepend=np.uint32(0))  # ascending in a document: small steps
    meta = _ipc(doc_id=pa.array(ids, pa.int64()), n_bytes=pa.array(sizes, pa.int64()), n=pa.array(n), top=pa.array([len(seen)] * len(n), pa.int64()))
    halves = [_pack((every & 0xFFFF).astype(np.uint16)), _pack((every >> 16).astype(np.uint16))]
    body = _ipc(lo=[halves[0]], hi=[halves[1]], times=[_pack(times)], kept=[len(times)])
    for k, v in zip(rows, (number, DOCS, len(every), meta, body, b""), strict=True):
        rows[k].append(v)
    yield pa.RecordBatch.from_pydict({"chunk": rows["chunk"], "bucket": pa.array(rows["bucket"], pa.int32()), **{k: rows[k] for k in ("n", "a", "b", "c")}})


def chunks(docs: DataFrame, vocabulary, counts: bool, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The chunk table of ``docs``, materialised.  ``vocabulary``: broadcast bytes of the file.

    counts: documents as (code, times) instead of code sequences.
    """
    buckets = max(64, min(8192, 2 * n_parts(docs.sparkSession)))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = WordSplitter(vocabulary.value)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(len(split.special))
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len((t or "").encode())
                if chunk.ids and chunk.held + size > CHUNK_BYTES:
                    yield from _chunk_rows(number, chunk, buckets, counts)
                    number, chunk = number + 1, _Chunk(len(split.special))
                chunk.add(i, size, split(t or ""))
        if chunk.ids:
            yield from _chunk_rows(number, chunk, buckets, counts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialize_buckets(rows.mapInArrow(run, _TABLE), "chunks", "chunk", n_parts(docs.sparkSession))


def per_word(table: DataFrame, vocabulary, work: Callable, ids: bool = False) -> DataFrame:
    """``work(splitter, word) -> bytes`` once per distinct word; rows of results by chunk.

    ids: results are 32-bit ids, and each row of results is followed by one of its different ids.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, known = WordSplitter(vocabulary.value), None, {}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("chunk", "bucket", "n", "a", "b", "c", "ids")}
            for row in batch.to_pylist():
                if row["bucket"] != at:  # sorted by bucket: the words of the one before come no more
                    at, known = row["bucket"], {}
                end = np.cumsum(_unpack(row["b"], np.uint32, row["n"])).tolist()
                results, begin = [], 0
                letters = pa.decompress(row["c"], end[-1], codec="zstd", asbytes=True)
                for e in end:
                    word = letters[begin:e]
                    begin = e
                    if word not in known:
                        known[word] = work(split, word.decode())
                    results.append(known[word])
                sizes, joined = np.fromiter(map(len, results), np.uint32, len(results)), b"".join(results)
                for k, v in zip(out, (row["chunk"], row["bucket"], row["n"], row["a"], _pack(sizes), joined, None), strict=True):
                    out[k].append(v)
                if ids:
                    for k, v in zip(out, (row["chunk"], row["bucket"], None, None, None, None, np.unique(np.frombuffer(joined, "<u4")).astype(np.int32)), strict=True):
                        out[k].append(v)
            kinds = {"chunk": pa.int64(), "bucket": pa.int32(), "n": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], list(out))

    words = table.filter(F.col("bucket") < DOCS).repartition(n_parts(table.sparkSession), "bucket")
    return words.sortWithinPartitions("bucket").mapInArrow(run, f"{_TABLE}, ids array<int>")


def named(results: DataFrame, names: DataFrame) -> DataFrame:
    """Results whose rows of ids became a row for each id, joined with ``names`` (id, name).

    ``names`` is as large as the vocabulary, whatever the corpus: that bounds what is broadcast.
    """
    rows = results.select("chunk", "n", "a", "b", "c", F.explode_outer("ids").alias("id"))
    return rows.join(F.broadcast(names), "id", "left")


def per_chunk(table: DataFrame, results: DataFrame, special: list[bytes], work: Callable, schema: str) -> DataFrame:
    """``work(meta, codes, times, results, names)`` for each chunk; results: bytes by code; names: of its ids, if ``named``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a row holds a whole chunk: one at a time
                row = batch.slice(at, 1).to_pylist()[0]
                meta, body = _read_ipc(row["a"]), _read_ipc(row["b"]).to_pylist()[0]
                found: list[bytes] = [b""] * meta.column("top")[0].as_py()
                found[: len(special)] = special
                for x in row["results"] or ():
                    begin = 0
                    for code, n in zip(np.cumsum(_unpack(x["a"], np.uint32, x["n"]), dtype=np.uint32).tolist(), _unpack(x["b"], np.uint32, x["n"]).tolist(), strict=True):
                        found[code] = x["c"][begin : begin + n]
                        begin += n
                codes = _unpack(body["lo"], np.uint16, row["n"]).astype(np.uint32) | (_unpack(body["hi"], np.uint16, row["n"]).astype(np.uint32) << 16)
                if body["kept"]:
                    codes = np.cumsum(codes, dtype=np.uint32)
                yield from work(meta, codes, _unpack(body["times"], np.uint32, body["kept"]), found, dict(zip(row["ids"] or (), row["names"] or (), strict=True)))

    # a chunk's results are bounded as the chunk is; its documents stay where they are
    if "id" not in results.columns:
        results = results.select("*", F.lit(None).cast("int").alias("id"), F.lit(None).cast("binary").alias("name"))
    found, asked = F.when(F.col("n").isNotNull(), F.struct("n", "a", "b", "c")), F.when(F.col("id").isNotNull(), F.struct("id", "name"))
    own = results.groupBy("chunk").agg(F.collect_list(found).alias("results"), F.collect_list(asked).alias("asked"))
    docs = table.filter(F.col("bucket") == DOCS).select("chunk", "n", "a", "b")
    both = docs.hint("merge").join(own, "chunk", "left")
    return both.select("n", "a", "b", "results", F.col("asked.id").alias("ids"), F.col("asked.name").alias("names")).mapInArrow(run, schema)
