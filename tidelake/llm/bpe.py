"""BPE encoding and decoding over a distinct-word table.

Texts are split into words; each distinct word is encoded once, and its ids are joined
back to every position it stands at.  The different ids of a chunk are joined with the
vocabulary's id -> piece table, and its words are spelled with the pieces found.

Defined cases: null is the empty text: no ids, empty decoding; special strings inside
a text are their own ids; repeated rows each get their own row; a null doc_id stays
null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import file_bytes, packaged, table
from tidelake.llm.distinct_words import WordSplitter, chunks, named, per_chunk, per_word

VOCABULARY = "word_bpe_49k.json"
_OUT_BYTES = 4 << 20


def _encode(split: WordSplitter, word: str) -> bytes:
    return np.array(split.pieces(word), "<u4").tobytes()


def id_pieces(spark: SparkSession, vocabulary: bytes) -> DataFrame:
    """The id -> piece table: as large as the vocabulary, whatever the corpus."""
    known = WordSplitter(vocabulary).library.get_vocab(with_added_tokens=True)
    rows = pa.table({"id": pa.array(known.values(), pa.int32()), "name": pa.array([p.encode() for p in known], pa.binary())})
    return spark.createDataFrame(rows)


def _assemble(special: dict[int, bytes]):
    """special: the strings that are their own pieces; all other pieces come from the join."""

    def run(meta: pa.RecordBatch, codes: np.ndarray, _times: np.ndarray, found: list[bytes], names: dict) -> Iterator[pa.RecordBatch]:
        piece = special | names
        spelled = [b" ".join([piece[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in found]
        at, doc_ids = 0, meta.column("doc_id").to_pylist()
        out: list[tuple] = []
        held = 0
        for doc, n in zip(doc_ids, meta.column("n").to_pylist(), strict=True):
            own = codes[at : at + n].tolist()
            at += n
            ids, decoded = b"".join([found[c] for c in own]), b" ".join([spelled[c] for c in own if spelled[c]])
            out.append((doc, ids, decoded.decode()))
            held += len(ids) + len(decoded)
            if held > _OUT_BYTES:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "ids", "decoded"])


def encode_decode(docs: DataFrame, vocabulary_path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded text of every row."""
    data, spark = file_bytes(vocabulary_path), docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(data)  # a vocabulary file: a few MB
    rows, added = chunks(docs, vocabulary, False, text, id_col), WordSplitter(data).special
    found = named(per_word(rows, vocabulary, _encode, ids=True), id_pieces(spark, data))
    special = [np.array([i], "<u4").tobytes() for _, i in added]
    return per_chunk(rows, found, special, _assemble({i: s.encode() for s, i in added}), "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, vocabulary_path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    got = encode_decode(docs, vocabulary_path, text, id_col)
    n = F.expr("octet_length(ids) div 4").cast("long")
    return got.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), packaged(VOCABULARY))
