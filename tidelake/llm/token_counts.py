"""Token counts without token ids: pieces per distinct pre-token, summed over frequencies.

Each document is its pre-tokens' frequencies; the number of pieces of a pre-token is
found once per distinct pre-token and joined to them.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings inside
a text count as one token each, as in the library's default; repeated rows each get
their own row; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import file_bytes, packaged, table
from tidelake.llm.distinct_words import WordSplitter, chunks, per_chunk, per_word

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024


def _count(split: WordSplitter, word: str) -> bytes:
    return len(split.pieces(word)).to_bytes(4, "little")


def _sum(meta: pa.RecordBatch, codes: np.ndarray, times: np.ndarray, found: list[bytes], _names: dict) -> Iterator[pa.RecordBatch]:
    pieces = np.frombuffer(b"".join(found), np.uint32).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(meta.column("n").to_numpy())])
    sums = np.concatenate([[0], np.cumsum(pieces[codes] * times)])
    yield pa.RecordBatch.from_pydict({"doc_id": meta.column("doc_id"), "n_bytes": meta.column("n_bytes"), "n_tokens": sums[ends[1:]] - sums[ends[:-1]]})


def token_counts(docs: DataFrame, vocabulary_path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    data = file_bytes(vocabulary_path)
    vocabulary = docs.sparkSession.sparkContext.broadcast(data)  # a vocabulary file: a few MB
    rows = chunks(docs, vocabulary, True, text, id_col)
    one = [(1).to_bytes(4, "little")] * len(WordSplitter(data).special)
    return per_chunk(rows, per_word(rows, vocabulary, _count), one, _sum, "doc_id long, n_bytes long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"), packaged(VOCABULARY))
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
