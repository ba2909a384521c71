"""A corpus from documents to token ids: what each stage drops is gone for the next.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all
their columns; the last returns one row per document that is left, with its token ids'
and its decoded text's digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelake.llm.bpe import VOCABULARY, digests
from tidelake.llm.common import materialize, packaged, table
from tidelake.llm.decontaminate import decontaminate
from tidelake.llm.exact_dedup import exact_dedup
from tidelake.llm.lang_id import keep_identified
from tidelake.llm.near_dedup import near_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language cannot be told, go."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (links from 0.8 on) one document stays."""
    return near_dedup(docs, threshold=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of any benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), least_items=1)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left."""
    return digests(docs, packaged(VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", benchmark_free),
    ("bpe", bpe),
]

#: Language ID and MinHash bands are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
