"""Sessions with the settings the engine expects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Settings of a session; what Spark does by itself has none here."""

    app_name: str = "tidelake"
    master: str | None = None
    shuffle_partitions: int | None = None
    #: Rows of a row group in sealed slices.
    segment_rows: int = 30_000
    #: Read Parquet by the v2 source, which can answer counts and numeric extremes from footers.
    aggregate_pushdown: bool = True

    def settings(self) -> dict[str, str]:
        out = {
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.coalescePartitions.enabled": "true",
            "spark.sql.parquet.compression.codec": "zstd",
        }
        if self.aggregate_pushdown:
            out |= {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
        if self.shuffle_partitions:
            out["spark.sql.shuffle.partitions"] = str(self.shuffle_partitions)
        return out


def session(config: EngineConfig | None = None) -> SparkSession:
    config = config or EngineConfig()
    builder = SparkSession.builder.appName(config.app_name)
    if config.master:
        builder = builder.master(config.master)
    for k, v in config.settings().items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
