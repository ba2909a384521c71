"""Registering queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    def __init__(self) -> None:
        self.entries: dict[str, tuple[Callable, str | None]] = {}

    def same(self, name: str, sql: str) -> None:
        """One text that both engines take."""
        self.sql(name, sql, sql)

    def sql(self, name: str, spark_sql: str, oracle: str | None) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            used = {t: read(spark, sf_dir, t) for t in TABLES if t in spark_sql}
            for t, df in used.items():
                df.createOrReplaceTempView(t)
            return spark.sql(spark_sql)

        self.entries[name] = (run, oracle)

    def frame(self, name: str, oracle: str | None = None) -> Callable:
        """Decorator for a function of (spark, load) with load(name) -> DataFrame."""

        def take(f: Callable) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(spark, lambda t: read(spark, sf_dir, t))

            self.entries[name] = (run, oracle)
            return f

        return take
