"""What a plan reads and moves, as data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def summary(df: DataFrame) -> dict:
    """Scans (columns read, filters and aggregates given to them, files), exchanges, joins and Python steps of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()

    def found(what: str) -> list[list[str]]:
        return [[x for x in re.split(r", (?![^(]*\))", m) if x] for m in re.findall(rf"{what}: \[([^\]]*)\]", plan)]

    return {
        "columns": [re.findall(r"(\w+):", m) for m in re.findall(r"ReadSchema: struct<([^\n]*)>", plan)],
        "pushed_filters": found("PushedFilters"),
        "partition_filters": found("PartitionFilters"),
        "pushed_aggregates": found("PushedAggregation"),
        "files": len(df.inputFiles()),
        "exchanges": len(re.findall(r"(?<!Broadcast)Exchange ", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "joins": re.findall(r"(\w*(?:Join|CartesianProduct)\w*) ", plan),
        "python": len(re.findall(r"Python|Pandas|Arrow", plan)),
    }


def cost(df: DataFrame) -> str:
    """The optimizer's plan with its row and size estimates."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost"))
