"""Text, CSV and Parquet files for bulk loads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.storage import Store


def find(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a path with * ? [ ], sorted; an error if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(s.getPath().toString() for s in (found or []))
    if not names:
        raise FileNotFoundError(f"no file matches {pattern}")
    return names


_PIECE = r"\\x[0-9A-Fa-f]{1,2}|\\[0-7]{1,3}|\\.|[^\\]+|\\"
_SIMPLE = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def unescape(c: Column) -> Column:
    r"""Backslash escapes of text loads: \b \f \n \r \t \v, octal \ooo, hexadecimal \xhh, and \c for c itself."""

    def one(p: Column) -> Column:
        out = F.when(p.rlike(r"^\\x[0-9A-Fa-f]+$"), F.chr(F.conv(F.substring(p, 3, 2), 16, 10).cast("int")))
        out = out.when(p.rlike(r"^\\[0-7]+$"), F.chr(F.conv(F.substring(p, 2, 3), 8, 10).cast("int")))
        for k, v in _SIMPLE.items():
            out = out.when(p == F.lit("\\" + k), F.lit(v))
        return out.when(p.startswith("\\") & (F.length(p) > 1), F.substring(p, 2, 1)).otherwise(p)

    pieces = F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0))
    return F.when(c.contains("\\"), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def read_text(spark: SparkSession, pattern: str, schema: str, delimiter: str = "\t", null: str = "\\N", header: bool | str = False) -> DataFrame:
    """Delimited text with backslash escapes; header: True skips it, "match" also checks it."""
    kinds = T._parse_datatype_string(schema)
    paths = find(spark, pattern)
    lines = spark.read.text(paths)
    names = [f.name for f in kinds.fields]
    if header:
        # the first line of each file is the first row of the part that begins at byte 0
        lines = lines.select("value", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_from"), F.monotonically_increasing_id().alias("_row"))
        heads = lines.filter("_from = 0").groupBy("_file").agg(F.min_by("value", "_row").alias("head"), F.min("_row").alias("_row"))
        if header == "match":
            for r in heads.select("head").distinct().collect():
                if r["head"].split(delimiter) != names:
                    raise ValueError(f"the header {r['head'].split(delimiter)} does not match the columns {names}")
        lines = lines.join(F.broadcast(heads.select("_row")), "_row", "left_anti").select("value")
    # no line holds a line end, so it can stand for the delimiters after an even number of backslashes
    apart = r"(?<!\\)((?:\\\\)*+)" + re.escape(delimiter)
    parts = F.split(F.regexp_replace("value", apart, "$1\n"), "\n", -1)
    cols = []
    for i, n in enumerate(names):
        raw = F.get(F.col("_p"), F.lit(i))
        value = F.when(raw != F.lit(null), unescape(raw))
        cols.append(value.cast(kinds[n].dataType).alias(n))
    return lines.select(parts.alias("_p")).select(*cols)


def read_csv(spark: SparkSession, pattern: str, schema: str, delimiter: str = ",", null: str = "", header: bool | str = False) -> DataFrame:
    """Quoted CSV; fields may hold line ends."""
    reader = spark.read.schema(schema).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True)
    reader = reader.option("nullValue", null).option("header", bool(header)).option("enforceSchema", header != "match").option("mode", "FAILFAST").option("timestampNTZFormat", "yyyy-MM-dd['T'][ ]HH:mm:ss[.SSSSSS]")
    return reader.csv(find(spark, pattern))


def to_timestamp_by_magnitude(df: DataFrame, column: str) -> DataFrame:
    """A time from integers whose unit their size tells: seconds, milliseconds, microseconds or nanoseconds.

    The unit is settled once, by the first value that is not null.
    """
    one = df.select(column).filter(F.col(column).isNotNull()).limit(1).first()
    x = abs(one[0]) if one else 0
    c = F.col(column).cast("long")
    us = c * 1_000_000 if x < 10**12 else c * 1_000 if x < 10**15 else c if x < 10**18 else F.floor(c / 1_000).cast("long")
    return df.withColumn(column, F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))


def read_parquet(spark: SparkSession, pattern: str, time_col: str) -> DataFrame:
    """Parquet files; an integer time column becomes a timestamp, file by file."""
    out = None
    for path in find(spark, pattern):
        df = spark.read.parquet(path)
        name = next((c for c in df.columns if c.lower() == time_col.lower()), None)
        if name and isinstance(df.schema[name].dataType, (T.LongType, T.IntegerType)):
            df = to_timestamp_by_magnitude(df, name)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def load_text(store: Store, name: str, pattern: str, **options) -> int:
    return store.append(name, read_text(store.spark, pattern, store.catalog.load(name).schema, **options), make_slices=True)


def load_csv(store: Store, name: str, pattern: str, **options) -> int:
    return store.append(name, read_csv(store.spark, pattern, store.catalog.load(name).schema, **options), make_slices=True)


def load_parquet(store: Store, name: str, pattern: str) -> int:
    return store.append(name, read_parquet(store.spark, pattern, store.catalog.load(name).time_col), make_slices=True)
