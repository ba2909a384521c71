"""Time-sliced tables: create, write, seal, read with pruning, drain, retain, change columns.

Open slices are plain appended Parquet.  Sealing sorts a slice by ``segment_by`` and
``order_by`` into row groups of ``segment_rows``, with Bloom filters on the key columns
and a row of statistics in the catalog; sealed slices are read-only.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.catalog import DEFAULT, Catalog, Slice, Table, micros, moment
from tidelake.functions.json import leaves, with_leaves
from tidelake.functions.time import interval_micros
from tidelake.functions.time import micros as micros_of

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_TIMES = (T.TimestampNTZType, T.TimestampType, T.DateType)


class ReadOnlyError(ValueError):
    """A sealed slice was to be written."""


class Store:
    """Tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.catalog = spark, Catalog(spark, root)

    # -- creation -------------------------------------------------------------------------------

    def create_table(self, name: str, schema: str, time_col: str, width: str = "1 day", premake: int = 3, now: datetime | None = None) -> str:
        """Register a table with one past slice, the current one, ``premake`` coming ones and a default slice."""
        if self.catalog.has(name):
            return f"{name} is already registered"
        kinds = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields} if isinstance(schema, str) else {}
        if time_col not in kinds:
            raise ValueError(f"no column {time_col!r}")
        if not isinstance(kinds[time_col], (T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"{time_col} is not a timestamp")
        if not 0 < interval_micros(width):
            raise ValueError("the width must be positive")
        table = Table(name, schema, time_col, interval_micros(width), f"{self.catalog.root}/{name}", premake)
        table.slices.append(Slice(DEFAULT, None, None))
        self._premake(table, now or datetime.utcnow(), past=1)
        self.catalog.save(table)
        return f"{name} is registered"

    def _add(self, table: Table, start: int) -> Slice:
        name = table.slice_name(start)
        found = next((s for s in table.slices if s.name == name), None)
        if found is None:
            found = Slice(name, start, start + table.width)
            table.slices.append(found)
        return found

    def _premake(self, table: Table, now: datetime, past: int = 0) -> None:
        at = table.slice_at(micros(now))[0]
        for k in range(-past, table.premake + 1):
            self._add(table, at + k * table.width)

    # -- writing --------------------------------------------------------------------------------

    def _us(self, table: Table) -> Column:
        c = F.col(table.time_col)
        return micros_of(c.cast("timestamp_ntz"))

    def _routed(self, table: Table, df: DataFrame, spread: bool) -> DataFrame:
        """Rows with ``_start``, the start of their slice; without a slice, or with spread=False, null."""
        us = self._us(table)
        start = us - F.pmod(us, F.lit(table.width).cast("long"))
        if not spread:
            start = F.when(start.isin([s.start for s in table.ranged()]), start)
        return df.withColumn("_start", start)

    def append(self, name: str, df: DataFrame, make_slices: bool = False) -> int:
        """Write rows to their slices; those of no slice go to the default one (or, with make_slices, to new ones)."""
        table = self.catalog.load(name)
        df = self._fitting(table, df)
        rows = self._routed(table, df, make_slices)
        out = f"{table.root}/in-{uuid.uuid4().hex}"
        rows.repartition("_start").write.partitionBy("_start").parquet(out)
        parts = [n.split("=", 1)[1] for n in self.catalog.files.names(out) if n.startswith("_start=")]
        targets = {p: None if p.startswith("__HIVE") else int(p) for p in parts}
        sealed = {s.start for s in table.slices if s.sealed}
        if any(t in sealed for t in targets.values()):
            self.catalog.files.delete(out)
            raise ReadOnlyError(f"{name}: rows fall into sealed slices")
        for p, start in targets.items():
            s = table.default if start is None else self._add(table, start)
            s.paths.append(f"{out}/_start={p}")
            s.columns = s.columns or df.columns
        self.catalog.save(table)
        return len(parts)

    def delete_where(self, name: str, condition: Column | str) -> None:
        self.rewrite(name, lambda df: df.filter(~F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))))

    def rewrite(self, name: str, change) -> None:
        """Replace every slice by ``change`` of its rows; refused where a slice is sealed."""
        table = self.catalog.load(name)
        if any(s.sealed for s in table.slices):
            raise ReadOnlyError(f"{name}: sealed slices are read-only")
        for s in [s for s in table.slices if s.paths]:
            self._replace(table, s, change(self._slice_frame(table, s)))
        self.catalog.save(table)

    def _replace(self, table: Table, s: Slice, df: DataFrame) -> None:
        out = f"{table.root}/{s.name}-{uuid.uuid4().hex}"
        df.write.parquet(out)
        s.paths, s.columns = [out], df.columns

    def _schema(self, table: Table) -> T.StructType:
        return T._parse_datatype_string(table.schema)

    def _fitting(self, table: Table, df: DataFrame) -> DataFrame:
        """Columns of the table by name (case-insensitive if need be); extra ones are dropped, missing ones an error unless they have a default."""
        own = {c: c for c in df.columns}
        low = {c.lower(): c for c in df.columns}
        out = []
        for f in self._schema(table).fields:
            c = own.get(f.name) or low.get(f.name.lower())
            if c is not None:
                out.append(F.col(f"`{c}`").cast(f.dataType).alias(f.name))
            elif f.name in table.defaults:
                out.append(F.expr(table.defaults[f.name]).cast(f.dataType).alias(f.name))
            elif f.name in table.segment_by:
                out.append(F.lit(None).cast(f.dataType).alias(f.name))
            else:
                raise ValueError(f"column {f.name!r} is missing")
        return df.select(*out)

    # -- sealing --------------------------------------------------------------------------------

    def set_layout(self, name: str, segment_by: list[str] | None = None, order_by: list[str] | None = None, segment_rows: int = 30_000, json_extract: list[dict] | None = None) -> None:
        table = self.catalog.load(name)
        columns = [f.name for f in self._schema(table).fields]
        for c in [*(segment_by or []), *(order_by or [])]:
            if c not in columns:
                raise ValueError(f"no column {c!r}")
        leaves(json_extract or [], columns)
        table.segment_by, table.order_by = segment_by or [], order_by or [table.time_col]
        table.segment_rows, table.json_extract, table.layout = segment_rows, json_extract or [], True
        self.catalog.save(table)

    def seal(self, name: str, slice_name: str) -> bool:
        """Rewrite one slice as sealed; false if it is already or is empty."""
        table = self.catalog.load(name)
        if not table.layout:
            raise ValueError(f"{name} has no layout")
        s = table.find(slice_name)
        if s.start is None:
            raise ValueError("the default slice is never sealed")
        if s.sealed or not s.paths:
            return False
        files = self.catalog.files
        s.raw_bytes = sum(files.size(p) for p in s.paths)
        spec = leaves(table.json_extract, [f.name for f in self._schema(table).fields])
        df = with_leaves(self._slice_frame(table, s), spec)
        keys = [*table.segment_by, *table.order_by]
        out = f"{table.root}/{s.name}-sealed-{uuid.uuid4().hex}"
        writer = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).write.option("parquet.block.row.count.limit", table.segment_rows)
        for c in table.segment_by:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(out)
        s.paths, s.columns, s.sealed = [out], df.columns, True
        s.stats = self._stats(self.spark.read.parquet(out))
        s.rows, s.bytes = s.stats.pop("*"), files.size(out)
        self.catalog.save(table)
        return True

    def _stats(self, df: DataFrame) -> dict:
        exact: list[Column] = [F.count(F.lit(1)).alias("n")]
        kept = []
        for i, f in enumerate(df.schema.fields):
            if isinstance(f.dataType, (*_NUMBERS, *_TIMES, T.StringType)):
                kept.append((i, f))
                c = F.col(f"`{f.name}`")
                ends = micros_of(c.cast("timestamp_ntz")) if isinstance(f.dataType, _TIMES) else c
                exact += [F.min(ends).alias(f"a{i}"), F.max(ends).alias(f"b{i}"), F.count(c).alias(f"k{i}")]
                if isinstance(f.dataType, _NUMBERS):
                    wide = c.cast("double") if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c.cast("decimal(38,0)")
                    exact.append(F.sum(wide).alias(f"s{i}"))
        row = df.agg(*exact).first().asDict()
        out: dict = {"*": row["n"]}
        for i, f in kept:
            s = row.get(f"s{i}")
            out[f.name] = [row[f"a{i}"], row[f"b{i}"], None if s is None else float(s) if isinstance(s, float) else int(s), row[f"k{i}"]]
        return out

    def seal_closed(self, name: str, now: datetime, older_than: str | None = None) -> list[str]:
        """Seal all slices that ended by now (less ``older_than``)."""
        table = self.catalog.load(name)
        edge = micros(now) - (interval_micros(older_than) if older_than else 0)
        return [s.name for s in table.ranged() if s.end <= edge and not s.sealed and s.paths and self.seal(name, s.name)]

    def unseal(self, name: str, slice_name: str) -> bool:
        table = self.catalog.load(name)
        s = table.find(slice_name)
        if not s.sealed:
            return False
        columns = [f.name for f in self._schema(table).fields]
        self._replace(table, s, self._slice_frame(table, s).select(*columns))
        s.sealed, s.stats, s.rows, s.raw_bytes, s.bytes = False, {}, None, 0, 0
        self.catalog.save(table)
        return True

    # -- reading --------------------------------------------------------------------------------

    def _slice_frame(self, table: Table, s: Slice, hidden: bool = False) -> DataFrame:
        """A slice's rows with the table's present columns; those it was written without get their defaults."""
        df = self.spark.read.parquet(*s.paths)
        out = []
        for f in self._schema(table).fields:
            if f.name in s.columns:
                out.append(F.col(f.name).cast(f.dataType).alias(f.name))
            else:
                out.append(F.expr(table.defaults.get(f.name, "null")).cast(f.dataType).alias(f.name))
        if hidden:
            out += [F.col(x["name"]) for x in table.json_extract]
        return df.select(*out)

    def slices_between(self, name: str, start: datetime | None = None, end: datetime | None = None) -> list[Slice]:
        """Slices that can hold rows of [start, end): ranged ones by their range, sealed ones by their statistics too."""
        table = self.catalog.load(name)
        lo, hi = (None if t is None else micros(t) for t in (start, end))
        out = []
        for s in table.slices:
            if not s.paths:
                continue
            a, b = s.start, None if s.end is None else s.end - 1
            if s.sealed and (x := s.stats.get(table.time_col)) and x[0] is not None:
                a, b = x[0], x[1]
            if (lo is not None and b is not None and b < lo) or (hi is not None and a is not None and a >= hi):
                continue
            out.append(s)
        return out

    def read(self, name: str, start: datetime | None = None, end: datetime | None = None, json_columns: bool = False) -> DataFrame:
        """The table, or its rows in [start, end): only slices that can hold such rows are read.

        json_columns: also the columns taken out of JSON (all slices read must be sealed).
        """
        table = self.catalog.load(name)
        found = self.slices_between(name, start, end)
        if json_columns and not all(s.sealed for s in found):
            raise ValueError("columns taken out of JSON exist in sealed slices only")
        # slices written with the same columns are one scan
        groups: dict[tuple, Slice] = {}
        for s in found:
            key = tuple(s.columns)
            if key in groups:
                groups[key].paths = groups[key].paths + s.paths
            else:
                groups[key] = Slice(s.name, s.start, s.end, s.sealed, list(s.paths), s.columns)
        df = None
        for s in groups.values():
            one = self._slice_frame(table, s, json_columns)
            df = one if df is None else df.unionByName(one)
        if df is None:
            df = self.spark.createDataFrame([], self._schema(table))
        c = F.col(table.time_col)
        kind = self._schema(table)[table.time_col].dataType.simpleString()
        if start is not None:
            df = df.filter(c >= F.lit(str(moment(micros(start)))).cast(kind))
        if end is not None:
            df = df.filter(c < F.lit(str(moment(micros(end)))).cast(kind))
        return df

    def newest(self, name: str, n: int) -> DataFrame:
        """The n latest rows: slices are taken from the newest on, only until they hold n rows by the catalog."""
        table = self.catalog.load(name)
        took, have = [table.default] if table.default.paths else [], 0
        for s in reversed(table.ranged()):
            if have >= n:
                break
            if s.paths:
                took.append(s)
                have += s.rows or 0
        df = None
        for s in took:
            one = self._slice_frame(table, s)
            df = one if df is None else df.unionByName(one)
        df = df if df is not None else self.spark.createDataFrame([], self._schema(table))
        return df.orderBy(F.col(table.time_col).desc_nulls_last()).limit(n)

    def aggregate(self, name: str, column: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """n_rows, n, min, max and sum of a column over [start, end).

        Sealed slices that lie wholly inside are answered by the catalog; only the others are scanned.
        """
        table = self.catalog.load(name)
        lo, hi = (None if t is None else micros(t) for t in (start, end))
        field = self._schema(table)[column]
        time = isinstance(field.dataType, _TIMES)
        known, scan = [], []
        for s in self.slices_between(name, start, end):
            x = s.stats.get(table.time_col) if s.sealed else None
            inside = x and x[3] == s.rows and (lo is None or x[0] >= lo) and (hi is None or x[1] < hi)
            (known if inside and column in s.stats else scan).append(s)
        c = F.col(column)
        ends = micros_of(c.cast("timestamp_ntz")) if time else c
        kind = "long" if time else field.dataType.simpleString()
        total = "double" if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else "decimal(38,0)"
        number = isinstance(field.dataType, _NUMBERS)
        schema = f"n_rows long, n long, lo {kind}, hi {kind}, s {total}"
        from decimal import Decimal

        rows = [(s.rows, s.stats[column][3], s.stats[column][0], s.stats[column][1], None if s.stats[column][2] is None else float(s.stats[column][2]) if total == "double" else Decimal(s.stats[column][2])) for s in known]
        df = self.spark.createDataFrame(rows, schema)
        for s in scan:
            one = self._slice_frame(table, s)
            us = self._us(table)
            if lo is not None:
                one = one.filter(us >= lo)
            if hi is not None:
                one = one.filter(us < hi)
            df = df.union(one.agg(F.count(F.lit(1)), F.count(c), F.min(ends).cast(kind), F.max(ends).cast(kind), F.sum(c.cast(total)) if number else F.lit(None).cast(total)))
        out = df.agg(F.coalesce(F.sum("n_rows"), F.lit(0).cast("long")).alias("n_rows"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("s").alias("sum"))
        if time:
            from tidelake.functions.time import micros_to_timestamp

            out = out.withColumns({k: micros_to_timestamp(k).cast(field.dataType) for k in ("min", "max")})
        return out

    # -- information ----------------------------------------------------------------------------

    def _shown(self, us: int | None) -> datetime | None:
        return None if us is None else moment(us)

    def slice_info(self, name: str) -> DataFrame:
        rows = [(s.name, self._shown(s.start), self._shown(s.end), s.sealed) for s in self.catalog.load(name).slices]
        return self.spark.createDataFrame(rows, "name string, range_start timestamp_ntz, range_end timestamp_ntz, sealed boolean")

    def table_info(self) -> DataFrame:
        rows = []
        for name in self.catalog.tables():
            t = self.catalog.load(name)
            rows.append((t.name, t.time_col, t.width, len(t.slices), t.segment_by, t.order_by, t.segment_rows, t.compress_after, t.drop_after))
        return self.spark.createDataFrame(rows, "name string, time_col string, width_us long, slices int, segment_by array<string>, order_by array<string>, segment_rows int, compress_after string, drop_after string")

    def compression_stats(self, name: str) -> DataFrame:
        rows = [(s.name, s.sealed, s.raw_bytes, s.bytes, s.raw_bytes / s.bytes if s.bytes else None, s.rows) for s in self.catalog.load(name).slices]
        return self.spark.createDataFrame(rows, "name string, sealed boolean, raw_bytes long, bytes long, ratio double, rows long")

    def table_size(self, name: str) -> int:
        return sum(self.catalog.files.size(p) for s in self.catalog.load(name).slices for p in s.paths)

    def analyze(self, name: str, slice_name: str | None = None) -> None:
        """Refresh row counts and statistics of sealed slices."""
        table = self.catalog.load(name)
        for s in table.slices:
            if s.sealed and slice_name in (None, s.name):
                s.stats = self._stats(self.spark.read.parquet(*s.paths))
                s.rows = s.stats.pop("*")
        self.catalog.save(table)

    # -- maintenance ----------------------------------------------------------------------------

    def drain_default(self, name: str) -> int:
        """Move rows of the default slice to slices of their own; rows for sealed slices, and without a time, stay. Returns slices fed."""
        table = self.catalog.load(name)
        if not table.default.paths:
            return 0
        df = self._slice_frame(table, table.default)
        sealed = [s.start for s in table.slices if s.sealed]
        start = F.col("_start")
        rows = self._routed(table, df, True).withColumn("_start", F.when(~start.isin(sealed), start) if sealed else start)
        out = f"{table.root}/in-{uuid.uuid4().hex}"
        rows.repartition("_start").write.partitionBy("_start").parquet(out)
        table.default.paths, fed = [], 0
        for n in self.catalog.files.names(out):
            if n.startswith("_start=__HIVE"):
                table.default.paths = [f"{out}/{n}"]
                table.default.columns = df.columns
            elif n.startswith("_start="):
                s = self._add(table, int(n.split("=", 1)[1]))
                s.paths.append(f"{out}/{n}")
                s.columns = s.columns or df.columns
                fed += 1
        self.catalog.save(table)
        return fed

    def set_retention(self, name: str, drop_after: str) -> None:
        table = self.catalog.load(name)
        self._past(datetime(2000, 1, 1), drop_after)
        table.drop_after = drop_after
        self.catalog.save(table)

    def remove_retention(self, name: str) -> None:
        table = self.catalog.load(name)
        table.drop_after = None
        self.catalog.save(table)

    def set_compression_policy(self, name: str, after: str) -> None:
        table = self.catalog.load(name)
        if not table.layout:
            raise ValueError(f"{name} has no layout")
        interval_micros(after)
        table.compress_after = after
        self.catalog.save(table)

    @staticmethod
    def _past(now: datetime, interval: str) -> datetime:
        """now less an interval; months count by the calendar."""
        months = sum(int(n) * (12 if u.startswith("year") else 1) for n, u in re.findall(r"(-?\d+)\s*(years?|months?)", interval))
        rest = re.sub(r"(-?\d+)\s*(years?|months?)", "", interval).strip()
        if months:
            y, m = divmod(now.year * 12 + now.month - 1 - months, 12)
            last = [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]
            now = now.replace(year=y, month=m + 1, day=min(now.day, last))
        return moment(micros(now) - (interval_micros(rest) if rest else 0))

    def drop_expired(self, name: str, now: datetime) -> list[str]:
        """Drop slices that ended before now less the retention."""
        table = self.catalog.load(name)
        if not table.drop_after:
            return []
        edge = micros(self._past(now, table.drop_after))
        gone = [s for s in table.ranged() if s.end < edge]
        table.slices = [s for s in table.slices if s not in gone]
        self.catalog.save(table)
        for s in gone:
            for p in s.paths:
                self.catalog.files.delete(p)
        return [s.name for s in gone]

    def maintain(self, name: str, now: datetime) -> dict:
        """One round: drain, make coming slices, seal by policy, drop by retention, in this order."""
        out: dict = {"drained": self.drain_default(name)}
        table = self.catalog.load(name)
        self._premake(table, now)
        self.catalog.save(table)
        out["sealed"] = []
        if table.compress_after:
            edge = micros(now) - interval_micros(table.compress_after)
            out["sealed"] = [s.name for s in table.ranged() if s.end < edge and not s.sealed and s.paths and self.seal(name, s.name)]
        out["dropped"] = self.drop_expired(name, now)
        return out

    # -- columns --------------------------------------------------------------------------------

    _FIXED_DEFAULT = re.compile(r"(?i)^(null|true|false|[-+]?\d+(\.\d+)?|'([^']|'')*'|date '[^']*'|timestamp(_ntz)? ?'[^']*')$")

    def add_column(self, name: str, column: str, kind: str, default: str | None = None, not_null: bool = False) -> None:
        """Older slices show the default, by their recorded columns and not by nulls; only constants can be defaults."""
        table = self.catalog.load(name)
        fields = self._schema(table).fields
        if column.lower() in [f.name.lower() for f in fields]:
            raise ValueError(f"column {column!r} exists")
        if default is not None and not self._FIXED_DEFAULT.match(default.strip()):
            raise ValueError(f"{default!r} is not a constant")
        if not_null and (default is None or default.strip().lower() == "null") and any(s.sealed for s in table.slices):
            raise ValueError("a column that must not be null needs a default where slices are sealed")
        T._parse_datatype_string(f"`{column}` {kind}")
        table.schema += f", `{column}` {kind}"
        table.defaults[column] = default if default is not None else "null"
        self.catalog.save(table)

    def _check_free(self, table: Table, column: str) -> None:
        if column not in [f.name for f in self._schema(table).fields]:
            raise ValueError(f"no column {column!r}")
        if column == table.time_col or column in table.segment_by or column in table.order_by or column in [x["src"] for x in table.json_extract]:
            raise ValueError(f"{column} is part of the layout")

    def drop_column(self, name: str, column: str) -> None:
        table = self.catalog.load(name)
        self._check_free(table, column)
        table.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._schema(table).fields if f.name != column)
        table.defaults.pop(column, None)
        for s in table.slices:  # a later column of this name must not show the old data
            s.columns = [f"-{column}" if c == column else c for c in s.columns]
        self.catalog.save(table)

    def rename_column(self, name: str, old: str, new: str) -> None:
        """Open slices are rewritten; refused where a slice is sealed."""
        table = self.catalog.load(name)
        self._check_free(table, old)
        if new.lower() in [f.name.lower() for f in self._schema(table).fields]:
            raise ValueError(f"column {new!r} exists")
        if any(s.sealed for s in table.slices):
            raise ReadOnlyError("sealed slices keep their column names: unseal them first")
        frames = [(s, self._slice_frame(table, s).withColumnRenamed(old, new)) for s in table.slices if s.paths]
        table.schema = ", ".join(f"`{new if f.name == old else f.name}` {f.dataType.simpleString()}" for f in self._schema(table).fields)
        if old in table.defaults:
            table.defaults[new] = table.defaults.pop(old)
        for s, df in frames:
            self._replace(table, s, df)
        self.catalog.save(table)

    def alter_column(self, *_args, **_kw) -> None:
        raise ValueError("types of columns cannot be changed")
