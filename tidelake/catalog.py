"""The catalog: tables, their time slices, layouts and policies.

It is one JSON document a table, replaced as a whole: readers take the list of slices
from it and never from folders, so a slice is swapped by writing a new folder first and
the document last.  Folders and the document go through Hadoop's file system, so any
store that Spark writes will do.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import SparkSession

from tidelake.functions.time import interval_micros

_EPOCH = datetime(1970, 1, 1)
DEFAULT = "_default"


def micros(t: datetime) -> int:
    if t.tzinfo is not None:
        t = t.astimezone(UTC).replace(tzinfo=None)
    return (t - _EPOCH) // timedelta(microseconds=1)


def moment(us: int) -> datetime:
    return _EPOCH + timedelta(microseconds=us)


@dataclass
class Slice:
    """Half-open time range; start and end in microseconds since 1970 (none: the default slice)."""

    name: str
    start: int | None
    end: int | None
    sealed: bool = False
    #: Folders of data, and the columns they were written with.
    paths: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    rows: int | None = None
    raw_bytes: int = 0
    bytes: int = 0
    #: Sealed: column -> [min, max, sum, non-null] as far as the type has them.
    stats: dict[str, list] = field(default_factory=dict)


@dataclass
class Table:
    name: str
    schema: str
    time_col: str
    width: int
    root: str
    premake: int = 3
    segment_by: list[str] = field(default_factory=list)
    order_by: list[str] = field(default_factory=list)
    segment_rows: int = 30_000
    json_extract: list[dict] = field(default_factory=list)
    layout: bool = False
    compress_after: str | None = None
    drop_after: str | None = None
    #: Defaults of columns that came later: name -> SQL literal.
    defaults: dict[str, str] = field(default_factory=dict)
    slices: list[Slice] = field(default_factory=list)

    def slice_at(self, us: int) -> tuple[int, int]:
        """The range a moment falls into; ranges are aligned to 1970, also before it."""
        start = us // self.width * self.width
        return start, start + self.width

    def slice_name(self, start: int) -> str:
        shown = "%Y%m%d" if self.width % interval_micros("1 day") == 0 else "%Y%m%d_%H%M"
        return f"{self.name}_p{moment(start).strftime(shown)}"

    def find(self, name: str) -> Slice:
        for s in self.slices:
            if s.name == name:
                return s
        raise KeyError(f"no slice {name!r} in {self.name}")

    def ranged(self) -> list[Slice]:
        return sorted((s for s in self.slices if s.start is not None), key=lambda s: s.start)

    @property
    def default(self) -> Slice:
        return self.find(DEFAULT)


class Files:
    """Hadoop's file system, as far as the catalog needs it."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self._fs.exists(self._path(p))

    def delete(self, p: str) -> None:
        self._fs.delete(self._path(p), True)

    def size(self, p: str) -> int:
        return self._fs.getContentSummary(self._path(p)).getLength() if self.exists(p) else 0

    def names(self, p: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(p))] if self.exists(p) else []

    def read(self, p: str) -> str:
        stream = self._fs.open(self._path(p))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, p: str, text: str) -> None:
        """Replace a file: the new one appears whole or not at all."""
        temp = self._path(p + ".new")
        stream = self._fs.create(temp, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.delete(self._path(p), False)
        if not self._fs.rename(temp, self._path(p)):
            raise OSError(f"could not replace {p}")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def _file(self, name: str) -> str:
        return f"{self.root}/{name}.json"

    def tables(self) -> list[str]:
        return sorted(n[:-5] for n in self.files.names(self.root) if n.endswith(".json"))

    def has(self, name: str) -> bool:
        return self.files.exists(self._file(name)) or self.files.exists(self._file(name) + ".new")

    def load(self, name: str) -> Table:
        at = self._file(name)
        if not self.files.exists(at) and self.files.exists(at + ".new"):  # a replacement was cut short
            at += ".new"
        if not self.files.exists(at):
            raise KeyError(f"no table {name!r}")
        got = json.loads(self.files.read(at))
        got["slices"] = [Slice(**s) for s in got["slices"]]
        return Table(**got)

    def save(self, table: Table) -> None:
        self.files.write(self._file(table.name), json.dumps(asdict(table), default=str))
