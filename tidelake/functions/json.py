"""JSON leaves: reading paths, and typed columns taken out of documents at load time."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types a leaf can be given.
TYPES = {"smallint": "short", "int": "int", "integer": "int", "bigint": "long", "real": "float", "float": "double", "double": "double", "boolean": "boolean", "text": "string", "timestamp": "timestamp_ntz", "date": "date"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dollar(path: tuple[str, ...] | list[str]) -> str:
    return "$" + "".join(f"['{p}']" for p in path)


def json_path(c: Column | str, *path: str) -> Column:
    """The value at a path as JSON text (strings without quotes), null if missing."""
    return F.get_json_object(_col(c), _dollar(path))


def json_text(c: Column | str, *path: str) -> Column:
    """As text; numbers and booleans are spelled out."""
    return json_path(c, *path)


def contains_all(c: Column | str, path: tuple[str, ...], wanted: list[str]) -> Column:
    """Whether the array of strings at a path holds all of ``wanted``."""
    found = F.from_json(json_path(c, *path), "array<string>")
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), found)) == 0


def extract_leaf(c: Column | str, path: tuple[str, ...] | list[str], kind: str) -> Column:
    """A typed leaf; missing, null, malformed, wrong in type or out of range is null.

    Integers take numbers and numeric strings, floats numbers only, booleans booleans
    only, times and dates strings only, text any scalar.
    """
    raw = F.get_json_object(_col(c), _dollar(path))
    shown = F.try_variant_get(F.try_parse_json(_col(c)), _dollar(path), "variant")
    what = F.schema_of_variant(shown)
    number = what.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    if kind in ("smallint", "int", "integer", "bigint"):
        ok = (number & raw.rlike(r"^-?\d+$")) | ((what == "STRING") & raw.rlike(r"^\s*[-+]?\d+\s*$"))
        return F.when(ok, F.trim(raw).try_cast(TYPES[kind]))
    if kind in ("real", "float", "double"):
        return F.when(number, raw.try_cast(TYPES[kind]))
    if kind == "boolean":
        return F.when(what == "BOOLEAN", raw.try_cast("boolean"))
    if kind in ("timestamp", "date"):
        return F.when(what == "STRING", raw.try_cast(TYPES[kind]))
    if kind == "text":
        return F.when(number | what.isin("STRING", "BOOLEAN"), raw)
    raise ValueError(f"unknown type {kind!r}")


@dataclass(frozen=True)
class Leaf:
    """One column to take out of a JSON column."""

    src: str
    path: tuple[str, ...]
    name: str
    type: str


def leaves(spec: list[dict], columns: list[str]) -> list[Leaf]:
    """A checked specification: [{src, path, name, type}]."""
    out: list[Leaf] = []
    if not isinstance(spec, list):
        raise ValueError("the specification must be a list")
    for x in spec:
        if not isinstance(x, dict) or set(x) != {"src", "path", "name", "type"}:
            raise ValueError(f"expected src, path, name and type: {x!r}")
        if x["src"] not in columns:
            raise ValueError(f"no column {x['src']!r}")
        if not isinstance(x["path"], list) or not x["path"] or not all(isinstance(p, str) and p and "'" not in p for p in x["path"]):
            raise ValueError(f"a path is a list of names, not {x['path']!r}")
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", x["name"]) or x["name"] in columns or x["name"] in {o.name for o in out}:
            raise ValueError(f"not a new column name: {x['name']!r}")
        if x["type"] not in TYPES:
            raise ValueError(f"unknown type {x['type']!r}")
        out.append(Leaf(x["src"], tuple(x["path"]), x["name"], x["type"]))
    return out


def with_leaves(df: DataFrame, spec: list[Leaf]) -> DataFrame:
    return df.withColumns({x.name: extract_leaf(x.src, x.path, x.type) for x in spec})


def resolve(spec: list[Leaf], src: str, *path: str) -> Column:
    """The leaf's own column if it has been taken out, else the path read from the document."""
    found = next((x for x in spec if x.src == src and x.path == path), None)
    return F.col(found.name) if found else json_text(src, *path)
