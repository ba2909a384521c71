"""Text patterns of other SQL dialects, for Java's regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLASSES = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "space": r"\s", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def posix_classes(pattern: str) -> str:
    return re.sub(r"\[:(\w+):\]", lambda m: _CLASSES[m[1]], pattern)


def similar_regex(pattern: str, escape: str = "\\") -> str:
    """The regular expression of a SIMILAR TO pattern: % and _ are wildcards, the whole text must match."""
    out, i, in_class = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            out += re.escape(pattern[i + 1])
            i += 2
            continue
        if in_class:
            if named := re.match(r"\[:(\w+):\]", pattern[i:]):
                out += _CLASSES[named[1]]
                i += len(named[0])
                continue
            in_class = c != "]"
            out += c
        elif c == "[":
            in_class = True
            out += c
        elif c == "%":
            out += ".*"
        elif c == "_":
            out += "."
        elif c in "|*+?{}()":
            out += c
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^(?:{out})\\z"


def similar_to(c: Column | str, pattern: str, escape: str = "\\") -> Column:
    return _col(c).rlike(similar_regex(pattern, escape))


def java_pattern(pattern: str) -> str:
    """Dot matches line ends, and a final $ only the very end."""
    pattern = posix_classes(pattern)
    if pattern.endswith("$") and not pattern.endswith("\\$"):
        pattern = pattern[:-1] + r"\z"
    return "(?s)" + pattern


def replace_first(c: Column | str, pattern: str, replacement: str) -> Column:
    r"""Replace the first match only; ``\1`` in the replacement is the first group."""
    pattern = java_pattern(pattern)[4:]
    put = re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + 1}", replacement.replace("$", r"\$"))
    if pattern.startswith("^"):
        return F.regexp_replace(_col(c), f"(?s)^()(?:{pattern[1:]})", put)
    return F.regexp_replace(_col(c), f"(?s)^(.*?)(?:{pattern})", "$1" + put)
