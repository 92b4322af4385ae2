"""Import summaries: the block of import lines at the top of a source file."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Longest summary, and how lines look.
SUMMARY_CAP = 1200
_PREAMBLE = re.compile(r"\s*($|#|//|/\*|\*|([\"'])use strict\2\s*$)")
_HEADING = re.compile(r"\s*(package|module)\s")
_GROUP = re.compile(r"\s*import\s*\(")
_IMPORT = re.compile(r"\s*(import\s*\(|import\s|use\s|from\s+\S+\s+import\b)")
_REEXPORT = re.compile(r"\s*export\s.*\bfrom\s+['\"]")
_DOCSTRING = re.compile(r"\s*(\"\"\"|''')")


def _skippable(line: str) -> bool:
    return bool(_PREAMBLE.match(line) or _HEADING.match(line))


def _after_docstring(lines: list[str]) -> list[str]:
    """Python lines after a module docstring, if one follows the preamble and is closed."""
    top = next((k for k, line in enumerate(lines) if not _skippable(line)), None)
    if top is None or not (mark := _DOCSTRING.match(lines[top])):
        return lines
    rest = lines[top][mark.end() :]
    for k, line in enumerate([rest, *lines[top + 1 :]]):
        if mark[1] in line:
            return lines[top + k + 1 :]
    return lines


def import_summary(content: str | None, path: str | None = "") -> str:
    """The contiguous import lines after comments, blank lines and headings, a parenthesized group
    included; at most SUMMARY_CAP characters, whole lines."""
    lines = (content or "").split("\n")
    if (path or "").lower().endswith((".py", ".pyi")):
        lines = _after_docstring(lines)
    start = next((k for k, line in enumerate(lines) if not _skippable(line)), len(lines))
    kept: list[str] = []
    size, depth = -1, 0
    for line in lines[start:]:
        if depth <= 0 and not (_IMPORT.match(line) or _REEXPORT.match(line)):
            break
        line, grouped = line.rstrip(), depth > 0 or _GROUP.match(line)
        size += 1 + len(line)
        if size > SUMMARY_CAP:
            break
        kept.append(line)
        depth = depth + line.count("(") - line.count(")") if grouped else 0
    return "\n".join(kept).strip()


@pandas_udf(StringType())
def _summaries(content: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([import_summary(c, p) for c, p in zip(content, path, strict=True)])


def summary(content: Column, path: Column) -> Column:
    return _summaries(content, path)
