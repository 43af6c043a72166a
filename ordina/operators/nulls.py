"""Dropping and filling nulls."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.compile import quoted
from ..schema import INT, REAL, TEXT

_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_WHOLE = re.compile(r"\s*([+-]?\d+)")


def all_present(names: Sequence[str]) -> Column:
    """True where none of the columns is null; NaN is not null."""
    return reduce(lambda a, b: a & b, (quoted(n).isNotNull() for n in names), F.lit(True))


def converted(value: Any, kind: str) -> int | float | str:
    """``value`` as a fill for a column: numbers print to text, texts are read up to their numeric prefix."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise TypeError(f"cannot fill with {value!r}")
    if kind == TEXT:
        return value if isinstance(value, str) else f"{value:f}" if isinstance(value, float) else str(value)
    if kind not in (INT, REAL):
        raise TypeError(f"a column of type {kind} cannot be filled with a number or a text")
    if isinstance(value, str):
        found = (_WHOLE if kind == INT else _NUMBER).match(value)
        if not found:
            raise ValueError(f"'{value}' does not begin with a number")
        value = int(found[1]) if kind == INT else float(found[1])
    return int(value) if kind == INT else float(value)


def filled(name: str, kind: str, value: Any) -> Column:
    return F.coalesce(quoted(name), F.lit(converted(value, kind)))
