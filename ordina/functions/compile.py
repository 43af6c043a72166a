"""Type checks expressions against a schema and compiles them to Catalyst columns."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import INT, REAL, TEXT, TIME
from .expr import Choice, ColumnRef, ExpressionError, Literal, Logic, Operation, Predicate, Test, TimeLiteral, Value

Typed = tuple[Column, str]

_NUMERIC = (INT, REAL)
_PARTS = {"day": F.dayofmonth, "month": F.month, "year": F.year}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def references(node: Value | Predicate) -> list[str]:
    """Names of all columns that the tree mentions, in any branch, each once."""
    if isinstance(node, ColumnRef):
        return [node.name]
    below = (node.condition, node.on_true, node.on_false) if isinstance(node, Choice) else getattr(node, "arguments", ())
    return list(dict.fromkeys(name for x in below for name in references(x)))


def present(node: Value | Predicate) -> Column:
    """True where no column that the tree mentions is null."""
    return reduce(lambda a, b: a & b, (quoted(n).isNotNull() for n in references(node)), F.lit(True))


def compile_value(node: Value, kinds: Mapping[str, str]) -> Typed:
    if isinstance(node, ColumnRef):
        if node.name not in kinds:
            raise ExpressionError(f"Column '{node.name}' does not exist.")
        if kinds[node.name] not in (INT, REAL, TEXT, TIME):
            raise ExpressionError(f"expressions cannot use the type {kinds[node.name]} of column '{node.name}'")
        return quoted(node.name), kinds[node.name]
    if isinstance(node, Literal):
        kind = INT if isinstance(node.value, int) else REAL if isinstance(node.value, float) else TEXT
        return F.lit(node.value).cast({INT: "long", REAL: "double", TEXT: "string"}[kind]), kind
    if isinstance(node, TimeLiteral):
        at = datetime(1970, 1, 1) + timedelta(microseconds=node.ns // 1000)
        return F.expr(f"TIMESTAMP_NTZ '{at.isoformat(' ', 'microseconds')}'"), TIME
    if isinstance(node, Choice):
        (a, ka), (b, kb) = compile_value(node.on_true, kinds), compile_value(node.on_false, kinds)
        kind = ka if ka == kb else _common(ka, kb, "a conditional")
        a, b = (x.cast("double") if kind == REAL else x for x in (a, b))
        return F.when(compile_predicate(node.condition, kinds), a).otherwise(b), kind
    if isinstance(node, Operation):
        return _operation(node.name, [compile_value(a, kinds) for a in node.arguments])
    raise ExpressionError(f"not a value: {node!r}")


def _common(a: str, b: str, what: str) -> str:
    if a not in _NUMERIC or b not in _NUMERIC:
        raise ExpressionError(f"{what} cannot take {a} and {b}")
    return INT if a == b == INT else REAL


def _operation(name: str, operands: list[Typed]) -> Typed:
    (x, kx), *rest = operands
    if name in _PARTS:
        if kx != TIME:
            raise ExpressionError(f"'{name}' takes a timestamp, not {kx}")
        return _PARTS[name](x).cast("long"), INT
    if name in ("negate", "abs"):
        if kx not in _NUMERIC:
            raise ExpressionError(f"'{name}' takes a number, not {kx}")
        return (-x if name == "negate" else F.abs(x)), kx
    y, ky = rest[0]
    kind = _common(kx, ky, f"'{name}'")
    if name == "mod" and kx != ky:
        raise ExpressionError("'mod' takes two integers or two reals")
    if kind == REAL:
        x, y = x.cast("double"), y.cast("double")
    if name == "plus":
        return x + y, kind
    if name == "minus":
        return x - y, kind
    if name == "times":
        return x * y, kind
    if name == "mod":
        return (x % y if kind == INT else F.when(y == 0, F.lit(float("nan"))).otherwise(x % F.when(y != 0, y))), kind
    if kind == INT:
        return F.call_function("div", x, y), INT
    return ieee_divide(x, y), REAL


def ieee_divide(x: Column, y: Column) -> Column:
    """Real division with infinities and NaN where ANSI mode would raise."""
    by_zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, by_zero).otherwise(x / F.when(y != 0, y))


def compile_predicate(node: Predicate, kinds: Mapping[str, str]) -> Column:
    if isinstance(node, Logic):
        parts = [compile_predicate(a, kinds) for a in node.arguments]
        return ~parts[0] if node.name == "not" else parts[0] & parts[1] if node.name == "and" else parts[0] | parts[1]
    if not isinstance(node, Test):
        raise ExpressionError(f"not a predicate: {node!r}")
    (x, kx), (y, ky) = (compile_value(a, kinds) for a in node.arguments)
    if node.name in ("startsWith", "matches"):
        if kx != TEXT or ky != TEXT:
            raise ExpressionError(f"'{node.name}' takes two texts, not {kx} and {ky}")
        if node.name == "startsWith":
            return F.startswith(x, y)
        return F.rlike(x, F.concat(F.lit(r"\A(?:"), y, F.lit(r")\z")))
    if kx != ky:
        _common(kx, ky, f"'{node.name}'")
    elif kx == TEXT and node.name != "eq":
        raise ExpressionError(f"'{node.name}' cannot take texts")
    test = x > y if node.name == "gt" else x < y if node.name == "lt" else x == y
    for c, kind, operand in ((x, kx, node.arguments[0]), (y, ky, node.arguments[1])):
        if kind == REAL and not isinstance(operand, Literal):
            test = test & ~F.isnan(c)  # comparisons with NaN are false, not as in Spark's order
    return test
