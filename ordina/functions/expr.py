"""Expressions over a row: a small tree, built by operators on ``Row`` or parsed from JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timezone
from typing import Any, Union


class ExpressionError(ValueError):
    """An expression that is malformed or badly typed."""


class Value:
    """A scalar per row."""

    def _op(self, name: str, *more: Any) -> Operation:
        return Operation(name, (self, *map(value, more)))

    def __add__(self, other: Any) -> Operation:
        return self._op("plus", other)

    def __radd__(self, other: Any) -> Operation:
        return value(other)._op("plus", self)

    def __sub__(self, other: Any) -> Operation:
        return self._op("minus", other)

    def __rsub__(self, other: Any) -> Operation:
        return value(other)._op("minus", self)

    def __mul__(self, other: Any) -> Operation:
        return self._op("times", other)

    def __rmul__(self, other: Any) -> Operation:
        return value(other)._op("times", self)

    def __truediv__(self, other: Any) -> Operation:
        return self._op("divide", other)

    def __rtruediv__(self, other: Any) -> Operation:
        return value(other)._op("divide", self)

    def __mod__(self, other: Any) -> Operation:
        return self._op("mod", other)

    def __rmod__(self, other: Any) -> Operation:
        return value(other)._op("mod", self)

    def __neg__(self) -> Operation:
        return self._op("negate")

    def __abs__(self) -> Operation:
        return self._op("abs")

    def negate(self) -> Operation:
        return self._op("negate")

    def day(self) -> Operation:
        return self._op("day")

    def month(self) -> Operation:
        return self._op("month")

    def year(self) -> Operation:
        return self._op("year")

    def __gt__(self, other: Any) -> Test:
        return Test("gt", (self, value(other)))

    def __lt__(self, other: Any) -> Test:
        return Test("lt", (self, value(other)))

    def __eq__(self, other: Any) -> Test:  # type: ignore[override]
        return Test("eq", (self, value(other)))

    __hash__ = object.__hash__

    def starts_with(self, other: Any) -> Test:
        return Test("startsWith", (self, value(other)))

    def matches(self, pattern: Any) -> Test:
        return Test("matches", (self, value(pattern)))


class Predicate:
    """A truth per row."""

    def __and__(self, other: Predicate) -> Logic:
        return Logic("and", (self, predicate(other)))

    def __or__(self, other: Predicate) -> Logic:
        return Logic("or", (self, predicate(other)))

    def __invert__(self) -> Logic:
        return Logic("not", (self,))

    def switch(self, on_true: Any, on_false: Any) -> Choice:
        return Choice(self, value(on_true), value(on_false))

    def __bool__(self) -> bool:
        raise ExpressionError("a predicate has no truth of its own: combine predicates with &, | and ~")


@dataclass(frozen=True, eq=False)
class ColumnRef(Value):
    name: str


@dataclass(frozen=True, eq=False)
class Literal(Value):
    value: Union[int, float, str]


@dataclass(frozen=True, eq=False)
class TimeLiteral(Value):
    ns: int


@dataclass(frozen=True, eq=False)
class Operation(Value):
    name: str
    arguments: tuple[Value, ...]


@dataclass(frozen=True, eq=False)
class Choice(Value):
    condition: Predicate
    on_true: Value
    on_false: Value


@dataclass(frozen=True, eq=False)
class Test(Predicate):
    name: str
    arguments: tuple[Value, ...]


@dataclass(frozen=True, eq=False)
class Logic(Predicate):
    name: str
    arguments: tuple[Predicate, ...]


#: Operands of each operation, test and connective; more are ignored for connectives.
OPERATIONS = {"plus": 2, "minus": 2, "times": 2, "divide": 2, "mod": 2, "negate": 1, "abs": 1, "day": 1, "month": 1, "year": 1}
TESTS = {"gt": 2, "lt": 2, "eq": 2, "startsWith": 2, "matches": 2}
CONNECTIVES = {"and": 2, "or": 2, "not": 1}


class Row:
    """What a row function gets: ``row.at(name)`` is a column's value."""

    def at(self, name: str) -> ColumnRef:
        return ColumnRef(name)

    __getitem__ = at


def value(x: Any) -> Value:
    """A value node of a Python scalar, or the node itself."""
    if isinstance(x, Value):
        return x
    if isinstance(x, bool):
        raise ExpressionError("there are no truth values in columns")
    if isinstance(x, (int, float, str)):
        return Literal(x)
    if isinstance(x, date):
        when = x if isinstance(x, datetime) else datetime(x.year, x.month, x.day)
        when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
        past = when - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return TimeLiteral((past.days * 86_400 + past.seconds) * 1_000_000_000 + past.microseconds * 1000)
    raise ExpressionError(f"not a value: {x!r}")


def predicate(x: Any) -> Predicate:
    if isinstance(x, Predicate):
        return x
    raise ExpressionError(f"not a predicate: {x!r}")


Source = Union[Callable[[Row], Any], Value, Predicate, str, dict, int, float]


def build_value(source: Source) -> Value:
    """From a row function, a node, a Python number, or JSON (text or parsed)."""
    if isinstance(source, (Value, int, float)):
        return value(source)
    if callable(source):
        return value(source(Row()))
    return _value(json.loads(source) if isinstance(source, str) else source)


def build_predicate(source: Source) -> Predicate:
    if isinstance(source, Predicate):
        return source
    if callable(source):
        return predicate(source(Row()))
    return _predicate(json.loads(source) if isinstance(source, str) else source)


def _many(node: dict, parse: Callable[[Any], Any], least: int, name: str) -> tuple:
    found = node.get("arguments")
    if not isinstance(found, list) or len(found) < least:
        raise ExpressionError(f"'{name}' needs {least} operands")
    return tuple(map(parse, found[:least]))


def _value(node: Any) -> Value:
    if isinstance(node, (int, float, str)) and not isinstance(node, bool):
        return Literal(node)
    if not isinstance(node, dict):
        raise ExpressionError(f"not a value: {node!r}")
    if "column" in node:
        return ColumnRef(str(node["column"]))
    if "timestampNs" in node:
        return TimeLiteral(int(node["timestampNs"]))
    if "operation" in node:
        name = node["operation"]
        if name not in OPERATIONS:
            raise ExpressionError(f"unknown operation '{name}'")
        return Operation(name, _many(node, _value, OPERATIONS[name], name))
    if "condition" in node:
        if "onTrue" not in node or "onFalse" not in node:
            raise ExpressionError("a condition needs onTrue and onFalse")
        return Choice(_predicate(node["condition"]), _value(node["onTrue"]), _value(node["onFalse"]))
    raise ExpressionError(f"not a value: {node!r}")


def _predicate(node: Any) -> Predicate:
    if isinstance(node, dict) and "predicate" in node:
        name = node["predicate"]
        if name not in TESTS:
            raise ExpressionError(f"unknown predicate '{name}'")
        return Test(name, _many(node, _value, TESTS[name], name))
    if isinstance(node, dict) and "boolean" in node:
        name = node["boolean"]
        if name not in CONNECTIVES:
            raise ExpressionError(f"unknown connective '{name}'")
        return Logic(name, _many(node, _predicate, CONNECTIVES[name], name))
    raise ExpressionError(f"not a predicate: {node!r}")


def to_json(node: Value | Predicate) -> Any:
    """The JSON form of a tree, as ``build_value`` and ``build_predicate`` read it."""
    if isinstance(node, ColumnRef):
        return {"column": node.name}
    if isinstance(node, Literal):
        return node.value
    if isinstance(node, TimeLiteral):
        return {"timestampNs": node.ns}
    if isinstance(node, Choice):
        return {"condition": to_json(node.condition), "onTrue": to_json(node.on_true), "onFalse": to_json(node.on_false)}
    key = {Operation: "operation", Test: "predicate", Logic: "boolean"}[type(node)]
    return {key: node.name, "arguments": [to_json(a) for a in node.arguments]}
