"""Fields and schemas, and the four kernel types that expressions know."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import types as T

INT, REAL, TEXT, TIME, LIST = "int", "real", "text", "timestamp", "list"

_SPARK = {INT: T.LongType(), REAL: T.DoubleType(), TEXT: T.StringType(), TIME: T.TimestampNTZType()}


def kind_of(spark_type: T.DataType) -> str:
    """Kernel type of a Spark type; types without kernels are named as Spark names them."""
    if isinstance(spark_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(spark_type, (T.FloatType, T.DoubleType)):
        return REAL
    if isinstance(spark_type, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if isinstance(spark_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    if isinstance(spark_type, T.ArrayType):
        return LIST
    return spark_type.simpleString()


def spark_type(kind: str) -> T.DataType:
    if kind not in _SPARK:
        raise TypeError(f"'{kind}' is not a kernel type")
    return _SPARK[kind]


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = True


@dataclass(frozen=True)
class Schema:
    """An ordered list of fields; changes give a new schema."""

    fields: tuple[Field, ...] = ()

    @staticmethod
    def from_fields(fields: Iterable[Field]) -> Schema:
        return Schema(tuple(fields))

    def __len__(self) -> int:
        return len(self.fields)

    def _at(self, index: int, length: int) -> int:
        if not 0 <= index < length:
            raise IndexError(f"field index {index} is outside 0..{length - 1}")
        return index

    def field_at(self, index: int) -> Field:
        return self.fields[self._at(index, len(self))]

    def field_by_name(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def index_of(self, name: str) -> int | None:
        return next((i for i, f in enumerate(self.fields) if f.name == name), None)

    def add_field(self, index: int, field: Field) -> Schema:
        at = self._at(index, len(self) + 1)
        return Schema((*self.fields[:at], field, *self.fields[at:]))

    def remove_field(self, index: int) -> Schema:
        at = self._at(index, len(self))
        return Schema(self.fields[:at] + self.fields[at + 1 :])

    def to_list(self) -> list[Field]:
        return list(self.fields)
