"""Grouping: aggregates, lists and value counts, in order of first occurrence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Aggregate, aggregate
from ..functions.compile import quoted
from ..plans.order import RID
from ..schema import INT, REAL

Wanted = Sequence[tuple[str, Sequence[Aggregate]]]


def check_functions(kinds: Mapping[str, str], wanted: Wanted) -> None:
    for name, functions in wanted:
        if name not in kinds:
            raise KeyError(f"Column '{name}' does not exist.")
        if kinds[name] not in (INT, REAL) and any(f is not Aggregate.LENGTH for f in functions):
            raise TypeError(f"column '{name}' of type {kinds[name]} only has a length")


def aggregate_by(df: DataFrame, key: str, wanted: Wanted) -> DataFrame:
    """key, ``<col>_<fn>`` doubles and the hidden order (null key, first row id); one shuffle of partial states."""
    out = [aggregate(f, quoted(name), F.col(RID)).alias(f"{name}_{f.value}") for name, functions in wanted for f in functions]
    return df.groupBy(quoted(key)).agg(*out, F.min(RID).alias("__first"))


def to_lists(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """key, and each other column as the list of its values in row order, nulls included."""
    row = F.struct(F.col(RID).alias("__r"), *[quoted(n) for n in names])
    grouped = df.groupBy(quoted(key)).agg(F.sort_array(F.collect_list(row)).alias("__rows"), F.min(RID).alias("__first"))
    values = [F.col("__rows").getField(n).alias(n) for n in names]
    return grouped.select(quoted(key), *values, "__first")


def count_values(df: DataFrame, name: str) -> DataFrame:
    """value, count and the hidden order; nulls are one value, the last."""
    return df.groupBy(quoted(name).alias("value")).agg(F.count(F.lit(1)).alias("count"), F.min(RID).alias("__first"))
