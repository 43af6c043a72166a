"""The expression language on streaming tables.

Filters and computed columns look at one row only, so they mean the same on a stream as on a table. Operators
that depend on the order of all rows (sorting, shifting, interpolation) have no meaning there. Groups are kept
per tumbling window of event time behind a watermark, so their state is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Aggregate, aggregate
from ..functions.compile import compile_predicate, compile_value, present, quoted
from ..functions.expr import Source, build_predicate, build_value
from ..operators.group import check_functions
from ..schema import kind_of


def _kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def filter_rows(df: DataFrame, predicate: Source) -> DataFrame:
    """Rows where the predicate holds and no column that it mentions is null."""
    node = build_predicate(predicate)
    return df.filter(present(node) & compile_predicate(node, _kinds(df)))


def with_each(df: DataFrame, name: str, expression: Source) -> DataFrame:
    """Adds the expression of every row; null where any column that it mentions is null."""
    node = build_value(expression)
    made, _ = compile_value(node, _kinds(df))
    return df.withColumn(name, F.when(present(node), made))


def aggregate_windows(df: DataFrame, time: str, width: str, lateness: str, key: str, wanted: Sequence[tuple[str, Sequence[Aggregate]]]) -> DataFrame:
    """start, key and ``<col>_<fn>`` of each tumbling window; events later than ``lateness`` are left out.

    Functions need no order of rows: all but FIRST and LAST.
    """
    check_functions(_kinds(df), wanted)
    if any(f in (Aggregate.FIRST, Aggregate.LAST) for _, fs in wanted for f in fs):
        raise TypeError("a stream has no first and last row")
    stamped = df.withColumn("__time", quoted(time).cast("timestamp")).withWatermark("__time", lateness)
    made = [aggregate(f, quoted(n), F.lit(0)).alias(f"{n}_{f.value}") for n, fs in wanted for f in fs]
    grouped = stamped.groupBy(F.window("__time", width).alias("__w"), quoted(key)).agg(*made)
    return grouped.select(F.col("__w.start").cast("timestamp_ntz").alias("start"), *[quoted(c) for c in grouped.columns if c != "__w"])
