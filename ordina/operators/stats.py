"""Whole-column statistics, descriptions and correlations, each in one or two aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import correlation, correlation_sums, maximum, minimum, real, rsi
from ..functions.compile import quoted
from ..schema import INT, REAL
from .ranks import quantiles


def numeric(kinds: Mapping[str, str], name: str) -> None:
    if kinds[name] not in (INT, REAL):
        raise TypeError(f"column '{name}' of type {kinds[name]} has no statistics")


def statistic(name: str, c: Column) -> Column:
    """min, max and sum in the column's type, others as doubles; null without valid values."""
    return {
        "min": lambda: minimum(c),
        "max": lambda: maximum(c),
        "mean": lambda: F.avg(real(c)),
        "std dev": lambda: F.stddev_pop(real(c)),
        "variance": lambda: F.var_pop(real(c)),
        "sum": lambda: F.sum(c),
        "RSI": lambda: rsi(c),
    }[name]()


def valid_counts(df: DataFrame, names: Sequence[str]) -> list[int]:
    return list(df.agg(*[F.count(quoted(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()) if names else []


def describe(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per column: column, Mean, Std dev, Min, Quantile 0.25, Median, Quantile 0.75, Max."""
    heads = ("Mean", "Std dev", "Min", "Quantile 0.25", "Median", "Quantile 0.75", "Max")
    rows = []
    for (i, n), valid in zip(enumerate(names), valid_counts(df, names), strict=True):
        c = quoted(n)
        low, median, high = quantiles(df, c, (0.25, 0.5, 0.75), valid)
        cells = [statistic("mean", c), statistic("std dev", c), statistic("min", c), low, median, high, statistic("max", c)]
        rows.append(F.struct(F.lit(i).alias("__first"), F.lit(n).alias("column"), *[real(x).alias(h) for h, x in zip(heads, cells, strict=True)]))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def describe_nulls(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per column: colname, count of nulls, ratio to rows."""
    total = F.count(F.lit(1))
    rows = []
    for i, n in enumerate(names):
        nulls = F.count_if(quoted(n).isNull())
        rows.append(F.struct(F.lit(i).alias("__first"), F.lit(n).alias("colname"), nulls.alias("count"), F.when(total > 0, nulls / total).otherwise(F.lit(float("nan"))).alias("ratio")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[float]:
    """Coefficients of the pairs, from one row of sums for all of them."""
    sums = [c for i, (a, b) in enumerate(pairs) for c in correlation_sums(quoted(a), quoted(b), f"p{i}")]
    row = df.agg(*sums).first() if sums else None
    return [correlation(f"p{i}", lambda k: row[k]) for i in range(len(pairs))]
