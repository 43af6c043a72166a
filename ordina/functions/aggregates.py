"""Aggregate functions: one definition for groups, whole columns and windows."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compile import ieee_divide


class Aggregate(Enum):
    """Functions by the suffix of their output column."""

    MINIMUM = "min"
    MAXIMUM = "max"
    MEAN = "mean"
    LENGTH = "length"
    MEDIAN = "median"
    FIRST = "first"
    LAST = "last"
    SUM = "sum"
    RSI = "RSI"
    STD = "std dev"


def real(c: Column) -> Column:
    return c.cast("double")


def gain(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(real(c), F.lit(0.0)))


def loss(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(real(c), F.lit(0.0)))


def rsi(c: Column) -> Column:
    """100 U / (U - D): U and D are the means of gains and of losses over all valid values; NaN if both are 0."""
    up, down = F.avg(gain(c)), F.avg(loss(c))
    return ieee_divide(100 * up, up - down)


def minimum(c: Column) -> Column:
    """Least value; NaN counts as missing."""
    return F.min(F.when(~F.isnan(real(c)), c))


def maximum(c: Column) -> Column:
    return F.max(F.when(~F.isnan(real(c)), c))


def aggregate(function: Aggregate, c: Column, order: Column) -> Column:
    """The function of a group's column as a double; nulls are skipped but by LENGTH.

    ``order`` decides FIRST and LAST. Without valid values the result is null, but 0 for SUM.
    """
    valid = F.when(c.isNotNull(), order)
    return real(
        {
            Aggregate.MINIMUM: lambda: minimum(c),
            Aggregate.MAXIMUM: lambda: maximum(c),
            Aggregate.MEAN: lambda: F.avg(real(c)),
            Aggregate.LENGTH: lambda: F.count(F.lit(1)),
            Aggregate.MEDIAN: lambda: F.percentile(real(c), F.lit(0.5)),
            Aggregate.FIRST: lambda: F.min_by(c, valid),
            Aggregate.LAST: lambda: F.max_by(c, valid),
            Aggregate.SUM: lambda: F.coalesce(F.sum(c), F.lit(0)),
            Aggregate.RSI: lambda: rsi(c),
            Aggregate.STD: lambda: F.stddev_pop(real(c)),
        }[function]()
    )


def hazen(c: Column, q: float, n: int) -> Column:
    """Hazen's quantile of ``n`` valid values: linear between ranks at n q - 1/2, clamped to the ends.

    ``n`` has to be known, as it sets the rank that the exact percentile is asked for.
    """
    if n <= 1:
        return F.max(real(c))
    return F.percentile(real(c), F.lit(min(1.0, max(0.0, (n * q - 0.5) / (n - 1)))))


def correlation_sums(x: Column, y: Column, prefix: str) -> list[Column]:
    """Aggregates from which ``correlation`` is made, over rows where both are valid."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, real(x)), F.when(both, real(y))
    parts = {"n": F.count_if(both), "c": F.covar_pop(a, b), "x": F.var_pop(a), "y": F.var_pop(b)}
    return [c.alias(f"{prefix}_{k}") for k, c in parts.items()]


def correlation(prefix: str, get) -> float:
    """Pearson's coefficient from one row of ``correlation_sums``; NaN without variance or rows."""
    if not get(f"{prefix}_n"):
        return float("nan")
    spread = (get(f"{prefix}_x") * get(f"{prefix}_y")) ** 0.5
    return get(f"{prefix}_c") / spread if spread > 0 else float("nan")
