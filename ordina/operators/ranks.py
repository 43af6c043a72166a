"""Exact quantiles of a whole column of any size: brackets around a rank are narrowed until few values are left."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import hazen, real

#: Valid values up to which one aggregate, which merges all distinct ones in a task, answers at once.
AT_ONCE = 1_000_000
#: Values of a bracket that are sorted in one task at the end.
FEW = 100_000
#: Accuracy of the sketch that narrows a bracket: an estimate is off by at most a share of one in so many.
ACCURACY = 5_000


def values_at(df: DataFrame, c: Column, ranks: Iterable[int], few: int = FEW, accuracy: int = ACCURACY) -> dict[int, float]:
    """Rank (from 0, among the valid values in order, NaN last) -> value.

    All ranks share their passes. Each pass sketches two values around a rank within its bracket and counts
    what lies below, at, between and above them; so a bracket shrinks some thousandfold, and never past a value
    that many rows share. Nothing but these numbers comes to the driver.
    """
    rows = df.select(real(c).alias("v")).filter("v IS NOT NULL")
    n = rows.count()
    # rank -> (open lower end or None, open upper end or None, values up to the lower end, values inside)
    open_: dict[int, tuple[float | None, float | None, int, int]] = {r: (None, None, 0, n) for r in ranks}
    out: dict[int, float] = {}

    def inside(lo: float | None, hi: float | None) -> Column:
        v, test = F.col("v"), F.lit(True)
        if lo is not None:
            test = test & (v > F.lit(lo))
        return test if hi is None else test & (v < F.lit(hi))

    while wide := {r: b for r, b in open_.items() if b[3] > few}:
        pairs = []
        for r, (lo, hi, below, held) in wide.items():
            at = (r - below + 0.5) / held
            shares = [max(0.0, at - 2 / accuracy), min(1.0, at + 2 / accuracy)]
            pairs.append(F.approx_percentile(F.when(inside(lo, hi), F.col("v")), shares, accuracy))
        found = rows.agg(*[p.alias(f"p{i}") for i, p in enumerate(pairs)]).first()
        counts = []
        for i, (lo, hi, _, _) in enumerate(wide.values()):
            a, b = (F.lit(x) for x in found[i])
            held, v = inside(lo, hi), F.col("v")
            counts += [F.count_if(held & t) for t in (v < a, v == a, (v > a) & (v < b), (v == b) & (b > a), v > b)]
        got = rows.agg(*[x.alias(f"c{i}") for i, x in enumerate(counts)]).first()
        for i, (r, (lo, hi, below, _)) in enumerate(wide.items()):
            a, b = found[i]
            parts = zip(got[5 * i : 5 * i + 5], ((lo, a), a, (a, b), b, (b, hi)), strict=True)
            for size, what in parts:
                if r < below + size:
                    break
                below += size
            if isinstance(what, tuple):
                open_[r] = (*what, below, size)
            else:
                out[r] = what
                del open_[r]
    if open_:
        pick = [F.element_at(F.sort_array(F.collect_list(F.when(inside(lo, hi), F.col("v")))), r - below + 1).alias(f"v{i}") for i, (r, (lo, hi, below, _)) in enumerate(open_.items())]
        out |= dict(zip(open_, rows.agg(*pick).first(), strict=True))
    return out


def quantiles(df: DataFrame, c: Column, shares: Iterable[float], n: int) -> list[Column]:
    """Hazen's quantiles of the ``n`` valid values of ``c``: aggregates of it up to AT_ONCE values, literals beyond."""
    shares = list(shares)
    if n <= AT_ONCE:
        return [hazen(c, q, n) for q in shares]
    places = [min(n - 1.0, max(0.0, n * q - 0.5)) for q in shares]
    ends = [(math.floor(p), math.ceil(p)) for p in places]
    at = values_at(df, c, sorted({r for e in ends for r in e}))
    # An aggregate of literals, so that it stands beside other aggregates of the column.
    return [F.max(F.lit(at[a] if a == b else (b - p) * at[a] + (p - a) * at[b])) for p, (a, b) in zip(places, ends, strict=True)]
