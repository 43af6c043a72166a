"""What charts are drawn from; drawing itself is not part of this package."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compile import quoted


def histogram(df: DataFrame, name: str, bins: int = 10) -> DataFrame:
    """bin, low, high, count of equal-width bins; the last includes its upper end. Nulls and NaN are left out."""
    c = quoted(name).cast("double")
    rows = df.select(c.alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    lo, hi = rows.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return df.sparkSession.range(0).select(F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("count"))
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    width = (hi - lo) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / width)).cast("long")
    counts = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    low = lo + F.col("bin") * F.lit(width)
    return every.join(counts, "bin", "left").select("bin", low.alias("low"), (low + width).alias("high"), F.coalesce("n", F.lit(0)).alias("count"))


def kde(df: DataFrame, name: str, points: int = 100, bins: int = 1000) -> list[tuple[float, float]]:
    """(x, density) at evenly spaced points: a Gaussian kernel of Scott's width over ``bins`` equal bins.

    Only the bins' counts come to the driver, whatever the number of rows.
    """
    rows = histogram(df, name, bins).collect()
    total = sum(r["count"] for r in rows)
    if not total:
        return []
    middle = [(r.low + r.high) / 2 for r in rows]
    mean = sum(m * r["count"] for m, r in zip(middle, rows, strict=True)) / total
    spread = math.sqrt(sum((m - mean) ** 2 * r["count"] for m, r in zip(middle, rows, strict=True)) / total)
    width = (spread or 1.0) * total**-0.2
    lo, hi = min(r.low for r in rows) - 3 * width, max(r.high for r in rows) + 3 * width
    at = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    scale = 1 / (total * width * math.sqrt(2 * math.pi))
    return [(x, scale * sum(r["count"] * math.exp(-0.5 * ((x - m) / width) ** 2) for m, r in zip(middle, rows, strict=True))) for x in at]


def kde2(df: DataFrame, x: str, y: str, points: int = 50, bins: int = 100) -> list[tuple[float, float, float]]:
    """(x, y, density) on a grid of points: a Gaussian kernel of Scott's covariance over bins times bins equal cells.

    Rows where either value is missing are left out. Only the counts of cells that are not empty come to the driver,
    whatever the number of rows.
    """
    import numpy as np

    a, b = (quoted(n).cast("double") for n in (x, y))
    rows = df.select(a.alias("a"), b.alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b)")
    a0, a1, b0, b1 = rows.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    if a0 is None:
        return []
    ends = [(lo - 0.5, hi + 0.5) if lo == hi else (lo, hi) for lo, hi in ((a0, a1), (b0, b1))]
    cell = [F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / ((hi - lo) / bins))) for c, (lo, hi) in zip("ab", ends, strict=True)]
    found = rows.groupBy(cell[0].alias("i"), cell[1].alias("j")).agg(F.count(F.lit(1)).alias("n")).collect()
    middle = np.array([[lo + (hi - lo) / bins * (r[k] + 0.5) for k, (lo, hi) in enumerate(ends)] for r in found])
    weight = np.array([r.n for r in found], float)
    total = weight.sum()
    off = middle - (weight[:, None] * middle).sum(axis=0) / total
    cov = (weight[:, None] * off).T @ off / total
    cov += np.diag([1.0 if cov[k, k] == 0 else 0.0 for k in (0, 1)])
    kernel = cov * total ** (-1 / 3)
    if np.linalg.det(kernel) <= 1e-12 * kernel[0, 0] * kernel[1, 1]:
        kernel = np.diag(np.diag(kernel))  # one value decides the other: no density has this shape, so axes are smoothed alone
    inverse, scale = np.linalg.inv(kernel), 1 / (total * 2 * math.pi * math.sqrt(np.linalg.det(kernel)))
    out = []
    grid = [[lo - 3 * w + (hi - lo + 6 * w) * i / (points - 1) for i in range(points)] for (lo, hi), w in zip(ends, np.sqrt(np.diag(kernel)), strict=True)]
    for px in grid[0]:
        for py in grid[1]:
            d = np.array([px, py]) - middle
            out.append((float(px), float(py), float(scale * (weight * np.exp(-0.5 * ((d @ inverse) * d).sum(axis=1))).sum())))
    return out


def series(df: DataFrame, most: int | None = None) -> DataFrame:
    """All rows, or with ``most`` a seeded sample of about so many where there are more."""
    if most is None or (total := df.count()) <= most:
        return df
    return df.sample(most / total, seed=7)
