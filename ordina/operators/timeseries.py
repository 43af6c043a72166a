"""Shift, interpolation and trailing time windows, in blocks of rows with what they need from their neighbours."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import Aggregate
from ..functions.compile import quoted
from ..plans.order import BLOCK, RID, checked_broadcast
from ..schema import INT, REAL, TIME
from . import windows

#: A rolling block covers so many intervals, so that few rows are sent to two blocks, unless that makes more than
#: BLOCKS of them; but one that would hold over BLOCK_ROWS rows on average is cut down, to one interval at least.
INTERVALS_A_BLOCK = 8
BLOCKS = 512
BLOCK_ROWS = 1 << 18


def shift(df: DataFrame, name: str, steps: int, out: str, position: str = "__pos") -> DataFrame:
    """Adds ``out``: the value ``steps`` rows before (after, if negative), null beyond the ends.

    A block of positions also gets the last (first) rows of its neighbour, if the shift is shorter than a
    block; longer shifts join rows by position.
    """
    c = quoted(name)
    if steps == 0:
        return df.withColumn(out, c)
    if abs(steps) > BLOCK:
        other = df.select((F.col(position) + steps).alias(position), c.alias(out))
        return df.join(other, position, "left")
    block, place = F.expr(f"{position} div {BLOCK}"), F.col(position) % BLOCK
    edge = place >= BLOCK - steps if steps > 0 else place < -steps
    blocks = F.array(block, F.when(edge, block + (1 if steps > 0 else -1)))
    rows = df.withColumn("__own", block).withColumn("__block", F.explode(F.array_compact(blocks)))
    lagged = F.lag(c, steps).over(Window.partitionBy("__block").orderBy(position))
    return rows.withColumn(out, lagged).filter("__own = __block").drop("__own", "__block")


def interpolate(df: DataFrame, kinds: Mapping[str, str], names: Sequence[str], position: str = "__pos") -> DataFrame:
    """Fills nulls of ``names`` linearly by position; leading and trailing ones with the nearest value.

    A block of positions is filled with the last value before and the first value after it, which come from
    one row per block. A column with no value stays as it is.
    """
    block = F.expr(f"{position} div {BLOCK}")
    rows = df.withColumn("__block", block)
    pair = lambda n: F.struct(F.col(position).alias("p"), quoted(n).alias("v"))
    ends = []
    for i, n in enumerate(names):
        ends += [F.max_by(F.when(quoted(n).isNotNull(), pair(n)), F.when(quoted(n).isNotNull(), F.col(position))).alias(f"__l{i}"), F.min_by(F.when(quoted(n).isNotNull(), pair(n)), F.when(quoted(n).isNotNull(), F.col(position))).alias(f"__f{i}")]
    carry = rows.groupBy("__block").agg(*ends)
    back, ahead = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("__block").asc(), F.col("__block").desc()))
    columns = []
    for i in range(len(names)):
        columns += [F.last(f"__l{i}", True).over(back).alias(f"__before{i}"), F.last(f"__f{i}", True).over(ahead).alias(f"__after{i}")]
    met = rows.join(checked_broadcast(carry.select("__block", *columns)), "__block")
    # Only frames that grow with the row are evaluated in linear time, so the value after is found in falling order.
    rising, falling = (Window.partitionBy("__block").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(position).asc(), F.col(position).desc()))
    known = [F.when(quoted(n).isNotNull(), pair(n)) for n in names]
    met = met.withColumns({f"__n{i}": F.coalesce(F.last(k, True).over(falling), F.col(f"__after{i}")) for i, k in enumerate(known)})
    met = met.withColumns({f"__p{i}": F.coalesce(F.last(k, True).over(rising), F.col(f"__before{i}")) for i, k in enumerate(known)})
    filled = {}
    for i, n in enumerate(names):
        kind, spark = kinds[n], df.schema[n].dataType
        number = lambda c, kind=kind: (F.unix_micros(c.cast("timestamp")) if kind == TIME else c).cast("double")
        p0, p1, v0, v1 = F.col(f"__p{i}.p"), F.col(f"__n{i}.p"), F.col(f"__p{i}.v"), F.col(f"__n{i}.v")
        t = (F.col(position) - p0) / F.nullif(p1 - p0, F.lit(0))
        line = (1 - t) * number(v0) + t * number(v1)
        if kind == TIME:
            line = F.timestamp_micros(line.cast("long")).cast(spark)
        elif kind == INT:
            line = line.cast("long")
        filled[n] = F.coalesce(quoted(n), F.when(v0.isNull(), v1).when(v1.isNull(), v0).otherwise(line)).cast(spark)
    drop = ["__block", *[f"__{x}{i}" for x in ("before", "after", "p", "n") for i in range(len(names))]]
    return met.withColumns(filled).drop(*drop)


def rolling(df: DataFrame, key: str, kind: str, interval: float, functions: Mapping[str, tuple[str, Aggregate]], peers: bool = False) -> DataFrame:
    """key, RID and a double per entry of ``functions`` (output name -> column and aggregate), over (t - interval, t].

    Rows carry their order in RID. Among rows of equal key, only earlier ones count, or with ``peers`` all of them.
    Keys are cut into blocks of several intervals; a block also gets the last interval of the block before it, and
    its windows are evaluated in time that hardly depends on their lengths. Rows whose key is missing or not finite
    get nulls (0 as SUM), and are in no window.
    """
    if interval <= 0:
        raise ValueError("the interval has to be positive")
    interval = interval if kind == REAL else math.ceil(interval)
    number = F.unix_micros(quoted(key).cast("timestamp")) if kind == TIME else quoted(key)
    needed = dict.fromkeys([key, *[c for c, f in functions.values() if f is not Aggregate.LENGTH]])
    rows = df.select(*map(quoted, needed), RID, number.alias("__k"))
    known = F.col("__k").isNotNull() & (F.abs("__k") < float("inf") if kind == REAL else F.lit(True))
    placed = rows.filter(known)
    lo, hi, n = placed.agg(F.min("__k"), F.max("__k"), F.count("__k")).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    width = max(interval, min(max(interval * INTERVALS_A_BLOCK, (hi - lo) / BLOCKS), (hi - lo) * BLOCK_ROWS / max(1, n)))
    width = width if kind == REAL else int(width) + 1
    own = F.floor((F.col("__k") - F.lit(lo)) / F.lit(width)).cast("long")
    placed = placed.withColumn("__own", own).withColumn("__from", F.col("__k") - F.lit(lo) - F.col("__own") * F.lit(width))
    late = F.when(F.col("__from") > F.lit(width) - F.lit(interval) - (F.lit(0) if kind != REAL else F.lit(width * 1e-9)), F.col("__own") + 1)
    placed = placed.withColumn("__block", F.explode(F.array_compact(F.array("__own", late)))).withColumn("__is_own", F.expr("__own = __block")).drop("__own", "__from")
    made = T.StructType([rows.schema[key], rows.schema[RID], *[T.StructField(n, T.DoubleType()) for n in functions]])
    out = placed.groupBy("__block").applyInArrow(windows.block(key, interval, dict(functions), peers), made)
    nothing = [F.lit(0.0 if f is Aggregate.SUM else None).cast("double").alias(n) for n, (_, f) in functions.items()]
    return out.unionByName(rows.filter(~F.coalesce(known, F.lit(False))).select(quoted(key), RID, *nothing))
