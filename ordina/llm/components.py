"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Edges that one task joins up at once; more of them are contracted by star steps, anywhere, until so few are left.
LOCAL_EDGES = 500_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := low.setdefault(x, x)) != x:
            low[x] = low.setdefault(up, up)
            x = low[x]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            u, v = root(u), root(v)
            if u != v:
                low[max(u, v)] = min(u, v)
    nodes = list(low)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, label: str) -> DataFrame:
    """Links each v of a (u, v) row to the least of u and u's partners; hubs are broadcast, not shuffled."""
    pairs = common.stage(pairs, label)
    least = common.stage(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"), F.count(F.lit(1)).alias("degree")), f"{label}-low")
    return common.lookup(pairs, least, ["u"], "degree", pairs.count())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (u, v: long); component is the smallest node reachable.

    Up to LOCAL_EDGES edges are joined up by one task, in bounded memory. Of more, star steps make stars, in
    a number of rounds that grows with the logarithm of the number of nodes; nothing is gathered on the driver
    but a checksum a round. Self-links and repeated links are allowed; no edges, no rows.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    nodes = ordered = common.stage(ordered, "cc-edges")
    if ordered.count() <= LOCAL_EDGES:
        return ordered.repartition(1).mapInArrow(_united, "node long, component long")
    ordered = ordered.filter("u <> v")
    before = _checksum(ordered)
    while before[0]:
        both = ordered.unionByName(ordered.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "cc-large").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        met = _star(large, "cc-small")
        small = met.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(met.select("u", F.col("low").alias("v")))
        ordered = common.stage(small.filter("u <> v").distinct(), "cc-edges")
        after = _checksum(ordered)
        if after == before:
            break
        before = after
    every = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    stars = ordered.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
    return every.join(stars, "node", "left").select("node", F.coalesce("low", "node").alias("component"))
