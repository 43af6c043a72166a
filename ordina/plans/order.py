"""Row order of tables.

A table's order is a list of hidden key columns that ends in a unique one. Filters and projections keep it;
sorting only puts new keys in front. Operators that need positions get them from ``dense``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RID = "__rid"
#: Row ids that share a block in ``dense``: one task numbers at most so many rows.
BLOCK = 1 << 18
#: Blocks, files or carries whose table is broadcast; beyond, it meets the rows by a shuffled join.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Key:
    """A hidden order column."""

    column: str
    descending: bool = False
    nulls_first: bool = True

    def sort(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


ROW_ORDER = (Key(RID),)


def sorts(order: Sequence[Key]) -> list[Column]:
    return [k.sort() for k in order]


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; an own folder where it is unset and all run locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    holder = getattr(shared_dir, "holder", None)
    if holder is None:
        holder = shared_dir.holder = tempfile.TemporaryDirectory(prefix="ordina-")
        atexit.register(holder.cleanup)
    return f"file://{holder.name}"


_STAGED: list[str] = []


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which ``clear_stages`` deletes."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so lost executors lose no part of it."""
    path = stage_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Deletes the stage tables of this process; call it when all results that read them have been written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``limit`` rows, else ``df`` as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def assign(df: DataFrame) -> DataFrame:
    """Gives a file scan dense row ids in file order: files by name, rows by their place in the file.

    Rows per file are counted from metadata columns alone; the data is neither shuffled nor read for it.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    sizes = tagged.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    if len(df.inputFiles()) <= 1:
        return tagged.withColumn(RID, F.col("__at")).drop("__file", "__at")
    before = F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    offsets = checked_broadcast(sizes.select(F.col("__file"), before.alias("__before")))
    return tagged.join(offsets, "__file").withColumn(RID, F.col("__before") + F.col("__at")).drop("__file", "__at", "__before")


def from_sorted(df: DataFrame, order: Sequence[Key]) -> DataFrame:
    """Replaces the order keys by dense row ids in their order.

    The sorted rows are staged with their (partition, place); offsets come from one count per partition.
    """
    hidden = [k.column for k in order]
    ordered = df.orderBy(*sorts(order)).drop(*hidden).withColumn("__at", F.monotonically_increasing_id())
    ordered = stage(ordered, "sorted")
    part = F.shiftright("__at", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    offsets = checked_broadcast(sizes.select("__part", before.alias("__before")))
    met = ordered.withColumn("__part", part).join(offsets, "__part")
    return met.withColumn(RID, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def dense(df: DataFrame, order: Sequence[Key], position: str = "__pos") -> DataFrame:
    """Adds positions 0, 1, 2 ... in row order.

    Row ids are cut into blocks of BLOCK ids. Counts of the blocks before give each block its first position,
    and rows are numbered within their block, so blocks are numbered in parallel.
    """
    if tuple(order) != ROW_ORDER:
        return from_sorted(df, order).withColumn(position, F.col(RID))
    block = F.expr(f"{RID} div {BLOCK}")
    sizes = df.groupBy(block.alias("__block")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    offsets = checked_broadcast(sizes.select("__block", before.alias("__before")))
    met = df.withColumn("__block", block).join(offsets, "__block")
    place = F.row_number().over(Window.partitionBy("__block").orderBy(RID)) - 1
    return met.withColumn(position, F.col("__before") + place).drop("__block", "__before")
