"""Shared pieces: stage tables in the cluster's shared folder, skew-safe look-ups, text to words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least one row in HOT_SHARE; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000

#: ASCII white space, the complement of the word class [^\x20\x09-\x0D].
ASCII_SPACE = b" \t\n\r\x0b\x0c"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset and all run locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        holder = tempfile.TemporaryDirectory(prefix="stage-")
        atexit.register(holder.cleanup)
        own = shared_dir.own = f"file://{holder.name}"
        shared_dir.holder = holder
    return own


_STAGED: list[str] = []


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    This cuts the lineage with files that survive a lost executor, and keeps later passes
    from repeating the work above. Results that are not yet written may read it, so the files stay
    until ``clear_stages``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Deletes the stage tables of this process; call it when all results have been written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. Pure ASCII takes the byte-wise fast path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def split_hot(right: DataFrame, n: str, total: int) -> tuple[DataFrame, DataFrame]:
    """(hot, cold) rows of a keyed table with group sizes ``n`` that add up to ``total``; at most HOT_SHARE are hot."""
    is_hot = F.col(n) * HOT_SHARE > F.lit(max(total, HOT_SHARE))
    return right.filter(is_hot), right.filter(~is_hot)


#: Narrow rows up to which a table is broadcast once it has been counted; beyond, it meets others by a shuffled join.
FEW_ROWS = 1_000_000


def few(df: DataFrame, most: int | None = None) -> bool:
    """Whether ``df``, a stage table of narrow rows, is small enough to be broadcast."""
    most = FEW_ROWS if most is None else most
    return df.limit(most + 1).count() <= most


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """Whole rows as one column ``row``, so that no name of theirs meets another one, and ``more`` columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *more)


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Joins ``left`` with narrow rows of ``right`` (one a key), without sending a hot key to one task.

    Hot keys, at most HOT_SHARE of them by construction, are broadcast; all others meet in a shuffled join.
    ``left`` should be a stage table, as it is read twice.
    """
    hot, cold = split_hot(right, n, total)
    keys = list(keys)
    some = left.join(F.broadcast(hot), keys, "inner")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return some.unionByName(rest)
