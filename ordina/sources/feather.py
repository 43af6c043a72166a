"""Feather files in parallel: parts that executors write, and files that they read, none by way of the driver."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import feather
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.order import RID
from . import files

#: A part is closed at so many bytes in memory; the file is smaller.
PART_BYTES = 1 << 26
#: Rows that are handed back to Spark at once.
BATCH_ROWS = 10_000
#: What an Arrow file ends in.
END = b"ARROW1"


def _bytes(rows: pa.Table) -> bytes:
    out = io.BytesIO()
    feather.write_feather(rows, out)
    return out.getvalue()


def write_parts(df: DataFrame, path: str) -> None:
    """A folder of Feather files in the order of ``df``; the first has no rows, so an empty table has its types too.

    Spark's text writer writes them, to any store that it knows and by its commits: a text is one file, as bytes that
    nothing decodes, without the Arrow file's last bytes, which are the line end.
    """
    schema = df.limit(0).toArrow().schema

    def part(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        made = _bytes(pa.Table.from_batches(batches).cast(schema) if batches else schema.empty_table())
        return pa.RecordBatch.from_arrays([pa.array([made[: -len(END)]], pa.binary())], names=["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            some.append(batch)
            size += batch.nbytes
            if size >= PART_BYTES:
                yield part(some)
                some, size = [], 0
        if some:
            yield part(some)

    spark = df.sparkSession
    head = spark.createDataFrame([(part([])[0][0].as_py(),)], "value binary").coalesce(1)
    rows = head.unionByName(df.mapInArrow(run, "value binary")).select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).text(path)
    for name in files.names(spark, path):
        files.rename(spark, name, name.removesuffix(".txt") + ".feather")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of one Feather file, or of a folder's files by name, with their number as RID.

    A file is read by one task, first for its number of rows; the driver sees a number a file, and the first one's types.
    """
    names = files.names(spark, path)
    if not names:
        raise FileNotFoundError(path)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                try:
                    made = feather.read_table(pa.BufferReader(content.as_buffer()), memory_map=False).schema.serialize().to_pybytes()
                except pa.ArrowException:
                    made = None
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["schema"])

    first = spark.read.format("binaryFile").load(names[0]).select("content").mapInArrow(described, "schema binary").first()
    if first is None or first[0] is None:
        raise ValueError(f"no Feather file: {names[0]}")
    schema = spark.createDataFrame(pa.ipc.read_schema(pa.py_buffer(bytes(first[0]))).empty_table()).schema
    zone = spark.conf.get("spark.sql.session.timeZone")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                n = feather.read_table(pa.BufferReader(content.as_buffer()), memory_map=False).num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([n], pa.int64())], names=["path", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import _check_arrow_table_timestamps_localize, to_arrow_schema

        for batch in batches:
            for content, before in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = feather.read_table(pa.BufferReader(content.as_buffer()), memory_map=False)
                if not found.num_rows:
                    continue
                found = _check_arrow_table_timestamps_localize(found, schema, True, zone).cast(to_arrow_schema(schema))
                found = found.append_column(RID, pa.array(range(before, before + found.num_rows), pa.int64()))
                yield from found.to_batches(max_chunksize=BATCH_ROWS)

    contents = spark.read.format("binaryFile").load(path).filter("length > 0")
    sizes, offsets, total = contents.select("path", "content").mapInArrow(counted, "path string, n long").collect(), [], 0
    for r in sorted(sizes):
        offsets.append((r.path, total))
        total += r.n
    met = contents.join(F.broadcast(spark.createDataFrame(offsets, "path string, before long")), "path")
    return met.select("content", "before").mapInArrow(rows, T.StructType([*schema.fields, T.StructField(RID, T.LongType())]))
