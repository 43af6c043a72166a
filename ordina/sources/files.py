"""Bytes of single files, by Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """A file itself, or a folder's files by name, without hidden ones."""
    where, system = _at(spark, path)
    if not system.exists(where):
        raise FileNotFoundError(path)
    if not system.getFileStatus(where).isDirectory():
        return [path]
    return sorted(s.getPath().toString() for s in system.listStatus(where) if s.isFile() and s.getPath().getName()[0] not in "._")


def rename(spark: SparkSession, old: str, new: str) -> None:
    where, system = _at(spark, old)
    if not system.rename(where, _at(spark, new)[0]):
        raise OSError(f"could not rename {old}")


def head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, or of a folder's first file; nothing else is read."""
    found = names(spark, path)
    if not found:
        return b""
    where, system = _at(spark, found[0])
    stream, out = system.open(where), bytearray()
    try:
        while len(out) < size and (byte := stream.read()) >= 0:
            out.append(byte)
    finally:
        stream.close()
    return bytes(out)


def content(spark: SparkSession, path: str) -> bytes:
    """One whole file: for formats that have to be parsed at once, by way of the driver."""
    found = spark.read.format("binaryFile").load(path).select("content").limit(1).collect()
    if not found:
        raise FileNotFoundError(path)
    return bytes(found[0].content)


def store(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a local file, or by Hadoop where the path names a file system."""
    if ":/" not in path:
        with open(path, "wb") as out:
            out.write(data)
        return
    where, system = _at(spark, path)
    stream = system.create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
