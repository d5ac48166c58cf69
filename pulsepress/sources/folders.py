"""Folders and small files of any file system that Spark reaches, through Hadoop's client."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a folder or file with all that is in it; False when it is not there."""
    files, place = _at(spark, path)
    return bool(files.delete(place, True))


def children(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Path and time of change (seconds) of what lies directly in a folder; nothing when it is not there."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return []
    return [(str(x.getPath().toString()), x.getModificationTime() / 1000) for x in files.listStatus(place)]


def same(spark: SparkSession, one: str, other: str) -> bool:
    """Whether two paths name one place, with or without the scheme of the file system."""
    left, right = (files.makeQualified(place).toUri().getPath() for files, place in (_at(spark, one), _at(spark, other)))
    return left.rstrip("/") == right.rstrip("/")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all."""
    files, place = _at(spark, path)
    _, part = _at(spark, f"{path}.part")
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(place, False)
    if not files.rename(part, place):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    files, place = _at(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
