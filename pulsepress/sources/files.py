"""Batches from files, and files from DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsepress.functions.dates import RFC3339_PATTERN
from pulsepress.operators.ingest import align
from pulsepress.sources.scratch import session_settings

# Wanted size of a data file after compaction.
FILE_BYTES = 256 * 1024 * 1024

# The default of the text writers drops microseconds.
EXACT_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
_CSV_LISTS = "|"


def load_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A batch with the columns of a table; columns the files lack are NULL."""
    return align(spark.read.parquet(path), schema)


def load_json(spark: SparkSession, path: str, schema: T.StructType, broken: str | None = None) -> DataFrame:
    """A batch from one JSON object per line; nothing is inferred.

    ``broken`` names a further column for the text of lines that are no such object or hold a value
    of another type; without it what can be read of them is kept and the rest is NULL.
    """
    return _reader(spark, _nullable(schema), broken).json(path)


def load_csv(
    spark: SparkSession, path: str, schema: T.StructType, broken: str | None = None, multi_line: bool = True
) -> DataFrame:
    """A batch from CSV files with a header. Lists are JSON, or plain text with ``|`` between elements.

    With ``multi_line`` a text may hold line ends, and a file is read by one task; without, large files
    are split. ``broken`` as in ``load_json``.
    """
    flat = T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema]
    )
    raw = _reader(spark, flat, broken).csv(path, header=True, multiLine=multi_line, escape='"')
    return raw.select(*[_from_csv(f) for f in schema], *([broken] if broken else []))


def _reader(spark: SparkSession, schema: T.StructType, broken: str | None):
    if not broken:
        return spark.read.schema(schema)
    whole = T.StructType([*schema, T.StructField(broken, T.StringType())])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken)


def save_csv(df: DataFrame, path: str) -> None:
    flat = [
        F.to_json(F.col(f.name), {"ignoreNullFields": "false"}).alias(f.name)
        if isinstance(f.dataType, T.ArrayType)
        else F.col(f.name)
        for f in df.schema
    ]
    writer = df.select(*flat).write.option("timestampNTZFormat", EXACT_TIMESTAMP)
    writer.csv(path, header=True, escape='"')


def save_json(df: DataFrame, path: str) -> None:
    df.write.option("timestampNTZFormat", EXACT_TIMESTAMP).json(path)


def _from_csv(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.ArrayType):
        text = F.col(field.name)
        plain = F.split(text, re.escape(_CSV_LISTS)).cast(field.dataType)
        return F.when(text.startswith("["), F.from_json(text, field.dataType)).otherwise(plain).alias(field.name)
    return F.col(field.name)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def json_rows(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One ``json`` text per row: timestamps in RFC 3339 form, NULL fields left out."""
    names = list(columns or df.columns)
    return df.select(F.to_json(F.struct(*names), {"timestampNTZFormat": RFC3339_PATTERN}).alias("json"))


def compact(spark: SparkSession, source: str, target: str, file_bytes: int = FILE_BYTES) -> int:
    """Rewrite a parquet folder with many small files as files of about ``file_bytes``.

    Reads are packed up to that size per task, so rows move to no other task. Returns the number
    of files the source had.
    """
    files = len(spark.read.parquet(source).inputFiles())
    packing = {
        "spark.sql.files.maxPartitionBytes": str(file_bytes),
        "spark.sql.files.openCostInBytes": "0",
        "spark.sql.files.minPartitionNum": "1",
    }
    with session_settings(spark, packing):
        spark.read.parquet(source).write.parquet(target)
    return files
