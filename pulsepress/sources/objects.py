"""A sink that writes every row as an object of its own (key, content, content type), and a reader of such objects."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from pulsepress.functions.text import content_type, public_url
from pulsepress.sources.scratch import scratch_folder

FORMAT = "pulsepress_objects"
#: Written last, with the numbers of objects and bytes; an export without it did not finish.
MARKER = "_EXPORTED"
#: The names that Spark's users give to schemes which Arrow knows by others.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
LAYOUT = "path string, content binary, content_type string"
#: What a folder holds; folders have no size.
LISTED = "path string, size bigint"
STORED = "path string, content binary, length bigint"
#: Folders that one task lists, objects and bytes that one task reads, beside a few tasks for each core.
TASK_FOLDERS, TASK_OBJECTS, TASK_BYTES = 1_000, 10_000, 64 << 20
#: Entries, and bytes of content, of one Arrow batch; it ends with the object that reaches them.
BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the folder in it; a bare path is local."""
    scheme, parted, rest = root.rstrip("/").partition("://")
    if not parted:
        return pafs.LocalFileSystem(), scheme.removeprefix("file:")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def _in_place(files: pafs.FileSystem) -> bool:
    """Whether an object appears as a whole when it is closed, so that it needs no rename."""
    return files.type_name in ("s3", "gcs", "abfs")


def bad_key(key: Column) -> Column:
    """Why a key cannot be used; NULL when it can."""
    parts = F.split(key, "/")
    return (
        F.when(key.isNull() | (key == ""), "no key")
        .when(key.contains("\\") | key.rlike(r"[\x00-\x1f\x7f]"), "character not allowed")
        .when(F.exists(parts, lambda x: x.isin("", ".", "..")), "empty part, . or ..")
        .when(parts[0] == MARKER, "name of the marker")
    )


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote."""

    objects: int
    size: int


class ObjectWriter(DataSourceArrowWriter):
    """Writes batches of (path, content, content_type) below a root.

    An object is there as a whole or not at all: object stores publish it when it is closed, elsewhere a
    file is written beside its place and renamed. A task that runs again writes the same keys again. The
    sizes that the file system reports are held against the sizes written.
    """

    def __init__(self, root: str) -> None:
        self.root = root
        # Called by the driver before the first task: an older marker says nothing about this export.
        files, folder = file_system(root)
        if files.get_file_info(f"{folder}/{MARKER}").type != pafs.FileType.NotFound:
            files.delete_file(f"{folder}/{MARKER}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = file_system(self.root)
        whole, made, objects, size = _in_place(files), set(), 0, 0
        for batch in iterator:
            for row in range(batch.num_rows):
                path, content, kind = (column[row].as_py() for column in batch.columns)
                content, target = content or b"", f"{folder}/{path}"
                parent = target.rsplit("/", 1)[0]
                if not whole and parent not in made:
                    files.create_dir(parent, recursive=True)
                    made.add(parent)
                _put(files, target, content, kind, whole)
                objects, size = objects + 1, size + len(content)
        return Written(objects, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [m for m in messages if m]
        files, folder = file_system(self.root)
        if not _in_place(files):
            files.create_dir(folder, recursive=True)
        counts = {"objects": sum(m.objects for m in done), "bytes": sum(m.size for m in done)}
        _put(files, f"{folder}/{MARKER}", json.dumps(counts).encode(), "application/json", _in_place(files))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Objects that are whole stay, as they may have replaced older ones; there is no marker."""


def _put(files: pafs.FileSystem, target: str, content: bytes, kind: str | None, whole: bool) -> None:
    place = target if whole else f"{target}.{uuid.uuid4().hex}.part"
    metadata = {"Content-Type": kind} if kind and whole else None
    try:
        with files.open_output_stream(place, metadata=metadata) as out:
            out.write(content)
        stored = files.get_file_info(place).size
        if stored != len(content):
            raise OSError(f"{target}: {stored} bytes stored of {len(content)}")
        if not whole:
            files.move(place, target)
    except BaseException:
        if not whole and files.get_file_info(place).type != pafs.FileType.NotFound:
            files.delete_file(place)
        raise


class ObjectSink(DataSource):
    """``df.write.format(FORMAT).option("path", root)`` for rows of ``LAYOUT``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ObjectWriter:
        if [f"{f.name} {f.dataType.simpleString()}" for f in schema] != LAYOUT.split(", "):
            raise ValueError(f"the columns must be {LAYOUT}")
        return ObjectWriter(self.options["path"])


def checked_keys(df: DataFrame, path: str = "path") -> None:
    """Raise ValueError when a key cannot be used or occurs twice. Only the key column is read."""
    keys = df.groupBy(F.col(path).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    wrong = keys.select("key", F.coalesce(bad_key(F.col("key")), F.when(F.col("rows") > 1, "several rows")).alias("why"))
    first = wrong.filter(F.col("why").isNotNull()).limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{x['key']!r}: {x['why']}" for x in first))


def export_objects(
    df: DataFrame, root: str, base_url: str | None = None, path: str = "path", content: str = "content"
) -> DataFrame:
    """Write the text or binary ``content`` of every row to its own key below ``root``.

    Returns (path, url) of all items. Texts are stored as UTF-8, NULL as an empty object. The content
    type follows the extension of the key; object stores keep it with the object. All keys are checked
    before anything is written: keys that leave the root and repeated ones raise ValueError. The tasks
    write in parallel; ``MARKER`` is written when all are done.
    """
    checked_keys(df, path)
    spark = df.sparkSession
    spark.dataSource.register(ObjectSink)
    key = F.col(path)
    rows = df.select(key.alias("path"), F.col(content).cast("binary").alias("content"), content_type(key).alias("content_type"))
    rows.write.format(FORMAT).mode("append").option("path", root).save()
    return df.select(key.alias("path"), public_url(key, base_url).alias("url"))


def _entries(files: pafs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Name and size of what lies directly in a folder. A local folder is not held as a whole."""
    if files.type_name == "local":
        with os.scandir(folder) as entries:
            for x in entries:
                yield x.name, None if x.is_dir() else x.stat().st_size
    else:
        for x in files.get_file_info(pafs.FileSelector(folder)):
            yield x.base_name, None if x.type == pafs.FileType.Directory else x.size


def listed(spark: SparkSession, root: str) -> tuple[DataFrame, int, int]:
    """(path, size) of all objects below a root, their number and their bytes.

    Folders are listed by the executors, one level after the other, into a scratch folder: the driver
    holds numbers only, however many objects and folders there are.
    """

    def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = file_system(root)
        for folder in (x for batch in batches for x in batch.column(0).to_pylist()):
            for some in batched(_entries(files, f"{top}/{folder}".rstrip("/")), BATCH_ROWS):
                names, sizes = zip(*some)
                paths = pa.array([f"{folder}/{x}" if folder else x for x in names], pa.string())
                yield pa.record_batch({"path": paths, "size": pa.array(sizes, pa.int64())})

    folders, to_list, levels, objects, size = spark.range(1).select(F.lit("").alias("path")), 1, [], 0, 0
    while to_list:
        levels.append(scratch_folder(spark))
        tasks = min(to_list, _tasks(spark, to_list / TASK_FOLDERS))
        folders.repartition(tasks).mapInArrow(list_folders, LISTED).write.parquet(levels[-1])
        level = spark.read.schema(LISTED).parquet(levels[-1])
        folders = level.filter("size IS NULL").select("path")
        more = level.agg(F.count("size"), F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("size").isNull())).first()
        objects, size, to_list = objects + more[0], size + more[1], more[2]
    every = spark.read.schema(LISTED).parquet(*levels)
    return every.filter(F.col("size").isNotNull() & (F.col("path") != MARKER)), objects, size


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length) of all objects below a root but ``MARKER``; the paths are the keys they were written to.

    Spark's ``binaryFile`` keeps the status of every file in the driver. Here the objects are listed when
    this is called, without that, and read by the tasks, a few megabytes at a time, when the rows are used.
    """
    keys, objects, size = listed(spark, root)
    tasks = _tasks(spark, max(objects / TASK_OBJECTS, size / TASK_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(root)
        for batch in batches:
            paths, contents, held = [], [], 0
            for path in batch.column(0).to_pylist():
                # Without compression given, what ends in .gz would be unpacked.
                with files.open_input_stream(f"{folder}/{path}", compression=None) as stream:
                    content = stream.read()
                paths.append(path)
                contents.append(content)
                held += len(content)
                if held >= BATCH_BYTES:
                    yield _stored(paths, contents)
                    paths, contents, held = [], [], 0
            yield _stored(paths, contents)

    return keys.select("path").repartition(tasks, "path").mapInArrow(read, STORED)


def _stored(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
    lengths = pa.array(map(len, contents), pa.int64())
    return pa.record_batch({"path": pa.array(paths, pa.string()), "content": pa.array(contents, pa.binary()), "length": lengths})


def _tasks(spark: SparkSession, wanted: float) -> int:
    return max(4 * spark.sparkContext.defaultParallelism, int(wanted) + 1)
