"""Objects written one by one: what is stored, what is refused, what an export that breaks off leaves, what is read back."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from pulsepress.sources import objects
from pulsepress.sources.fixtures import RAW


def files_below(root):
    return sorted(os.path.relpath(os.path.join(at, name), root) for at, _, names in os.walk(root) for name in names)


def stored(root):
    return [x for x in files_below(root) if not x.endswith(".crc") and x != objects.MARKER]


def test_binary_values_are_stored_as_they_are(spark, tmp_path):
    root = f"{tmp_path}/out"
    values = {f"k{i % 7}/{i}.bin": bytes([i, 0, 255, 10, 13]) * i for i in range(50)}
    df = spark.createDataFrame(list(values.items()), "key string, data binary").repartition(5)
    urls = objects.export_objects(df, f"file://{root}/", "https://x.example/", path="key", content="data")
    assert {r["path"]: r["url"] for r in urls.collect()} == {k: f"https://x.example/{k}" for k in values}
    assert stored(root) == sorted(values)
    for key, value in values.items():
        with open(f"{root}/{key}", "rb") as file:
            assert file.read() == value
    with open(f"{root}/{objects.MARKER}") as file:
        assert json.load(file) == {"objects": 50, "bytes": sum(map(len, values.values()))}


def test_null_and_other_texts(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", None), ("b.txt", ""), ("c/é ü.txt", "é\n 𝄞")], "path string, content string")
    objects.export_objects(df, str(tmp_path))
    assert stored(tmp_path) == ["a.txt", "b.txt", "c/é ü.txt"]
    assert (tmp_path / "a.txt").read_bytes() == b"" and (tmp_path / "c/é ü.txt").read_bytes() == "é\n 𝄞".encode()


def test_an_export_again_replaces_objects_and_an_empty_one_is_marked(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "one"), ("b.txt", "two")], "path string, content string")
    objects.export_objects(df, str(tmp_path))
    objects.export_objects(df.filter("path = 'a.txt'").withColumn("content", F.lit("new")), str(tmp_path))
    assert (tmp_path / "a.txt").read_text() == "new" and (tmp_path / "b.txt").read_text() == "two"
    assert objects.export_objects(df.limit(0), f"{tmp_path}/none").count() == 0
    assert files_below(f"{tmp_path}/none") == [objects.MARKER]


@pytest.mark.parametrize("key", ["../up.txt", "a/../../up.txt", "/root.txt", "a//b", "a/", "", None, ".", "a\\b", "a\nb", "_EXPORTED"])
def test_keys_that_leave_the_root_are_refused(spark, tmp_path, key):
    df = spark.createDataFrame([("good.txt", "x"), (key, "y")], "path string, content string")
    with pytest.raises(ValueError):
        objects.export_objects(df, f"{tmp_path}/root")
    assert files_below(tmp_path) == []


def test_two_rows_of_one_key_are_refused(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "x"), ("b.txt", "y"), ("a.txt", "x")], "path string, content string")
    with pytest.raises(ValueError, match="several rows"):
        objects.export_objects(df.repartition(3), str(tmp_path))
    assert files_below(tmp_path) == []


def test_an_export_that_breaks_off_leaves_no_marker_and_no_parts(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "x"), ("b.txt", "y")], "path string, content string")
    objects.export_objects(df, str(tmp_path))
    # A folder is in the place of an object.
    os.makedirs(tmp_path / "c.txt" / "inner")
    with pytest.raises(Exception, match="c.txt"):
        objects.export_objects(df.union(spark.createDataFrame([("c.txt", "z")], df.schema)), str(tmp_path))
    assert stored(tmp_path) == ["a.txt", "b.txt"] and objects.MARKER not in files_below(tmp_path)


def test_content_types_and_schemes():
    files, folder = objects.file_system("file:///tmp/x/")
    assert files.type_name == "local" and folder == "/tmp/x"
    assert objects.file_system("/tmp/x")[1] == objects.file_system("file:/tmp/x/")[1] == "/tmp/x"


def test_other_columns_are_refused(spark, tmp_path):
    spark.dataSource.register(objects.ObjectSink)
    with pytest.raises(Exception, match="columns must be"):
        spark.range(3).write.format(objects.FORMAT).mode("append").option("path", str(tmp_path)).save()


def test_objects_are_read_back_without_a_list_of_them_in_the_driver(spark, tmp_path):
    texts = {i: f"text {i} é" * (i % 5) for i in range(600)}
    documents = [(i, text, "en", f"src{i % 3}", len(text)) for i, text in texts.items()]
    for name, some in {"documents": documents, "embeddings": [], "labels": []}.items():
        spark.createDataFrame(some, RAW[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    result = entry_points.queries()["s9_objects_read_back"](spark, str(tmp_path))
    # Spark's own readers hold a status of each of these files.
    assert len(result.inputFiles()) < 200
    wanted = {f"src{i % 3}/{i}.txt": text.encode() for i, text in texts.items()}
    rows = result.collect()
    assert len(rows) == 600
    assert {r["path"]: (r["digest"], r["bytes"]) for r in rows} == {
        path: (hashlib.md5(text).hexdigest(), len(text)) for path, text in wanted.items()
    }


def test_what_is_read_back_is_what_was_written(spark, tmp_path):
    values = {
        "a.txt": b"", "b.txt.gz": b"not packed", "_c/.d": b"\x00\xff", "e/_EXPORTED": b"x", "f g/h%20i/j+k/l.m/n": b"deep",
        "o=1/p.parquet": b"PAR1", "é/ü.txt": "é".encode(),
    }
    # More than a batch may hold, each.
    large = {f"large/{i}.bin": bytes([i]) * (objects.BATCH_BYTES + i) for i in range(3)}
    df = spark.createDataFrame(list((values | large).items()), "path string, content binary")
    for root in (f"{tmp_path}/plain", f"file://{tmp_path}/uri/"):
        objects.export_objects(df, root)
        rows = objects.read_objects(spark, root).collect()
        assert {r["path"]: bytes(r["content"]) for r in rows} == values | large and len(rows) == len(df.collect())
        assert all(r["length"] == len(r["content"]) for r in rows)


def test_many_names_in_a_folder_and_many_folders_are_listed(spark, tmp_path):
    for i in range(objects.BATCH_ROWS + 7):
        (tmp_path / f"{i}").write_bytes(b"")
    for i in range(300):
        (tmp_path / f"deep{i}" / "er").mkdir(parents=True)
        (tmp_path / f"deep{i}" / "er" / "x").write_bytes(b"xyz")
    found, number, size = objects.listed(spark, str(tmp_path))
    wanted = {f"{i}": 0 for i in range(objects.BATCH_ROWS + 7)} | {f"deep{i}/er/x": 3 for i in range(300)}
    assert {r["path"]: r["size"] for r in found.collect()} == wanted
    assert (found.count(), number, size) == (len(wanted), len(wanted), 900)


def test_an_empty_export_is_read_back_and_a_missing_one_is_an_error(spark, tmp_path):
    objects.export_objects(spark.createDataFrame([], "path string, content string"), f"{tmp_path}/none")
    assert objects.read_objects(spark, f"{tmp_path}/none").collect() == []
    with pytest.raises(Exception, match="No such file"):
        objects.read_objects(spark, f"{tmp_path}/missing")
