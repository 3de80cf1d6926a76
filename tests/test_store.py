"""Tables replaced source by source: cascades, untouched buckets, replays, broken commits and streams."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerspark.plans.stored import shared_folder
from ledgerspark.streaming import store


def rows(spark, folder, name):
    return sorted(map(tuple, store.read_store(spark, folder, name).collect()), key=repr)


def files(folder, name):
    top = f"{folder}/{name}".removeprefix("file:")
    return {os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


def test_replacing_and_removing_sources_with_their_children(spark):
    folder = shared_folder(spark, "store")
    lines = spark.createDataFrame([(f"f{i % 40}", i) for i in range(400)] + [(None, -1)], "source_file string, n int")
    pages = spark.createDataFrame([(f"f{i % 40}", f"page {i}") for i in range(100)], "source_file string, text string")
    store.replace_sources(spark, folder, {"lines": lines, "pages": pages}, batch=0, buckets=16)
    before = files(folder, "lines") | files(folder, "pages")
    fresh = spark.createDataFrame([("f3", 1000), (None, -2)], "source_file string, n int")
    touched = store.replace_sources(spark, folder, {"lines": fresh}, gone=spark.createDataFrame([("f5",), ("unknown",)], "source_file string"), batch=1)
    gone = {"f3", "f5", None}
    want = [(f"f{i % 40}", i) for i in range(400) if f"f{i % 40}" not in gone] + [("f3", 1000), (None, -2)]
    assert rows(spark, folder, "lines") == sorted(want, key=repr)
    assert rows(spark, folder, "pages") == sorted(((f"f{i % 40}", f"page {i}") for i in range(100) if f"f{i % 40}" not in gone), key=repr)
    new = (files(folder, "lines") | files(folder, "pages")) - before
    assert before <= files(folder, "lines") | files(folder, "pages")
    assert len(touched) <= 4 and {int(f.split("bucket=")[1].split("/")[0]) for f in new} <= set(touched)
    assert store.replace_sources(spark, folder, {"lines": lines}, batch=1) == []  # the batch comes again
    assert rows(spark, folder, "lines") == sorted(want, key=repr)
    store.replace_sources(spark, folder, {}, gone=lines.select("source_file"))
    assert rows(spark, folder, "lines") == rows(spark, folder, "pages") == []


def test_a_commit_that_breaks_off_shows_nothing(spark, monkeypatch):
    folder = shared_folder(spark, "store")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source_file string, n int")
    store.replace_sources(spark, folder, {"t": df})
    put = store._put
    monkeypatch.setattr(store, "_put", lambda *_: False)
    with pytest.raises(RuntimeError):
        store.replace_sources(spark, folder, {"t": df.withColumn("n", F.lit(9))})
    assert rows(spark, folder, "t") == [("a", 1), ("b", 2)]
    monkeypatch.setattr(store, "_put", put)
    assert put(spark, f"{folder}/commits/000000000001.json", "{}") is False  # a commit's number is taken once


def test_upserts_from_a_stream(spark, tmp_path):
    folder, schema = shared_folder(spark, "store"), "k long, v string, at long"
    for n, part in enumerate(([(1, "a", 1), (2, "b", 1), (1, "newer", 2)], [(2, "c", 5), (3, "d", 1)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        store.follow(stream, folder, "t", ["k"], "at", str(tmp_path / "checkpoint")).awaitTermination()
        assert store.last_commit(spark, folder)["number"] == n + 1
    assert sorted((r["k"], r["v"]) for r in store.read_store(spark, folder, "t").collect()) == [(1, "newer"), (2, "c"), (3, "d")]
