"""Tables that are replaced source by source, several at once, with one commit.

A table lies in buckets by a hash of its source column. A commit writes the buckets that its sources fall
into anew, under its own number, and last of all one small file that names the bucket versions which
count from then on. Whoever reads sees all of a commit or none of it, rows of a source go from every
table in the same commit, and untouched buckets are neither read nor written. A commit carries the
number of its batch: a batch that comes again after a failure changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """A file that is there as a whole or not at all; False if another writer was first."""
    fs, p = _files(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    return bool(fs.rename(draft, p)) if not fs.exists(p) else False


def last_commit(spark: SparkSession, folder: str) -> dict:
    """The last commit: its number, the batches so far, and of each table its schema and bucket versions."""
    fs, p = _files(spark, f"{folder}/commits")
    paths = sorted(str(x.getPath()) for x in fs.listStatus(p) if str(x.getPath()).endswith(".json")) if fs.exists(p) else []
    return json.loads(spark.read.text(paths[-1], wholetext=True).first()[0]) if paths else {"number": 0, "batches": [], "tables": {}}


def _bucket(source: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(source.cast("string"), F.lit(""))), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, folder: str, name: str, table: dict, only: list[int] | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(table["schema"])
    paths = [f"{folder}/{name}/commit={v}/bucket={b}" for b, v in table["versions"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as of the last commit."""
    return _read(spark, folder, name, last_commit(spark, folder)["tables"][name])


def replace_sources(spark: SparkSession, folder: str, new: dict[str, DataFrame], source: str = "source_file", gone: DataFrame | None = None, batch: int | None = None, buckets: int = 64) -> list[int]:
    """Rows of new take the place of all old rows of their sources; sources in gone (a column of that name) lose
    their rows in all tables. Returns the numbers of the buckets that were written.

    A source that is new in one table is replaced in every table: its old children go in the same commit. The
    first commit fixes the number of buckets. Null sources are one source.
    """
    last = last_commit(spark, folder)
    if batch is not None and batch in last["batches"]:
        return []
    buckets = last.get("buckets", buckets)
    sources = gone.select(F.col(source).cast("string")) if gone is not None else None
    for df in new.values():
        mine = df.select(F.col(source).cast("string"))
        sources = mine if sources is None else sources.unionByName(mine)
    sources = sources.distinct().withColumn("_bucket", _bucket(F.col(source), buckets))
    touched = sorted(r[0] for r in sources.select("_bucket").distinct().collect())  # as many as there are buckets at most
    number, tables = last["number"] + 1, {}
    for name in sorted({*last["tables"], *new}):
        table = last["tables"].get(name)
        schema = new[name].schema if name in new else None
        rows = new.get(name)
        if table:
            there = _read(spark, folder, name, table, touched)
            replaced = sources.select(F.col(source).alias("_source"))
            old = there.join(replaced, F.col(source).cast("string").eqNullSafe(F.col("_source")), "left_anti")
            rows = old if rows is None else old.unionByName(rows)
            schema = schema or there.schema
        if touched:
            out = rows.withColumn("bucket", _bucket(F.col(source), buckets))
            out.repartition("bucket", F.xxhash64(*rows.columns) % 4).write.partitionBy("bucket").parquet(f"{folder}/{name}/commit={number}")
        fs, p = _files(spark, f"{folder}/{name}/commit={number}")
        written = [str(x.getPath().getName()).partition("=")[2] for x in fs.listStatus(p) if "bucket=" in str(x.getPath().getName())] if fs.exists(p) else []
        versions = {b: v for b, v in (table["versions"] if table else {}).items() if int(b) not in touched} | {b: number for b in written}
        tables[name] = {"schema": schema.jsonValue(), "versions": versions}
    state = {"number": number, "batches": ([*last["batches"], batch] if batch is not None else last["batches"])[-1000:], "buckets": buckets, "tables": tables}
    if not _put(spark, f"{folder}/commits/{number:012d}.json", json.dumps(state)):
        raise RuntimeError(f"another writer made commit {number}")
    return touched


def upsert(spark: SparkSession, folder: str, name: str, rows: DataFrame, keys: list[str], order: str, batch: int | None = None) -> list[int]:
    """Of each key the row with the largest `order` takes the place of the old one; of equal keys in rows one stays."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")
    keyed = newest.withColumn("_key", F.to_json(F.struct(*keys)))
    return replace_sources(spark, folder, {name: keyed}, "_key", batch=batch)


def follow(stream: DataFrame, folder: str, name: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Upserts what a stream brings, batch by batch; a batch that is replayed changes nothing."""
    return stream.writeStream.foreachBatch(lambda df, batch: upsert(df.sparkSession, folder, name, df, keys, order, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
