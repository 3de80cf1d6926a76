"""Sorted copies of tables: files by ranges of the keys, and a small table of what each file holds.

A reader that wants some keys, or a page of rows, opens the files whose bounds allow it and no other.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows to a file at most; a task's range is cut into several files, in order.
ROWS_PER_FILE = 1_000_000


def write_sorted(df: DataFrame, keys: list[str], folder: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """The rows sorted by keys in `folder/data`, and per file its first and last key and its rows in `folder/bounds`."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{folder}/data")
    data = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/data")
    rows = data.select(F.struct(*keys).alias("place"), F.input_file_name().alias("file"), F.col("_metadata.row_index").alias("at"))
    ends = rows.join(F.broadcast(rows.groupBy("file").agg(F.max("at").alias("end"))), "file").where("at = 0 OR at = end")  # a file is sorted, so its ends are its bounds
    bounds = ends.groupBy("file").agg(F.min("place").alias("first"), F.max("place").alias("last"), (F.max("at") + 1).alias("n_rows"))
    bounds.coalesce(1).write.parquet(f"{folder}/bounds")  # a row a file


def bounds_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/bounds")


def read_files(spark: SparkSession, folder: str, bounds: DataFrame) -> DataFrame:
    """The rows of the files that are left in bounds."""
    data = spark.read.parquet(f"{folder}/data")
    files = [r[0] for r in bounds.select("file").collect()]
    return spark.read.schema(data.schema).parquet(*files) if files else data.where(F.lit(False))


def read_values(spark: SparkSession, folder: str, key: str, values: Iterable) -> DataFrame:
    """The rows whose first key is one of the values."""
    values = sorted(set(values))
    bounds = bounds_of(spark, folder)
    hit = F.exists(F.array(*map(F.lit, values)), lambda v: F.col("first")[key].isNull() | v.between(F.col("first")[key], F.col("last")[key])) if values else F.lit(False)
    return read_files(spark, folder, bounds.where(hit)).where(F.col(key).isin(values))


def read_prefixes(spark: SparkSession, folder: str, key: str, prefixes: list[str]) -> DataFrame:
    """The rows whose first key, a text, begins with one of the prefixes."""
    low, high = F.col("first")[key], F.col("last")[key]
    may, test = F.lit(False), F.lit(False)
    for p in prefixes:
        may = may | ((high >= p) & ((low <= p) | F.startswith(low, F.lit(p))))
        test = test | F.startswith(key, F.lit(p))
    return read_files(spark, folder, bounds_of(spark, folder).where(may)).where(test)


def read_page(spark: SparkSession, folder: str, keys: list[str], page: int, size: int) -> DataFrame:
    """Page number `page` (from 0) by keys that are unique and not null: the files that hold its rows are found
    by counting files' rows, so a deep page reads no more than the first one.

    One row a file goes to the driver.
    """
    at, start, wanted, before = 0, page * size, [], 0
    for r in bounds_of(spark, folder).orderBy("first").collect():
        if at < start + size and at + r["n_rows"] > start:
            before = at if not wanted else before
            wanted.append(r["file"])
        at += r["n_rows"]
    data = spark.read.parquet(f"{folder}/data")
    if not wanted:
        return data.where(F.lit(False))
    return spark.read.schema(data.schema).parquet(*wanted).orderBy(*keys).offset(start - before).limit(size)
