"""Substring search by stored trigrams: the rarest trigrams of what is looked for name the candidates, and only
the files that hold candidates are read and searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.plans.sorted_copy import bounds_of, read_files, read_values, write_sorted
from ledgerspark.plans.stored import stored

#: So many of the rarest trigrams are intersected.
RAREST = 4


def _grams(c):
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("(?s)(?=(...))"), F.lit(1)))


def build_substring_index(docs: DataFrame, key: str, text: str, folder: str, columns: list[str] | None = None, rows_per_file: int = 1_000_000) -> None:
    """Postings (gram, key) and counts by gram, and a copy of the columns sorted by key."""
    cut = stored(docs.where(F.col(text).isNotNull()).select(_grams(F.col(text)).alias("g"), F.col(key).alias("key")), "grams")  # the sort samples its input: texts are cut once
    grams = cut.select(F.explode("g").alias("gram"), "key")  # each gram of a row once: one shuffle, that of the sort
    write_sorted(grams, ["gram", "key"], f"{folder}/postings", rows_per_file)
    postings = docs.sparkSession.read.parquet(f"{folder}/postings/data")
    write_sorted(postings.groupBy("gram").agg(F.count("*").alias("n")), ["gram"], f"{folder}/counts")
    write_sorted(docs.select(*dict.fromkeys([key, text, *(columns or [])])), [key], f"{folder}/rows", rows_per_file)


def candidates(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """(key) of all rows that have the rarest trigrams of a text of three characters and more."""
    wanted = {part.lower()[i : i + 3] for i in range(len(part) - 2)}
    counts = read_values(spark, f"{folder}/counts", "gram", wanted).collect()  # a row a trigram
    if len(counts) < len(wanted):  # some trigram occurs nowhere
        return spark.read.parquet(f"{folder}/postings/data").where(F.lit(False)).select("key")
    rarest = [r["gram"] for r in sorted(counts, key=lambda r: (r["n"], r["gram"]))[:RAREST]]
    return read_values(spark, f"{folder}/postings", "gram", rarest).groupBy("key").agg(F.countDistinct("gram").alias("_n")).where(F.col("_n") == len(rarest)).select("key")


def rows_with(spark: SparkSession, folder: str, key: str, text: str, part: str) -> DataFrame:
    """The stored rows whose text contains the part, whatever the case; parts under three characters scan."""
    test = F.contains(F.lower(text), F.lit(part.lower()))
    if len(part) < 3:
        return spark.read.parquet(f"{folder}/rows/data").where(test)
    found = candidates(spark, folder, part)
    # which files hold candidates: bounds do not overlap, so a candidate counts for one file (or two where keys repeat)
    bounds = bounds_of(spark, f"{folder}/rows")
    near = bounds.join(found, F.col("key").between(F.col("first")[key], F.col("last")[key]), "left_semi")
    return read_files(spark, f"{folder}/rows", near).join(found.withColumnRenamed("key", key), key, "left_semi").where(test)
