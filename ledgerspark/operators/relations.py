"""Joins and windows that the budget queries need beyond plain equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys before they are grouped or picked: a task then holds its own keys only, where of rows in no
    order each would hold nearly all keys of its file. Partitions keep to the advised size, so a key with very many
    rows may lie in several."""
    return df.withColumn("_deal", F.hash(*keys)).hint("rebalance", "_deal").drop("_deal")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; nulls in keys form a group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def best_with_ties(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return df.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def having_all(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Keys that have a row for every one of the values (relational division)."""
    return df.where(F.col(column).isin(values)).groupBy(key).agg(F.countDistinct(column).alias("n")).where(F.col("n") == len(set(values))).select(key)


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, at: str, first: str, last: str, size: int = 256) -> DataFrame:
    """Points within a range of their key, both ends included.

    A range has a row for each stretch of `size` numbers that it touches and meets points by key and
    stretch, so a key with very many points or a range over all of them is dealt over many tasks.
    """
    stretch = lambda c: F.floor(F.col(c) / size)
    touched = ranges.where(F.col(first) <= F.col(last)).withColumn("_stretch", F.explode(F.sequence(stretch(first), stretch(last))))
    return points.withColumn("_stretch", stretch(at)).join(touched, [key, "_stretch"]).where(F.col(at).between(F.col(first), F.col(last))).drop("_stretch")


def matching_either(left: DataFrame, right: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Rows whose key equals either of two columns: two keys a row on the right, one equi join, never a nested loop."""
    keys = right.select(F.explode(F.array(first, second)).alias(key)).distinct()
    return left.join(keys, key, "left_semi")


def fill_from_unambiguous(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Missing values taken from rows with equal keys, where those agree on one value."""
    known = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(column).alias("_a"), F.max(column).alias("_b")).where("_a = _b").select(*keys, "_a")
    return df.join(known, keys, "left").withColumn(column, F.coalesce(column, "_a")).drop("_a")


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Gaps and islands: consecutive rows with the same value, as first and last place and length."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    marked = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w))
    return marked.groupBy(*keys, "run", value).agg(F.min(order).alias("first_place"), F.max(order).alias("last_place"), F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with equal keys; the others stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def semi(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Rows whose key the other side has."""
    return left.join(right.select(F.col(other).alias("_o")), F.col(key) == F.col("_o"), "left_semi")


def anti(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Rows whose key the other side lacks; nulls of the other side match nothing and hide nothing."""
    return left.join(right.where(F.col(other).isNotNull()).select(F.col(other).alias("_o")), F.col(key) == F.col("_o"), "left_anti")


def indexed_or_scanned(df: DataFrame, key: str, index: DataFrame, known: DataFrame, scan: Column) -> DataFrame:
    """Rows that the index has, and of the keys it knows nothing of those that a scan finds."""
    hits = semi(df, index, key, key).withColumn("found_by", F.lit("index"))
    return hits.unionByName(anti(df, known, key, key).where(scan).withColumn("found_by", F.lit("scan")))


def with_titles(texts: DataFrame, key: str, text: str, titles: DataFrame, title_key: str, title: str, words: int) -> DataFrame:
    """(title key, text key) where the title's first words follow each other in the text.

    Both sides become runs of so many words, which are joined by equality: no text meets every title.
    """
    run = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]+)"), 1)
    heads = titles.select(title_key, F.slice(run(F.col(title)), 1, words).alias("_w")).where(F.size("_w") == words)
    places = F.sequence(F.lit(1), F.greatest(F.size("_w") - (words - 1), F.lit(1)))
    runs = F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice("_w", i, words), " ")))
    shingles = texts.select(key, run(F.col(text)).alias("_w")).select(key, F.explode(runs).alias("_s"))
    return shingles.join(heads.select(title_key, F.array_join("_w", " ").alias("_s")), "_s").select(title_key, key).distinct()
