"""Many keywords over many texts in one pass: runs of words as long as keywords are, met by equality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.expressions import words_of


def word_runs(words: Column, n: int) -> Column:
    """array<string>: each run of n words once, joined by a space."""
    if n == 1:
        return F.array_distinct(words)
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.array_distinct(F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>")))


def keyword_hits(texts: DataFrame, key: str, text: str, keywords: DataFrame, keyword: str) -> DataFrame:
    """(key, keyword) once for every text that has the keyword as whole words in a row; case and signs do not count.

    The plan is the same for any number of keywords; texts are cut once for each length in words that
    keywords have. Keywords without a letter or digit find nothing, null texts are empty.
    """
    wanted = keywords.select(F.col(keyword), words_of(F.col(keyword)).alias("_w")).where(F.size("_w") > 0).select(keyword, F.array_join("_w", " ").alias("_run"), F.size("_w").alias("_n")).distinct()
    lengths = sorted(r[0] for r in wanted.select("_n").distinct().collect())  # a few numbers
    if not lengths:
        return texts.select(key).crossJoin(keywords.select(keyword).limit(0))
    cut = texts.select(F.col(key), words_of(F.coalesce(text, F.lit(""))).alias("_w"))
    runs = reduce(lambda a, b: F.concat(a, b), [word_runs(F.col("_w"), n) for n in lengths])
    return cut.select(key, F.explode(runs).alias("_run")).join(wanted.select(keyword, "_run"), "_run").select(key, keyword)
