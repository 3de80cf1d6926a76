"""Ranked text search: postings are made per query terms only, so the scan keeps few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.expressions import words_of

K1, B = 1.2, 0.75


def _frequency(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == term))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, score) of every row with a term; smaller is better, as full-text engines report it."""
    terms = sorted({t.lower() for t in terms})
    words = docs.select(key, words_of(F.coalesce(text, F.lit(""))).alias("w"))
    hits = words.select(key, F.size("w").alias("size"), *[_frequency(t).alias(f"f{i}") for i, t in enumerate(terms)])
    total = hits.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))])  # one row
    rows = hits.where(sum(F.col(f"f{i}") for i in range(len(terms))) > 0).join(F.broadcast(total))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        f = F.col(f"f{i}")
        score = score - F.when(idf > 0, idf).otherwise(1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return rows.select(key, score.alias("score"))


def suggest(sources: list[tuple[str, DataFrame, str]], typed: str, limit: int) -> DataFrame:
    """Values that begin with, then that contain, what was typed; per field and value once."""
    typed = typed.lower()
    parts = [df.select(F.lit(field).alias("field"), F.col(c).alias("value")).distinct() for field, df, c in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where(F.contains(F.lower("value"), F.lit(typed))).withColumn("priority", F.when(F.startswith(F.lower("value"), F.lit(typed)), 0).otherwise(1))
    return out.orderBy("priority", "field", "value").limit(limit)
