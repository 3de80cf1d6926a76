"""Repair of fact rows: backfills, cleanups, reconciliation and consolidation into submissions and amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import fixed_values as V
from ledgerspark.functions import text as T
from ledgerspark.functions.expressions import any_of


def seeded(table: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """The table and the seeds it lacks."""
    return table.unionByName(seeds.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def dimension_from_facts(dimension: DataFrame, facts: DataFrame, key: str, keywords: list[tuple[str, str]]) -> DataFrame:
    """Values that the facts have and the dimension lacks, with a category by keyword, else `other`."""
    found = facts.where(F.coalesce(key, F.lit("")) != "").select(key).distinct().join(dimension.select(key), key, "left_anti")
    category = F.coalesce(T.first_hit(F.lower(key), keywords), F.lit("other"))
    return dimension.unionByName(found.withColumn("category", category), allowMissingColumns=True)


def without_aggregates(rows: DataFrame, title: str, labels: list[str] | None = None, beginnings: list[str] | None = None) -> DataFrame:
    """Rows whose title is no label of a sum; a missing title is none."""
    c = F.col(title)
    labels, beginnings = V.JUNK_TITLES if labels is None else labels, V.JUNK_BEGINNINGS if beginnings is None else beginnings
    return rows.where(~F.coalesce(c.isin(labels) | any_of(F.startswith(c, F.lit(b)) for b in beginnings), F.lit(False)))


def without_leaked_headers(rows: DataFrame, text: str, patterns: list[str], least: int = 25) -> DataFrame:
    """Texts without headers that leaked in; rows of which less than `least` characters are left go."""
    return rows.withColumn(text, T.without_headers(F.col(text), patterns, least)).where(F.col(text).isNotNull())


def plausible_organization(organization: Column, pe: Column) -> Column:
    """Null for a number, and for a letter that is not the first one behind the program's digits; else unchanged."""
    letter = F.regexp_extract(pe, r"^[0-9]{7}([A-Z])", 1)
    wrong = organization.rlike(r"^[0-9]{1,10}$") | (organization.rlike(r"^[A-Za-z]$") & (F.upper(organization) != F.upper(F.coalesce(letter, F.lit("")))))
    return F.when(~F.coalesce(wrong, F.lit(False)), organization)


def without_alternates(rows: DataFrame, file: str) -> DataFrame:
    """Rows of files that repeat a summary exhibit under its name and an a."""
    return rows.where(~F.coalesce(F.rlike(file, F.lit(r"(?i)(?:^|/)(?:c1|m1|o1|p1|p1r|r1|rf1)a\.\w+$")), F.lit(False)))


def filled_organization(organization: Column, path: Column, by_folder: list[tuple[str, str]]) -> Column:
    return F.coalesce(F.when(F.trim(organization) != "", organization), T.first_hit(F.lower(path), by_folder), F.lit("Unspecified"))


def against_total(services: DataFrame, total: DataFrame, key: str, amount: str, tolerance: float) -> DataFrame:
    """Sums of the parts by key against the reported total, and whether they differ by more than the tolerance."""
    parts = services.groupBy(key).agg(F.sum(amount).alias("_p")).join(total.groupBy(key).agg(F.sum(amount).alias("_t")), key)
    parts = parts.select(key, F.col("_p").cast("double").alias("parts"), F.col("_t").cast("double").alias("total"))
    return parts.withColumn("mismatch", F.abs(F.col("parts") - F.col("total")) > tolerance * F.abs("total"))


def submitted_amounts(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target_fy, kind, amount, precedence): the filled cells of amount_fyYYYY_kind columns, zero and null dropped."""
    named = {c: n for c in wide.columns if (n := T.amount_column(c))}
    cells = F.array(*[F.struct(F.lit(y).alias("target_fy"), F.lit(k).alias("kind"), F.col(c).cast("double").alias("amount"), F.lit(V.AMOUNT_KINDS.index(k) + 1 if k in V.AMOUNT_KINDS else 99).alias("precedence")) for c, (y, k) in named.items()])
    return wide.select(*keys, F.inline(F.filter(cells, lambda x: F.coalesce(x["amount"], F.lit(0.0)) != 0)))


def best_amounts(amounts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and year the amount of the best kind."""
    best = F.min_by(F.struct("kind", "amount"), F.struct("precedence", "kind"))
    return amounts.groupBy(*keys, "target_fy").agg(best.alias("_b")).select(*keys, "target_fy", "_b.kind", "_b.amount")


def raw_submissions(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the amounts as one JSON object of the filled cells."""
    named = [c for c in wide.columns if T.amount_column(c)]
    cells = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*[F.col(c).cast("double") for c in named])), lambda _, v: F.coalesce(v, F.lit(0.0)) != 0)
    return wide.select(*keys, F.to_json(cells).alias("raw_amounts"))


def counts_before_and_after(rows: DataFrame, kept: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Per key how many rows there were, stay and went, and the amount that stays."""
    before = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    after = kept.groupBy(*keys).agg(F.count("*").alias("n_kept"), F.sum(amount).cast("double").alias("kept_amount"))
    both = before.join(after, keys, "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    return both.select(*keys, "n_rows", "n_kept", (F.col("n_rows") - F.col("n_kept")).alias("n_dropped"), "kept_amount")
