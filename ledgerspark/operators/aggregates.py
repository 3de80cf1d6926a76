"""Aggregations over fact rows. Sums are decimal, so no order of addition shows; all combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.expressions import change_percent


def year_sum(year: str, value: str = "amount") -> Column:
    return F.sum(F.when(F.col("fiscal_year") == year, F.col(value)))


def money(c: Column) -> Column:
    return c.cast("double")


def totals_by(df: DataFrame, column: str, latest: str, previous: str) -> DataFrame:
    """Rows, the two years' sums, each group's share of the latest year and its change."""
    g = df.groupBy(F.col(column).alias("group_value")).agg(F.count("*").alias("row_count"), money(year_sum(latest)).alias("latest"), money(year_sum(previous)).alias("previous"))
    total = g.agg(F.sum("latest").alias("_all"))  # one row, of the groups
    share = F.round(F.col("latest") / F.col("_all") * 100, 2)
    change = change_percent(F.col("latest"), F.col("previous"))
    return g.join(F.broadcast(total)).select("group_value", "row_count", "latest", "previous", share.alias("pct_of_total"), change.alias("yoy_change_pct"))


def hierarchy(df: DataFrame, latest: str, previous: str) -> DataFrame:
    """Organization, appropriation, program: both years' sums of programs with money in the latest."""
    keys = ["organization_name", "appropriation_code", "line_item_title"]
    g = df.groupBy(*keys).agg(F.min("pe_number").alias("pe_number"), year_sum(latest).alias("l"), year_sum(previous).alias("p")).where("l > 0")
    total = g.agg(F.sum("l").alias("_all"))  # one row, of the groups
    share = F.round(money(F.col("l")) / money(F.col("_all")) * 100, 4)
    return g.join(F.broadcast(total)).select(*keys, "pe_number", money(F.col("l")).alias("latest"), money(F.coalesce("p", F.lit(0))).alias("previous"), share.alias("pct_of_total"))


def facets(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Counts per value of each dimension under the filters of all the others, in one pass over df."""
    passes = {c: F.col(c).isin(v) for c, v in chosen.items()}
    missed = sum(((~p).cast("int") for p in passes.values()), F.lit(0))
    rows = df.select(*chosen, missed.alias("_missed"), *[(~p).alias(f"_not_{c}") for c, p in passes.items()]).where("_missed <= 1")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value"), ((F.col("_missed") == 0) | F.col(f"_not_{c}")).alias("counts")) for c in chosen]))
    return rows.select(each.alias("f")).where("f.counts").groupBy(F.col("f.dimension").alias("dimension"), F.col("f.value").alias("value")).agg(F.count("*").alias("n"))


def dashboard(df: DataFrame, latest: str, previous: str) -> DataFrame:
    return df.agg(F.count("*").alias("total_lines"), money(year_sum(latest)).alias("latest"), money(year_sum(previous)).alias("previous"), F.countDistinct("pe_number").alias("n_pe"), F.countDistinct("organization_name").alias("n_org"), F.countDistinct("source_file").alias("n_files"))


def top(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.sum("amount").alias("s")).orderBy(F.desc("s"), column).limit(n).select(column, money(F.col("s")).alias("total"))


def changes(df: DataFrame, keys: list[str], latest: str, previous: str) -> DataFrame:
    """Difference between two years and its kind; groups with neither amount are left out."""
    g = df.groupBy(*keys).agg(F.coalesce(year_sum(latest), F.lit(0)).alias("l"), F.coalesce(year_sum(previous), F.lit(0)).alias("p")).where("l <> 0 OR p <> 0")
    kind = F.when(F.col("p") == 0, "new").when(F.col("l") == 0, "terminated").when(F.col("l") > F.col("p"), "increase").when(F.col("l") < F.col("p"), "decrease").otherwise("flat")
    return g.select(*keys, money(F.col("l")).alias("latest"), money(F.col("p")).alias("previous"), money(F.col("l") - F.col("p")).alias("delta"), kind.alias("change_type"))


def with_subtotals(df: DataFrame) -> DataFrame:
    """Totals per program element beside those per title and exhibit."""
    sets = [[F.col("pe_number")], [F.col("pe_number"), F.col("line_item_title"), F.col("exhibit_type")]]
    g = df.groupingSets(sets, "pe_number", "line_item_title", "exhibit_type").agg(F.sum("amount").alias("s"), F.count("*").alias("n"), F.grouping("exhibit_type").cast("int").alias("is_subtotal"))
    return g.select("pe_number", "line_item_title", "exhibit_type", money(F.col("s")).alias("total"), "n", "is_subtotal")


def pivot_years(df: DataFrame, keys: list[str], years: list[str]) -> DataFrame:
    """One column a year; the list is explicit, so there is no extra job to find it."""
    g = df.groupBy(*keys).agg(*[money(year_sum(y)).alias(f"fy{y}") for y in years])
    return g


def best_by_year(df: DataFrame, key: str, years: list[str], ranks: list[str]) -> DataFrame:
    """Per year the largest positive amount of the first kind that has one, else 0."""
    best = lambda y: F.coalesce(*[F.max(F.when((F.col("fiscal_year") == y) & (F.col("exhibit_type") == k) & (F.col("amount") > 0), F.col("amount"))) for k in ranks], F.lit(0))
    return df.groupBy(key).agg(*[money(best(y)).alias(f"fy{y}") for y in years])


def most_frequent(df: DataFrame, key: str, column: str) -> DataFrame:
    """The mode of a column, of equally frequent values the least: counts are made by hashing, and only they are sorted for the best."""
    counts = df.groupBy(key, column).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), column))
    return counts.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b")[column].alias(column), (-F.col("_b.m")).alias("n"))


def distinct_lists(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sorted distinct values, joined by commas; nulls are left out. Values repeat little per key."""
    return df.groupBy(key).agg(*[F.array_join(F.sort_array(F.collect_set(c)), ",").alias(f"{c}_list") for c in columns])


def co_occurrence(rows: DataFrame, row_id: str, words: str) -> DataFrame:
    """How many rows hold both of two values; the diagonal has the totals. Arrays are short keyword lists."""
    a = rows.select(row_id, F.explode(F.array_distinct(words)).alias("a"), words)
    return a.select("a", F.explode(F.array_distinct(words)).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
