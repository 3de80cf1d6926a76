"""Data-quality checks, repair and consolidation of fact rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerspark.functions.expressions import all_of, fiscal_year_of_path
from ledgerspark.operators.relations import anti, first_by

#: What makes two fact rows the same line.
LINE_KEY = ["fiscal_year", "pe_number", "line_item_title", "organization_name", "exhibit_type", "amount_type", "appropriation_code"]


def missing_years(df: DataFrame, group: str, year: str = "fiscal_year") -> DataFrame:
    """(group, year) pairs without rows: of every group's set of years against the set of all, a few values."""
    there = df.groupBy(group).agg(F.collect_set(year).alias("_has"))
    every = df.agg(F.collect_set(year).alias("_every"))  # one row
    return there.join(F.broadcast(every)).select(group, F.explode(F.array_except("_every", "_has")).alias(year))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def several_values(df: DataFrame, key: str, column: str, more_than: int = 1) -> DataFrame:
    return df.groupBy(key).agg(F.countDistinct(column).alias("n_values")).where(F.col("n_values") > more_than)


def jumps(yearly: DataFrame, keys: list[str], amount: str, factor: float) -> DataFrame:
    """Years whose amount is over `factor` times that of the year before, or less than its inverse."""
    before = F.lag(amount).over(Window.partitionBy(*keys).orderBy("fiscal_year"))
    return yearly.withColumn("before", before).where((F.col("before") > 0) & ((F.col(amount) > factor * F.col("before")) | (F.col(amount) * factor < F.col("before"))))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass over the table, then one row a column."""
    one = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("double")), 4).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "null_rate")


def one_row_a_line(df: DataFrame) -> DataFrame:
    """Of rows of the same line the one whose file is of its own year, then the last file, then the least key.

    One sort: Spark keeps the first row of each line in every task before the shuffle, so a line with very
    many rows does not meet in one task.
    """
    own = F.when(fiscal_year_of_path(F.col("source_file")) == F.col("fiscal_year"), 0).otherwise(1)
    best = first_by(df, LINE_KEY, [own.asc(), F.desc("source_file"), F.asc("order_key"), F.asc("line_item"), F.asc("amount")])
    return best.select(*LINE_KEY, "source_file", "order_key", "line_item", "amount")


def canonical_titles(df: DataFrame, key: str, title: str) -> DataFrame:
    """(key, canonical): the most frequent title of each key and spelling, of equal ones the least."""
    counts = df.groupBy(key, title).agg(F.count("*").alias("n")).withColumn("plain", F.regexp_replace(F.lower(title), r"[^a-z0-9]+", ""))
    return first_by(counts, [key, "plain"], [F.desc("n"), F.asc(title)]).select(key, "plain", F.col(title).alias("canonical"), "n")


def reconcile(left: DataFrame, right: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Sums of both sides by key; a missing side counts as a mismatch."""
    both = left.groupBy(key).agg(F.sum("amount").alias("x")).join(right.groupBy(key).agg(F.sum("amount").alias("y")), key, "full_outer")
    apart = F.abs(F.col("x") - F.col("y")) > tolerance * F.abs(F.col("y"))
    state = F.when(F.col("x").isNull(), "left missing").when(F.col("y").isNull(), "right missing").when(apart, "mismatch").otherwise("match")
    return both.select(key, F.col("x").cast("double").alias("left_total"), F.col("y").cast("double").alias("right_total"), state.alias("state"))


def line_items(df: DataFrame) -> DataFrame:
    """One row per (exhibit, account, program) with its span of years and the latest title."""
    return df.groupBy("exhibit_type", "account", "pe_number").agg(F.min("fiscal_year").alias("first_fy"), F.max("fiscal_year").alias("last_fy"), F.count("*").alias("n"), F.max(F.struct("fiscal_year", "line_item_title")).getField("line_item_title").alias("latest_title"))


def text_audit(docs: DataFrame) -> DataFrame:
    """Per source: texts that are short, mostly blank lines, or rich in signs outside ASCII."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    blank = F.size(F.filter(lines, lambda x: F.trim(x) == ""))
    foreign = F.length(text) - F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim(text)) < 20).alias("short"), F.count_if(blank * 2 > F.size(lines)).alias("blank"), F.count_if(foreign * 100 > F.length(text) * 15).alias("foreign"))


def all_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of which every amount is missing or zero."""
    return df.where(all_of(F.coalesce(c, F.lit(0)) == 0 for c in columns))


def cells(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column_name, value) of every cell."""
    return df.unpivot(keys, columns, "column_name", "value")


def rollup_mismatches(df: DataFrame, keys: list[str], is_total, more_than: float) -> DataFrame:
    """Keys whose total rows and detail rows differ by more than an amount; both in one pass."""
    sums = df.groupBy(*keys).agg(F.sum(F.when(is_total, F.col("amount"))).alias("x"), F.sum(F.when(~is_total, F.col("amount"))).alias("y"))
    return sums.where(F.abs(F.col("x") - F.col("y")) > more_than).select(*keys, F.col("x").cast("double").alias("total"), F.col("y").cast("double").alias("detail"))


def unknown_values(df: DataFrame, column: str, known: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): values that no column of the known table has; every known name is one key of one equi join."""
    names = known.select(F.explode(F.array(*columns)).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).join(names, column, "left_anti")


def null_rate(df: DataFrame, column: str, limit: float) -> DataFrame:
    """The share of rows without a value and whether it is over the limit: one row."""
    rate = F.avg(F.col(column).isNull().cast("double"))
    return df.agg(F.round(rate, 4).alias("rate"), (rate > limit).alias("too_high"))


def orphans(edges: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(edge, n) of (name, table, its key, parent, its key): keys that the parent lacks."""
    parts = [anti(child.select(key).distinct(), parent, key, other).agg(F.count("*").alias("n")).select(F.lit(name).alias("edge"), "n") for name, child, key, parent, other in edges]
    return reduce(DataFrame.unionByName, parts)


class Checks:
    """Named checks with a severity; a check is the frame of the rows it objects to."""

    def __init__(self):
        self.checks: dict[str, tuple[str, DataFrame]] = {}

    def add(self, name: str, severity: str, rows: DataFrame) -> Checks:
        if severity not in ("info", "warning", "error"):
            raise ValueError(f"no severity: {severity}")
        self.checks[name] = (severity, rows)
        return self

    def report(self, skip: tuple[str, ...] = ()) -> DataFrame:
        """(name, severity, n, failed), a row a check."""
        one = lambda name, severity, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(severity).alias("severity"), "n", (F.col("n") > 0).alias("failed"))
        return reduce(DataFrame.unionByName, [one(n, s, r) for n, (s, r) in self.checks.items() if n not in skip])


def validations(lines: DataFrame, expected: DataFrame, known: list[str], key: list[str], numeric: list[str], most: float = 1e9, null_share: float = 0.5, org_share: float = 0.25) -> DataFrame:
    """(check, subject, value, failed): the eight checks of a fact table, each a row a subject.

    rows of each exhibit; keys with several rows; shares of nulls; exhibits that are not known; amounts
    beyond a range; files whose rows are not as many as expected (source_file, n_rows) says, missing ones
    and unexpected ones too; years with few of all organizations; text columns that should be numbers.
    """
    row = lambda check, subject, value, failed: [F.lit(check).alias("check"), subject.cast("string").alias("subject"), value.cast("double").alias("value"), failed.alias("failed")]
    n = F.col("n")
    counted = lambda c: lines.groupBy(c).agg(F.count("*").alias("n"))
    exhibits = counted("exhibit_type")
    out = [exhibits.select(*row("rows", F.col("exhibit_type"), n, n == 0))]
    out.append(exhibits.where(~F.coalesce(F.col("exhibit_type").isin(known), F.lit(False))).select(*row("unknown_exhibit", F.col("exhibit_type"), n, F.lit(True))))
    repeated = lines.groupBy(*key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    out.append(repeated.select(*row("duplicate_keys", F.lit(",".join(key)), n, n > 0)))
    nulls = lines.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in lines.columns]).unpivot([], lines.columns, "column_name", "n")
    out.append(nulls.select(*row("null_share", F.col("column_name"), F.round("n", 4), n > null_share)))
    out.append(lines.agg(F.count_if(F.abs("amount") > most).alias("n")).select(*row("out_of_range", F.lit("amount"), n, n > 0)))
    files = counted("source_file").withColumnRenamed("source_file", "_file")
    both = files.join(expected, files["_file"].eqNullSafe(expected["source_file"]), "full")
    off = F.coalesce(n, F.lit(0)) - F.coalesce("n_rows", F.lit(0))
    out.append(both.where(off != 0).select(*row("row_count", F.coalesce("_file", "source_file"), off, F.lit(True))))
    orgs = lines.agg(F.countDistinct("organization_name").alias("_all"))
    years = lines.groupBy("fiscal_year").agg(F.countDistinct("organization_name").alias("n")).join(orgs)  # one row
    out.append(years.select(*row("organizations", F.col("fiscal_year"), n, n < org_share * F.col("_all"))))
    bad = lines.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in numeric]).unpivot([], numeric, "column_name", "n")
    out.append(bad.select(*row("not_a_number", F.col("column_name"), n, n > 0)))
    return reduce(DataFrame.unionByName, out)
