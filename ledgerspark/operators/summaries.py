"""Group-wise summaries, rankings and lists that the budget queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerspark.functions.expressions import change_percent, contains_any
from ledgerspark.functions.text import amount_column
from ledgerspark.operators.relations import first_by


def money(c: Column) -> Column:
    return c.cast("double")


def joined_list(c: str, mark: str = ",") -> Column:
    """The distinct values in order as one text."""
    return F.array_join(F.array_sort(F.collect_set(c)), mark)


def of_year(year: str, amount: str = "amount") -> Column:
    return F.sum(F.when(F.col("fiscal_year") == year, F.col(amount)))


def non_negative_columns(df: DataFrame, name: str) -> str:
    """An amount column that the frame has; anything else is an error."""
    if amount_column(name) is None and name not in ("amount", "quantity") or name not in df.columns:
        raise ValueError(f"no amount column {name}")
    return name


def year_column(df: DataFrame, year: int, kinds: list[str]) -> str | None:
    """The first amount column of a year, by kind; None without one."""
    return next((c for k in kinds if (c := f"amount_fy{year}_{k}") in df.columns), None)


def projected(df: DataFrame, wanted: list[str] | None, allowed: list[str]) -> DataFrame:
    """The wanted columns that are allowed; all allowed ones if that leaves none."""
    return df.select(*([c for c in wanted or [] if c in allowed] or allowed))


def ordered(df: DataFrame, by: str, descending: bool, allowed: dict[str, Column], key: list[str]) -> DataFrame:
    """By one of the allowed orders (the first if unknown), then by the key, so that pages are stable."""
    c = allowed.get(by, next(iter(allowed.values())))
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), *key)


def page_of(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page with the number of rows in all, its own number from 0, the number of pages and whether more follow."""
    total = df.agg(F.count("*").alias("total"))
    meta = total.select("total", F.lit(offset // limit).alias("page"), F.greatest(F.ceil(F.col("total") / limit), F.lit(1)).cast("int").alias("page_count"), (F.col("total") > offset + limit).alias("has_next"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(meta))


def with_more(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows and whether there are more: one row more is asked for, nothing is counted."""
    head = df.orderBy(*order).limit(limit + 1)
    more = head.agg((F.count("*") > limit).alias("has_more"))
    return head.orderBy(*order).limit(limit).join(F.broadcast(more))


def active_years(df: DataFrame, key: str, year: str = "fiscal_year", amount: str = "amount") -> DataFrame:
    """(key, year) for the years in which a key has an amount, whatever the years are."""
    return df.where(F.col(amount).isNotNull()).select(key, year).distinct()


def coverage(df: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """The number of keys and, per part, how many of them it has and their percentage: one row."""
    keys = df.select(key).distinct()
    for name, part in parts.items():
        keys = keys.join(part.select(F.col(key).alias(f"_{name}")).distinct(), F.col(key) == F.col(f"_{name}"), "left")
    counts = [F.count(f"_{name}").alias(name) for name in parts]
    one = keys.agg(F.count("*").alias("total"), *counts)
    return one.select("*", *[F.when(F.col("total") > 0, F.round(100 * F.col(n) / F.col("total"), 1)).alias(f"{n}_pct") for n in parts])


def compared(df: DataFrame, programs: list[str], latest: str, previous: str) -> DataFrame:
    """Chosen programs in the order asked for, with both years and the change."""
    asked = df.sparkSession.createDataFrame(list(enumerate(programs)), "position int, pe_number string")
    sums = df.where(F.col("pe_number").isin(programs)).groupBy("pe_number").agg(money(of_year(latest)).alias("latest"), money(of_year(previous)).alias("previous"))
    return F.broadcast(asked).join(sums, "pe_number", "left").withColumn("change_pct", change_percent(F.col("latest"), F.col("previous")))


def related(links: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """Per source and target of links (source, target, year, confidence, snippet): best confidence, years, number and title."""
    grouped = links.where(F.col("confidence") >= least).groupBy("source", "target").agg(F.max("confidence").alias("confidence"), joined_list("year").alias("years"), F.count("*").alias("n"), F.min("snippet").alias("snippet"))
    return grouped.join(titles.select(F.col("pe_number").alias("target"), "title"), "target", "left")


def tag_counts(tags: DataFrame, key: str, least: float, most_share: float) -> DataFrame:
    """Tags of confident rows and how many keys have them; tags of more than a share of all keys say nothing and go."""
    total = tags.agg(F.countDistinct(key).alias("_keys"))
    counts = tags.where(F.col("confidence") >= least).groupBy("tag").agg(F.countDistinct(key).alias("n"))
    return counts.join(F.broadcast(total)).where(F.col("n") <= F.floor(F.col("_keys") * most_share)).drop("_keys")


def shared_tags(tags: DataFrame, key: str, of, limit: int) -> DataFrame:
    """The keys that share most tags with one, with the tags."""
    own = tags.where(F.col(key) == of).select("tag").distinct()
    return tags.where(F.col(key) != of).join(own, "tag").groupBy(key).agg(F.countDistinct("tag").alias("n_shared"), joined_list("tag").alias("shared")).orderBy(F.desc("n_shared"), key).limit(limit)


def best_of_each(df: DataFrame, group: str, order: list[Column], over_fetch: int, limit: int) -> DataFrame:
    """The best rows, of each group its best one."""
    return first_by(df.orderBy(*order).limit(over_fetch), [group], order).orderBy(*order).limit(limit)


def filled_matrix(wide: DataFrame, index: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Long rows of the non-zero cells."""
    return wide.unpivot(index, columns, name, value).where(F.coalesce(F.col(value), F.lit(0)) != 0)


def first_filled(df: DataFrame, keys: list[str], order: str, value: str, source: str) -> DataFrame:
    """Per key the value of the newest row that has one, and that row's source."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(value, source), F.struct(order, source)).alias("_v")).select(*keys, F.col("_v")[value].alias(value), F.col("_v")[source].alias(source))


def top_texts(df: DataFrame, key: str, order: list[Column], text: str, k: int, most: int) -> DataFrame:
    """The first k texts of each key in order, joined and cut with an ellipsis."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= k)
    whole = ranked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(text).alias("_t")))), lambda x: x["_t"]), "\n").alias("text"))
    return whole.withColumn("text", F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("…"))).otherwise(F.col("text")))


def page_runs(df: DataFrame, keys: list[str], page: str, text: str) -> DataFrame:
    """First and last page and the texts in order; gaps are bridged."""
    return df.groupBy(*keys).agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("_p"), F.col(text).alias("_t")))), lambda x: x["_t"]), "\n").alias("text"))


def unaccounted(totals: DataFrame, parts: DataFrame, keys: list[str], more_than: float = 0.5) -> DataFrame:
    """What a total has beyond the sum of its parts, where that is noticeable."""
    sums = parts.groupBy(*keys).agg(F.sum("amount").alias("_s"))
    rest = F.round(money(F.col("amount") - F.coalesce("_s", F.lit(0))), 1)
    return totals.join(sums, keys, "left").withColumn("unaccounted", rest).where(F.col("unaccounted") > more_than).drop("_s")


def contained(long: DataFrame, text: str, parts: DataFrame, part: str, key: str) -> DataFrame:
    """Rows whose text has a part as whole words: tokens are joined by equality, so nothing is compared with everything.

    parts: (key, part) of one or two words.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))
    lead = F.element_at(F.split(F.lower(part), " "), 1)
    each = long.withColumn("_token", F.explode(tokens))
    return each.join(parts.select(key, part, lead.alias("_token")), "_token").where(F.contains(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), F.concat(F.lit(" "), F.lower(part), F.lit(" ")))).drop("_token")


def matching_or_titled(df: DataFrame, key: str, hits: DataFrame, title: str, word: str) -> DataFrame:
    """Rows whose key is among the hits or whose title has the word: an existence join, then OR."""
    there = hits.select(F.col(key).alias("_k")).distinct()
    return df.join(there, F.col(key) == F.col("_k"), "left").where(F.col("_k").isNotNull() | contains_any([title], [word])).drop("_k")
