"""Enrichment: indexes of programs and line items, tags, lineage, narratives and metadata mined from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import fixed_values as V
from ledgerspark.functions import text as T
from ledgerspark.operators.relations import dealt, first_by
from ledgerspark.operators.summaries import joined_list

#: Guards of links by title: least text, most explicit references and links a text, least words of a title.
LEAST_TEXT, MOST_REFERENCES, MOST_LINKS, TITLE_WORDS = 200, 5, 3, 5
#: Characters of a page's head that name what the page is about.
HEAD = 1200


def mode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value of each key that is not null, of equally frequent ones the least."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(column))


def program_index(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a program: of its lines, else of the pages that name it (pe_number, title, source), what it is called,
    whose it is and the years and exhibits it occurs in."""
    known = lines.groupBy("pe_number").agg(F.max("line_item_title").alias("title"), joined_list("fiscal_year").alias("years"), joined_list("exhibit_type").alias("exhibits"))
    known = known.join(mode(lines, ["pe_number"], "organization_name"), "pe_number", "left")
    only = pages.join(known.select("pe_number"), "pe_number", "left_anti").groupBy("pe_number").agg(F.min("title").alias("title"))
    only = only.join(mode(pages, ["pe_number"], "source").withColumnRenamed("source", "organization_name"), "pe_number", "left")
    return known.withColumn("found_in", F.lit("lines")).unionByName(only.withColumn("found_in", F.lit("pages")), allowMissingColumns=True)


def line_item_key(account: Column, line_item: Column) -> Column:
    return F.concat_ws(":", account, F.coalesce(line_item, F.lit("")))


def line_item_index(lines: DataFrame) -> DataFrame:
    """One row per account and line item of procurement exhibits, with its most frequent title and organization."""
    rows = lines.where(F.col("exhibit_type").isin("p1", "p1r") & F.col("account").isNotNull()).withColumn("bli_key", line_item_key(F.col("account"), F.col("line_item")))
    counts = rows.groupBy("bli_key").agg(F.count("*").alias("row_count"), joined_list("fiscal_year").alias("years"))
    return counts.join(mode(rows, ["bli_key"], "line_item_title"), "bli_key", "left").join(mode(rows, ["bli_key"], "organization_name"), "bli_key", "left")


def narratives(pages: DataFrame, keys: list[str], page: str, text: str, headers: list[str], most: int = 4000) -> DataFrame:
    """Per run of pages the sections under known headers; without one the beginning of the text."""
    from ledgerspark.operators.summaries import page_runs

    runs = page_runs(pages.where(F.col(text).isNotNull()), keys, page, text)
    found = T.sections(F.col("text"), headers)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("header"), F.substring("text", 1, most).alias("text")))
    return runs.withColumn("_s", F.explode(F.when(F.size(found) > 0, found).otherwise(whole))).select(*keys, "page_start", "page_end", F.col("_s.header").alias("header"), F.col("_s.text").alias("text"))


def latest_unknown(known: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """The latest line of each program without a narrative. Lines are dealt out by program first, and need no more
    columns than say which is the latest and what describes it later."""
    latest = first_by(dealt(lines, key), [key], [F.desc_nulls_last("fiscal_year"), F.asc_nulls_last("order_key"), F.asc_nulls_last("line_item")])
    return latest.where(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti")


def fallback_text() -> Column:
    """What a line says of its program: title, activity and appropriation, those that it has."""
    return F.concat_ws(" — ", "line_item_title", "budget_activity_title", "appropriation_code")


def with_fallback(known: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """The narratives and, for programs without one, what the latest line says."""
    return known.unionByName(latest_unknown(known, lines, key).select(key, fallback_text().alias("text")))


def keyword_tags(df: DataFrame, key: str, text: Column, taxonomy: list[tuple[str, str, float]], source: str) -> DataFrame:
    """(key, tag, tag_source, confidence): tags of which a pattern is in the text, where case does not count."""
    rules = [F.when(F.rlike(text, F.lit(f"(?i){pattern}")), F.struct(F.lit(tag).alias("tag"), F.lit(source).alias("tag_source"), F.lit(confidence).alias("confidence"))) for tag, pattern, confidence in taxonomy]
    return df.select(key, F.inline(F.array_compact(F.array(*rules))))


def field_tags(df: DataFrame, key: str, column: str, table: list[tuple[str, str]]) -> DataFrame:
    """Tags by the first part that a field has: certain."""
    tag = T.first_hit(F.lower(column), [(part.lower(), name) for part, name in table])
    return df.select(key, tag.alias("tag"), F.lit("structured").alias("tag_source"), F.lit(1.0).alias("confidence")).where("tag IS NOT NULL")


def merged_tags(parts: list[DataFrame], key: str) -> DataFrame:
    """Each tag of a key once a source, the surest first; a missing project is a project like any other."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key, "tag", "tag_source").agg(F.max("confidence").alias("confidence"))


def references(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(source, referenced, snippet, link_type, confidence): other known programs that a text names."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(rf"\b([0-9]{{7}}{V.PE_LETTERS})\b"), 1))
    each = texts.select(F.col(key).alias("source"), F.col(text).alias("_t"), F.explode(found).alias("referenced")).where("source <> referenced")
    each = each.join(known.select(F.col(key).alias("referenced")).distinct(), "referenced", "left_semi")
    at = F.instr("_t", F.col("referenced"))
    start = F.greatest(F.lit(1), at - 100)
    snippet = F.translate(F.substring("_t", start, at + 108 - start), "\n", " ")
    return each.groupBy("source", "referenced").agg(F.min(snippet).alias("snippet")).select("source", "referenced", "snippet", F.lit("explicit_pe_ref").alias("link_type"), F.lit(0.95).alias("confidence"))


def title_links(texts: DataFrame, key: str, text: str, titles: DataFrame, title: str, explicit: DataFrame) -> DataFrame:
    """Programs whose title's first words a text has in a row: only in long texts with few explicit references, not to
    a program named explicitly, the first MOST_LINKS by program."""
    from ledgerspark.operators.relations import with_titles

    n_refs = explicit.groupBy("source").agg(F.countDistinct("referenced").alias("_n"))
    fit = texts.where(F.length(text) >= LEAST_TEXT).join(n_refs, F.col(key) == F.col("source"), "left").where(F.coalesce("_n", F.lit(0)) <= MOST_REFERENCES).select(key, text)
    hits = with_titles(fit.withColumnRenamed(key, "source"), "source", text, titles.withColumnRenamed(key, "referenced"), "referenced", title, TITLE_WORDS).where("source <> referenced")
    fresh = hits.join(explicit.select("source", "referenced"), ["source", "referenced"], "left_anti")
    ranked = first_k(fresh, ["source"], ["referenced"], MOST_LINKS)
    return ranked.select("source", "referenced", F.lit("name_match").alias("link_type"), F.lit(0.6).alias("confidence"))


def first_k(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    from pyspark.sql.window import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


#: Fixed value: how a line names a project; its number may be of any length.
PROJECT_LINE = r"^\s*(?:Project|PROJECT)\s*:?\s*([A-Z0-9]{2,})\s*[:/-]\s*(.+)$"


def projects(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, project_number, title, place): the first boundary of each valid project number of a text, in order."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda line, i: F.struct(F.regexp_extract(line, PROJECT_LINE, 1).alias("number"), F.trim(F.regexp_extract(line, PROJECT_LINE, 2)).alias("title"), i.alias("place"))), lambda x: x["number"] != "")
    each = texts.select(key, F.inline(lines)).where(T.is_project_number(F.col("number")))
    return each.groupBy(key, "number").agg(F.min_by("title", "place").alias("title"), F.min("place").alias("place"))


def with_program_level(found: DataFrame, programs: DataFrame, key: str, title: str) -> DataFrame:
    """The projects and, for programs without one, the program itself as a project without a number."""
    missing = programs.join(found.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.max(title).alias("title"))
    return found.unionByName(missing.select(key, F.lit(None).cast("string").alias("number"), "title", F.lit(None).cast("int").alias("place")))


def line_item_narratives(pages: DataFrame, text: str, header: str, items: DataFrame) -> DataFrame:
    """Pages with bli_key: the account and line item that a header (a pattern with both) in the page's head names, where
    items (bli_key) have it."""
    head = F.substring(text, 1, HEAD)
    account, item = F.regexp_extract(head, header, 1), F.regexp_extract(head, header, 2)
    named = pages.withColumn("bli_key", F.when(account != "", line_item_key(account, item)))
    return named.join(items.select("bli_key").distinct(), "bli_key", "left_semi")


#: Where a page of a project's exhibit begins, and how it names its project.
EXHIBIT_PAGE = "(?i)(?=Exhibit R-2A)"
PROJECT_HEADER = r"(?i)Project\s*(?:\(Number/Name\))?\s*:?\s*([A-Z0-9]{2,})\s*[/:-]\s*([^\n]+)"
#: Pages to a block: what a task orders at once.
BLOCK_PAGES = 1000


def project_texts(pages: DataFrame, keys: list[str], page: str, text: str, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """(keys, number, title, first_page, n_parts, text): the first text of each project of a key.

    Pages of a key, in order, are one text. It is cut where an exhibit page begins; what stands before the
    first cut of a page goes on with the page before, and before the first cut of a key it is left out.
    Parts in a row with the same project number are one project; a part without a number stands alone
    and names none. A project may go over any number of pages, and a key over any number of blocks of
    pages: each block reports its first and last number and how many projects begin in it, reports are
    added up in order, and each block starts from what came before it. `page` is a number, one row each.
    """
    from pyspark.sql.window import Window

    parts = pages.where(F.col(text).isNotNull()).select(*keys, F.col(page).alias("_page"), F.posexplode(F.split(text, EXHIBIT_PAGE)).alias("_nth", "_part")).where("_part <> ''")
    found = F.regexp_extract("_part", PROJECT_HEADER, 1)
    marker = F.rlike("_part", F.lit("(?i)^Exhibit R-2A"))
    parts = parts.withColumn("_block", F.floor(F.col("_page") / block_pages)).withColumn("_m", F.when(marker, F.struct(F.when(found != "", found).alias("number"))))
    within = Window.partitionBy(*keys, "_block").orderBy("_page", "_nth")
    before = F.last("_m", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    same = lambda a, b: F.coalesce(a["number"] == b["number"], F.lit(False))  # noqa: E731  a missing number equals none
    parts = parts.withColumn("_before", before).withColumn("_first", F.col("_m").isNotNull() & F.col("_before").isNull())
    begins = (F.col("_m").isNotNull() & F.col("_before").isNotNull() & ~same(F.col("_m"), F.col("_before"))).cast("long")
    parts = parts.withColumn("_begun", F.sum(begins).over(within)).withColumn("_after", F.max(F.col("_first").cast("int")).over(within))
    reports = parts.groupBy(*keys, "_block").agg(F.max(F.when(F.col("_first"), F.struct("_m"))).alias("_f"), F.max_by("_m", F.when(F.col("_m").isNotNull(), F.struct("_page", "_nth"))).alias("_l"), F.max("_begun").alias("_n"))
    across = Window.partitionBy(*keys).orderBy("_block")  # a row a block
    carried = F.last("_l", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    reports = reports.withColumn("_c", carried).withColumn("_opens", (F.col("_f").isNotNull() & (F.col("_c").isNull() | ~same(F.col("_f")["_m"], F.col("_c")))).cast("long"))
    reports = reports.withColumn("_offset", F.coalesce(F.sum(F.col("_n") + F.col("_opens")).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    offsets = reports.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_opens", "_offset")
    numbered = parts.join(offsets, [*on, F.col("_block") == F.col("_b")]).withColumn("_run", F.col("_offset") + F.col("_begun") + F.col("_after") * F.col("_opens")).where("_run > 0")
    piece = F.struct("_page", "_nth", "_part")
    runs = numbered.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    runs = runs.select(*keys, "_run", F.regexp_extract(F.col("_p")[0]["_part"], PROJECT_HEADER, 1).alias("number"), F.trim(F.regexp_extract(F.col("_p")[0]["_part"], PROJECT_HEADER, 2)).alias("title"), F.col("_p")[0]["_page"].alias("first_page"), F.size("_p").alias("n_parts"), F.array_join(F.transform("_p", lambda x: F.btrim(x["_part"], F.lit(" \n"))), "\n\n").alias("text"))
    firsts = runs.where("number <> ''").groupBy(*keys, "number").agg(F.min("_run").alias("_run"))
    return runs.join(firsts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("number").alias("_num"), F.col("_run").alias("_r")), [*on, F.col("number") == F.col("_num"), F.col("_run") == F.col("_r")], "left_semi").drop("_run")


def page_header(text: Column) -> Column:
    """struct(activity, appropriation) that the head of a page names."""
    head = F.substring(text, 1, 800)
    number = F.lpad(F.regexp_extract(head, r"(?i)(?:BUDGET\s+ACTIVITY|BA)\s*:?\s*([0-9])", 1), 2, "0")
    title = F.trim(F.regexp_extract(head, r"(?i)Appropriation\s*(?:/[^:\n]+)?\s*:\s*[0-9]{4}[A-Z]?\s*[:/]\s*(.+?)(?:\n|$)", 1))
    return F.struct(T.looked_up(number, V.ACTIVITIES).alias("activity"), F.when(title != "", title).alias("appropriation"))


def filled_activity(rows: DataFrame, summary: DataFrame, pages: DataFrame) -> DataFrame:
    """A missing activity from the program's summary row, else from the page the row came from, else from the program's digits."""
    first = summary.groupBy("pe_number").agg(F.max("activity").alias("_a"))
    page = F.regexp_replace("sheet_name", "page_", "").try_cast("long")
    heads = pages.select("source_file", F.col("page_number").alias("_page"), page_header(F.col("page_text"))["activity"].alias("_b"))
    out = rows.withColumn("_page", page).join(first, "pe_number", "left").join(heads, ["source_file", "_page"], "left")
    return out.withColumn("activity", F.coalesce("activity", "_a", "_b", T.activity_of_program(F.col("pe_number"))["title"])).drop("_a", "_b", "_page")


def mined_programs(pages: DataFrame, page_key: str, text: str, items: DataFrame) -> DataFrame:
    """(bli_key, pe_number, confidence): line items (account, line_item) and programs named in the head of a page.

    Of the head's words those that are accounts are kept, then those pairs with another word that are line items: surer
    if the page names one program only. Both are semi-joins, whose only table to broadcast is that of the items: the
    optimizer takes exploded words for far fewer than they are.
    """
    head = F.substring(text, 1, HEAD)
    named = pages.select(F.array_distinct(F.split(head, r"[^A-Za-z0-9#]+")).alias("_a"), F.array_distinct(F.split(head, r"[^A-Za-z0-9]+")).alias("_w"), F.array_distinct(F.regexp_extract_all(head, F.lit(rf"\b([0-9]{{7}}{V.PE_LETTERS})\b"), 1)).alias("_p")).where(F.size("_p") > 0)
    items = items.select("account", "line_item").where("line_item <> ''").distinct()
    of_account = named.select("_w", "_p", F.explode("_a").alias("account")).join(items.select("account").distinct(), "account", "left_semi")
    hits = of_account.select("_p", "account", F.explode("_w").alias("line_item")).join(items, ["account", "line_item"], "left_semi")
    each = hits.select(line_item_key(F.col("account"), F.col("line_item")).alias("bli_key"), F.explode("_p").alias("pe_number"), F.when(F.size("_p") == 1, 0.9).otherwise(0.6).alias("confidence"))
    return each.groupBy("bli_key", "pe_number").agg(F.max("confidence").alias("confidence"))


def filled_programs(lines: DataFrame, mapped: DataFrame, least: float = 0.8) -> DataFrame:
    """Procurement rows without a program get the surest one of their line item, of equal ones the least."""
    best = mapped.where(F.col("confidence") >= least).groupBy("bli_key").agg(F.min_by("pe_number", F.struct(-F.col("confidence"), "pe_number")).alias("_pe"))
    rows = lines.withColumn("bli_key", line_item_key(F.col("account"), F.col("line_item"))).join(best, "bli_key", "left")
    empty = F.col("exhibit_type").isin("p1", "p1r") & (F.coalesce("pe_number", F.lit("")) == "")
    return rows.withColumn("pe_number", F.when(empty, F.coalesce("_pe", "pe_number")).otherwise(F.col("pe_number"))).drop("_pe")


def wide_costs(rows: DataFrame, keys: list[str], years: list[str]) -> DataFrame:
    """Mined rows (year, amount) as one row a key with a column a year."""
    return rows.groupBy(*keys).pivot("year", years).agg(F.max("amount")).withColumnsRenamed({y: f"amount_fy{y}" for y in years})


def ordered_text(pages: DataFrame, keys: list[str], order: str, text: Column) -> DataFrame:
    """The texts of each key in order, put together."""
    rows = pages.select(*keys, F.struct(F.col(order).alias("o"), text.alias("t")).alias("_x")).where("_x.t IS NOT NULL")
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["t"]), "\n").alias("text"))


