"""Keyword Explorer: programs that keywords find, their amounts by year, and what each year's match is."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import fixed_values as V
from ledgerspark.functions import text as T
from ledgerspark.functions.expressions import any_of, contains_any, let


def validated(words: list[str], most: int = 50, size: tuple[int, int] = (2, 100)) -> list[str]:
    """The words, trimmed and each once; an error if there are none, too many, or one of a wrong length or sign."""
    out = list({w.strip().lower(): w.strip() for w in reversed(words) if w.strip()}.values())[::-1]
    if not 1 <= len(out) <= most:
        raise ValueError(f"1 to {most} keywords are needed")
    for w in out:
        if not size[0] <= len(w) <= size[1] or not re.fullmatch(r"[\w\s.,&/()'-]+", w):
            raise ValueError(f"no keyword: {w!r}")
    return out


def checked_keywords(typed: Column, most: int = 50, size: tuple[int, int] = (2, 100)) -> Column:
    """struct(words, problem) of array<string>: the words as `validated` has them, and what is wrong: count, length, sign or null."""

    def once(words: Column) -> Column:
        return let(F.transform(words, F.lower), lambda lower: F.filter(words, lambda w, i: F.array_position(lower, lower[i]) == i + 1))

    def checked(first: Column) -> Column:
        problem = F.when(~F.size(first).between(1, most), "count").when(F.exists(first, lambda w: ~F.length(w).between(*size)), "length")
        problem = problem.when(F.exists(first, lambda w: ~F.rlike(w, F.lit(r"^[\p{L}\p{N}_\s.,&/()'-]+$"))), "sign")
        return F.struct(first.alias("words"), problem.alias("problem"))

    words = F.filter(F.transform(typed, lambda w: F.btrim(w, F.lit(" \t\r\n"))), lambda w: w != "")
    return let(let(words, once), checked)


def discovered(lines: DataFrame, narratives: DataFrame, words: list[str], columns: list[str], within_narratives: list[str]) -> DataFrame:
    """(pe_number, found_in): programs by number or by a keyword in a line, and others by a narrative only."""
    numbers = [w.upper() for w in words if re.fullmatch(rf"[0-9]{{7}}{V.PE_LETTERS}", w.upper())]
    by_line = lines.where(F.col("pe_number").isin(numbers) | contains_any(columns, words)).select("pe_number").distinct()
    by_text = narratives.where(contains_any(["text"], within_narratives)).select("pe_number").distinct().join(by_line, "pe_number", "left_anti")
    return by_line.withColumn("found_in", F.lit("line")).unionByName(by_text.withColumn("found_in", F.lit("narrative")))


def forced(lines: DataFrame, programs: list[str]) -> DataFrame:
    """Those of the programs that exist."""
    return lines.where(F.col("pe_number").isin(programs)).select("pe_number").distinct()


def by_year(lines: DataFrame, keys: list[str], years: list[str], kinds: list[str], kind: str = "exhibit_type") -> DataFrame:
    """Per key and year the largest positive amount of the best kind there is, with its file; 0 without one."""
    columns = []
    for y in years:
        hit = lambda k, c, y=y: F.max(F.when((F.col("fiscal_year") == y) & (F.col(kind) == k) & (F.col("amount") > 0), F.col(c)))
        columns.append(F.coalesce(*[hit(k, "amount") for k in kinds], F.lit(0)).cast("double").alias(f"fy{y}"))
        columns.append(F.coalesce(*[hit(k, "source_file") for k in kinds]).alias(f"fy{y}_ref"))
    return lines.where(F.col("fiscal_year").try_cast("int") >= int(min(years))).groupBy(*keys).agg(*columns)


#: Fixed value: how the line of a cost table's header reads.
COST_HEADER = r"(?i)COST \(\$ in (?:Millions|Thousands)\)"


def cost_table(text: Column, rows: int = 20) -> Column:
    """array<struct(label, amounts)> of a page's cost table: amounts are array<struct(year, amount)>, in thousands.

    The table begins behind the line with `COST ($ in ...)`. The years of this line and of its neighbours name
    the columns: of four digits, else of two, else bare ones. It ends at a section letter, or after `rows`
    lines. A row is a label and behind it, as far as they go from the right, amounts or words for none.
    """
    words = "|".join(T.literal_pattern(w) for w in sorted(V.NO_AMOUNT, key=len, reverse=True))
    cell = rf"(?:\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?[*#]*|(?:{words})[*#]*)"
    row = rf"^(.*?)((?:\s+{cell})+)$"
    more_head = lambda x: F.rlike(x, F.lit(r"(?i)^(?:Complete(?: Cost)?|Years .*|(?:FY\s*[0-9]{2,4}\s*)+|(?:(?:19|20)[0-9]{2}\s*)+)?$"))
    junk = lambda s: s.isin(V.JUNK_TITLES) | any_of(F.startswith(s, F.lit(b)) for b in V.JUNK_BEGINNINGS)

    def years_of(area: Column) -> Column:
        four = F.regexp_extract_all(area, F.lit(r"(?i)FY\s*([0-9]{4})"), 1)
        two = F.transform(F.regexp_extract_all(area, F.lit(r"(?i)FY\s*([0-9]{2})(?![0-9])"), 1), lambda y: T.full_year(y).cast("string"))
        bare = F.filter(F.regexp_extract_all(area, F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), 1), lambda y: y.between("1990", "2035"))
        return let(four, lambda f: F.when(F.size(f) > 0, f).otherwise(let(two, lambda t: F.when(F.size(t) > 0, t).otherwise(bare))))

    def lines_below(below: Column) -> Column:
        start = F.array_position(F.transform(below, lambda x: ~more_head(x)), F.lit(True)).cast("int")
        return let(start, lambda n: F.when(n > 0, F.slice(below, F.greatest(n, F.lit(1)), rows)).otherwise(F.slice(below, 1, 0)))

    def body_of(lines: Column) -> Column:
        last = F.array_position(F.transform(lines, lambda x: x.rlike(r"^(?:[A-E]\.|Note|R-1 Line)")), F.lit(True)).cast("int")
        return let(last, lambda n: F.when(n > 0, F.slice(lines, 1, F.greatest(n - 1, F.lit(0)))).otherwise(lines))

    def parsed(body: Column, years: Column, unit: Column) -> Column:
        number = lambda c: F.regexp_replace(c, "[,*#]", "").try_cast("double") * unit
        amounts = lambda x: F.transform(F.split(F.trim(F.regexp_extract(x, row, 2)), r"\s+"), number)
        pairs = lambda x: F.transform(let(amounts(x), lambda a: T.paired(years, a)), lambda p: F.struct(p["label"].alias("year"), p["amount"].alias("amount")))
        labelled = F.filter(F.transform(body, lambda x: F.struct(F.trim(F.regexp_extract(x, row, 1)).alias("label"), x.alias("x"))), lambda r: (r["label"] != "") & ~junk(r["label"]))
        return F.filter(F.transform(labelled, lambda r: F.struct(r["label"].alias("label"), pairs(r["x"]).alias("amounts"))), lambda r: F.exists(r["amounts"], lambda p: p["amount"].isNotNull()))

    def table(every: Column, at: Column) -> Column:
        unit = F.when(F.contains(F.lower(F.try_element_at(every, at)), F.lit("million")), 1000.0).otherwise(1.0)
        area = F.array_join(F.slice(every, F.greatest(at - 1, F.lit(1)), F.when(at > 1, 3).otherwise(2)), " ")
        below = F.transform(F.slice(every, at + 1, 1 << 30), lambda x: F.trim(x))
        body = lambda b: let(lines_below(b), body_of)
        return let(let(area, years_of), lambda y: F.when(F.size(y) > 0, let(let(below, body), lambda b: let(unit, lambda u: parsed(b, y, u)))).otherwise(none))

    none = F.array().cast("array<struct<label:string,amounts:array<struct<year:string,amount:double>>>>")
    header_at = lambda every: F.array_position(F.transform(every, lambda x: F.rlike(x, F.lit(COST_HEADER))), F.lit(True)).cast("int")
    return let(F.split(text, "\n"), lambda every: let(header_at(every), lambda at: F.when(at > 0, table(every, at)).otherwise(none)))


def mined(pages: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Rows of pages' cost tables: code, title, year, amount and whether a keyword is in the title; of equal rows of a
    page's program, code and document year the first."""
    titled = F.transform(cost_table(F.col(text)), lambda r: F.struct(T.project_title(r["label"]).alias("t"), r["amounts"].alias("amounts")))
    others = [c for c in pages.columns if c != text]
    rows = pages.select(*others, F.explode(titled).alias("_row")).where("_row.t IS NOT NULL")
    matched = F.size(T.keywords_in([F.col("_row.t.title")], words)) > 0
    return rows.select(*others, F.col("_row.t.code").alias("code"), F.col("_row.t.title").alias("title"), matched.alias("matched"), F.inline("_row.amounts"))


def inherited(rows: DataFrame, summary: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Missing or Unknown values taken from the summary row of the same key."""
    parent = summary.groupBy(key).agg(*[F.max(F.when(F.col(c) != "Unknown", F.col(c))).alias(f"_{c}") for c in columns])
    own = {c: F.coalesce(F.when(F.col(c) != "Unknown", F.col(c)), F.col(f"_{c}"), F.lit("Unknown")) for c in columns}
    return rows.join(parent, key, "left").withColumns(own).drop(*[f"_{c}" for c in columns])


def narrative_keywords(narratives: DataFrame, key: str, text: str, order: str, words: list[str]) -> DataFrame:
    """Per key the keywords of the first narrative that has any."""
    hits = narratives.select(key, order, T.keywords_in([F.col(text)], words).alias("words")).where(F.size("words") > 0)
    return hits.groupBy(key).agg(F.min_by("words", order).alias("words"))


def longest_title(rows: DataFrame, key: str, title: str, amounts: list[str]) -> DataFrame:
    """One row a key: its longest title (of equal ones the least) and of every amount the first there is, by title."""
    best = F.min_by(title, F.struct(-F.length(title), F.col(title)))
    return rows.groupBy(key).agg(best.alias(title), *[F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(title))).alias(c) for c in amounts])


def with_stubs(rows: DataFrame, wanted: DataFrame, key: str, titles: DataFrame) -> DataFrame:
    """The rows and, for wanted keys without one, a row with only a title (the key if there is none)."""
    missing = wanted.join(rows.select(key).distinct(), key, "left_anti").join(titles, key, "left")
    return rows.unionByName(missing.select(key, F.coalesce("title", key).alias("title")), allowMissingColumns=True)


def lineage_notes(rows: DataFrame, key: str, title: str) -> DataFrame:
    """`Also in PE ...` for programs whose name other programs bear too."""
    named = rows.select(key, T.program_name(F.col(title)).alias("_n")).where("_n <> ''").distinct()
    groups = named.groupBy("_n").agg(F.array_sort(F.collect_set(key)).alias("_all")).where(F.size("_all") >= 2)
    others = named.join(groups, "_n").groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("_all"))).alias("_all"))
    return others.select(key, F.concat(F.lit("Also in PE "), F.array_join(F.array_sort(F.array_except("_all", F.array(key))), ", ")).alias("note"))


def match_codes(amounts: Column, sources: Column, row_match: Column, year_match: Column, is_summary: Column, has_detail: Column) -> Column:
    """array<string> of Y, N, P or blank a year: blank without an amount; N without a match; P for a summary row whose
    details match; else Y. One Y turns every N into P."""
    one = lambda i: F.when(amounts[i].isNull() | ((amounts[i] == 0) & sources[i].isNull()), "").when(~(row_match | F.coalesce(year_match[i], F.lit(False))), "N").when(is_summary & has_detail, "P").otherwise("Y")
    codes = F.transform(F.sequence(F.lit(0), F.size(amounts) - 1), one)
    return F.when(F.array_contains(codes, "Y"), F.transform(codes, lambda c: F.when(c == "N", "P").otherwise(c))).otherwise(codes)


def included(rows: DataFrame, key: str, row_match: Column, hits: DataFrame, programs: list[str]) -> DataFrame:
    """Rows with a match of their own, of a key with a matching narrative, or of a chosen program."""
    there = hits.select(F.col(key).alias("_k")).distinct()
    return rows.join(there, F.col(key) == F.col("_k"), "left").where(row_match | F.col("_k").isNotNull() | F.col(key).isin(programs)).drop("_k")


def described(narratives: DataFrame, key: str, value, preferred: list[str], kind: str, text: str) -> DataFrame:
    """The one description of a key: by the preferred kinds, then the longest."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, preferred)), F.col(kind)), F.lit(0))
    return narratives.where((F.col(key) == value) & ~T.is_garbage_description(F.col(text))).orderBy(F.when(rank == 0, 99).otherwise(rank), F.desc(F.length(text)), text).limit(1)


#: A preset is a named list of keywords and programs.
PRESETS = {"rings": (["ring", "small"], ["0000007A"])}
