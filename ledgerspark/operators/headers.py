"""Headers of staged sheets: what their columns, files and sheets are. A sheet's header is an array of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import text as T
from ledgerspark.functions.expressions import any_of, let

# Header texts and the field they name; of a sheet's columns of one field the first counts.
FIELDS = [
    ("account", "account"), ("account title", "account_title"), ("organization", "organization"), ("budget activity title", "budget_activity_title"),
    ("budget activity", "budget_activity"), ("classification", "classification"), ("bsa", "sub_activity"), ("ag/bsa", "sub_activity"),
    ("ag / bsa", "sub_activity"), ("bsa title", "sub_activity_title"), ("ag title", "sub_activity_title"), ("line item title", "line_item_title"),
    ("budget line item", "line_item"), ("pe/bli", "line_item"), ("pe / bli", "line_item"), ("sag/bli", "line_item"), ("sag / bli", "line_item"),
    ("sag", "line_item"), ("sag title", "line_item_title"), ("program element title", "line_item_title"), ("budget line item (bli) title", "line_item_title"),
    ("construction project title", "line_item_title"), ("construction project", "line_item"), ("location title", "sub_activity_title"),
    ("facility category title", "sub_activity"), ("cost type", "cost_type"), ("cost type title", "cost_type_title"), ("add/ non-add", "add_non_add"),
    ("add/non-add", "add_non_add"), ("add / non-add", "add_non_add"),
]
# Header texts that name a field in some exhibits only.
EXHIBIT_FIELDS = [
    ("r1", "pe", "line_item"), ("r2", "pe", "account"), ("r3", "pe", "account"), ("r4", "pe", "account"), ("r2", "program element", "account"),
    ("r3", "program element", "account"), ("r4", "program element", "account"), ("r2", "program title", "line_item_title"),
    ("r2", "title", "line_item_title"), ("r2", "sub-element", "line_item"), ("r2", "sub element", "line_item"), ("r3", "project number", "line_item"),
    ("r3", "project no", "line_item"), ("r3", "project title", "line_item_title"), ("p1", "line item", "line_item"), ("p1", "item", "line_item"),
    ("p1r", "line item", "line_item"), ("p1r", "item", "line_item"), ("r4", "line item", "line_item"), ("r4", "item", "line_item"),
    ("r4", "narrative", "line_item_title"), ("r4", "justification", "line_item_title"),
]
# Words in a year's header and the kind of amount they name, the first one counting; the same for quantities.
AMOUNT_WORDS = [("actual", "actual"), ("enacted", "enacted"), ("approp", "enacted"), ("supplemental", "supplemental"), ("reconcil", "reconciliation"),
                ("authoriz", "request"), ("total", "total"), ("obligation", "total"), ("request", "request"), ("disc", "request")]
QUANTITY_WORDS = [("actual", ""), ("request", "_request"), ("disc", "_request"), ("total", "_total")]
# Headers without a year that name an amount of the sheet's own year.
YEARLESS = [("authorization amount", "request"), ("appropriation amount", "enacted"), ("total obligation authority", "total")]
# Exhibit codes.
EXHIBITS = ["p1r", "rf1", "p1", "r1", "o1", "m1", "c1", "p5", "r2", "r3", "r4"]


def merged_header(header: Column, below: Column) -> Column:
    """Two header rows as one, cell by cell; only the first if the second is blank, has a number or a long text."""
    cells = F.filter(F.transform(below, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    data = (F.size(cells) == 0) | F.exists(cells, lambda x: F.regexp_replace(x, ",", "").try_cast("double").isNotNull() | (F.length(x) > 50))
    joined = F.zip_with(header, below, lambda a, b: F.nullif(F.trim(F.concat_ws(" ", F.trim(a), F.trim(b))), F.lit("")))
    return F.when(data, header).otherwise(joined)


def field_of(header: Column, exhibit: Column, year: Column) -> Column:
    """The field that a header names, null for none: a year's amount or quantity, else by the exhibit, else by the text."""
    text = F.lower(F.trim(F.regexp_replace(header, r"\s+", " ")))
    return let(text, lambda h: let(F.regexp_extract(h, r"fy\s*([0-9]{4})", 1), lambda fy: _field(h, fy, exhibit, year)))


def _field(h: Column, fy: Column, exhibit: Column, year: Column) -> Column:
    quantity = F.concat(F.lit("quantity_fy"), fy, F.coalesce(T.first_hit(h, QUANTITY_WORDS), F.lit("")))
    amount = F.concat(F.lit("amount_fy"), fy, F.lit("_"), T.first_hit(h, AMOUNT_WORDS))
    dated = F.when(F.contains(h, F.lit("quantity")), quantity).otherwise(amount)
    own = T.looked_up(F.concat_ws("|", exhibit, h), {f"{e}|{text}": field for e, text, field in EXHIBIT_FIELDS})
    yearless = F.concat(F.lit("amount_fy"), year, F.lit("_"), T.first_hit(h, YEARLESS))
    return F.when(fy != "", dated).otherwise(F.coalesce(own, T.looked_up(h, dict(FIELDS)), yearless))


def mapped_columns(sheets: DataFrame, keys: list[str], header: str, exhibit: str, year: str) -> DataFrame:
    """(keys, field, place): the first column of each field of each sheet, places from 0."""
    fields = F.transform(header, lambda h, i: F.struct(field_of(h, F.col(exhibit), F.col(year)).alias("field"), i.alias("place")))
    each = sheets.select(*keys, F.inline(fields)).where("field IS NOT NULL")
    return each.groupBy(*keys, "field").agg(F.min("place").alias("place"))


def catalog_columns(sheets: DataFrame, keys: list[str], header: str, catalog: list[tuple[str, str]]) -> DataFrame:
    """(keys, place, field): by the longest of the catalog's parts that a header has."""
    parts = sorted(catalog, key=lambda x: -len(x[0]))
    each = sheets.select(*keys, F.posexplode(header).alias("place", "_h"))
    return each.select(*keys, "place", T.first_hit(F.lower("_h"), parts).alias("field")).where("field IS NOT NULL")


def exhibit_of(name: Column, books: list[tuple[str, str]] = (), words: list[tuple[str, str]] = ()) -> Column:
    """The exhibit of a file name: a code, the longest first; a book's abbreviation; `proc_`; a word; unknown."""
    n = F.regexp_replace(F.lower(name), r"_display|\.xlsx|\.pdf", "")
    by_length = lambda table: sorted(table, key=lambda x: -len(x[0]))
    tiers = [by_length([(e, e) for e in EXHIBITS]), by_length(list(books))]
    found = [T.first_hit(n, t) for t in tiers if t] + [F.when(F.startswith(n, F.lit("proc_")), "p5")] + ([T.first_hit(n, list(words))] if words else [])
    return F.coalesce(*found, F.lit("unknown"))


def category_of(name: Column, detail: list[str] = ("r2", "r3", "r4", "p5"), summary: list[str] = ("p1r", "rf1", "p1", "r1", "o1", "m1", "c1"), families: list[tuple[str, str]] = ()) -> Column:
    """`detail`, `summary` or `other`: by a code, then by (pattern, category) families in their order."""
    n = F.lower(name)
    out = F.when(any_of(F.contains(n, F.lit(x)) for x in detail), "detail").when(any_of(F.contains(n, F.lit(x)) for x in summary), "summary")
    for pattern, category in families:
        out = out.when(F.rlike(n, F.lit(pattern)), category)
    return out.otherwise("other")


def unit_of(title_rows: Column) -> Column:
    """1000 where the rows above the header say millions, else 1: what makes an amount thousands."""
    text = F.lower(F.array_join(title_rows, " "))
    return F.when(F.rlike(text, F.lit(r"in\s+millions|\$\s*millions|\(millions\)")), 1000.0).otherwise(1.0)


def currency_of(sheet: Column, file: Column) -> Column:
    return F.when(F.contains(F.lower(F.concat_ws(" ", sheet, file)), F.lit("constant")), "constant").otherwise("then-year")


def place_of_path(path: Column) -> Column:
    """struct(year, cycle, category) by the folders of a path."""
    parts = F.split(F.lower(path), "/")
    year = F.regexp_extract(path, r"(?:^|/)FY_?([0-9]{4})(?:/|$)", 1)
    cycle = F.coalesce(T.first_hit(F.lower(path), [("enacted", "enacted"), ("supplemental", "supplemental"), ("amend", "amendment")]), F.lit("pb"))
    category = F.when(F.array_contains(parts, "comptroller"), "Comptroller").when(F.array_contains(parts, "us_army"), "Army").when(F.array_contains(parts, "us_navy"), "Navy").otherwise("Other")
    return F.struct(F.when(year != "", year).alias("year"), cycle.alias("cycle"), category.alias("category"))
