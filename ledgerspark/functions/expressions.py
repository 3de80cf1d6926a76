"""Scalar building blocks as Column functions; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions.fixed_values import PE_LETTERS

PE_NUMBER = rf"\b([0-9]{{7}}{PE_LETTERS})\b"


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def normalized_space(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def contains_any(columns: Iterable[str], words: Iterable[str]) -> Column:
    """Some word occurs in some column, whatever the case; % and _ mean themselves."""
    words = list(words)
    return any_of(F.contains(F.lower(c), F.lit(w.lower())) for c in columns for w in words)


def fiscal_year(c: Column) -> Column:
    """`FY 2026`, `FY2026`, `2026` and `FY26` -> `2026`; anything else, or outside 1900-2100, is null."""
    full = F.regexp_extract(c, r"^\s*(?:FY ?)?([0-9]{4})\s*$", 1)
    short = F.regexp_extract(c, r"^\s*FY ?([0-9]{2})\s*$", 1)
    year = F.when(full != "", full).when(short != "", F.concat(F.lit("20"), short))
    return F.when(year.between("1900", "2100"), year)


def fiscal_year_of_path(c: Column) -> Column:
    year = F.regexp_extract(c, r"(?:^|/)FY_?([0-9]{4})(?:/|$)", 1)
    return F.when(year != "", year)


def change_percent(now: Column, before: Column, digits: int = 2) -> Column:
    """Change in percent of the magnitude before; null if either is missing or there was nothing before."""
    return F.when(before.isNotNull() & (before != 0), F.round((now - before) / F.abs(before) * 100, digits))


def lenient_amount(c: Column) -> Column:
    """A number behind currency signs and thousands separators; 0 where there is none."""
    return F.coalesce(F.regexp_replace(c, r"[$,\s]", "").try_cast("double"), F.lit(0.0))


def amount_token(c: Column) -> Column:
    """A table cell's amount; dashes and words such as TBD are missing values."""
    return F.regexp_replace(c, r"[*#$,\s]", "").try_cast("double")


def pe_numbers(c: Column) -> Column:
    """All distinct program element numbers of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(PE_NUMBER), 1))


def edit_budget(c: Column) -> Column:
    """Edits that a fuzzy match may take, by length."""
    return F.when(F.length(c) <= 4, 1).when(F.length(c) <= 8, 2).otherwise(3)


def let(value: Column, use) -> Column:
    """use(value), where the value is worked out once however often it is used: Catalyst shares no parts of an
    expression inside lambdas, conditions and generators."""
    return F.transform(F.array(value), use)[0]


def words_of(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def counted(words: Column) -> Column:
    """array<struct(term, frequency)> of an array, by term: where a term begins in the sorted words, and where the next one does."""

    def of(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda w, i: F.when((i == 0) | (F.get(s, i - 1) != w), i)), lambda i: i.isNotNull())
        return let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("frequency"))))

    return let(F.array_sort(words), of)


def snippet(c: Column, term: str, before: int = 80, size: int = 200) -> Column:
    """Text around the first hit, with ellipses where it is cut; the beginning if nothing hits."""
    at = F.locate(term.lower(), F.lower(c))
    start = F.greatest(F.lit(1), at - before)
    cut = F.substring(c, start, F.lit(size))
    return F.concat(F.when(start > 1, F.lit("...")).otherwise(""), cut, F.when(F.length(c) > start + size - 1, F.lit("...")).otherwise(""))


def context(c: Column, term: str, around: int = 100) -> Column:
    """The hit with so many characters on both sides, on one line; null without one."""
    at = F.locate(term, c)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.translate(F.substring(c, start, at + len(term) + around - start), "\n", " "))


def share(condition: Column, digits: int = 4) -> Column:
    """The share of rows for which the condition holds."""
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), digits)
