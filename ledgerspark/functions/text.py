"""Scalar functions on names, titles, codes and narrative text, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions import fixed_values as V
from ledgerspark.functions.expressions import all_of, any_of, let

_QUOTE = re.compile(r"([\\^$.|?*+()\[\]{}])")


def literal_pattern(word: str) -> str:
    """A regular expression that matches just this word."""
    return _QUOTE.sub(r"\\\1", word)


def looked_up(c: Column, table: dict[str, str]) -> Column:
    """The table's value, null where it has none."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c] if table else F.lit(None).cast("string")


def first_hit(c: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first part that occurs in the text, in the table's order."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(part)), F.lit(value)) for part, value in table])


# organizations and appropriations


def organization(c: Column, table: dict[str, list[str]] | None = None) -> Column:
    """The canonical name of an exact code or name; anything else stays."""
    known = {also: name for name, others in (table or V.ORGANIZATIONS).items() for also in [name, *others]} | ({} if table else {a: a for a in V.AGENCIES})
    return F.coalesce(looked_up(c, known), c)


def organization_loose(c: Column, table: dict[str, list[str]] | None = None, renamed: dict[str, str] | None = None) -> Column:
    """The same without regard to case and outer space, with names of the past."""
    known = {also.lower(): name for name, others in (table or V.ORGANIZATIONS).items() for also in [name, *others]}
    known |= ({} if table else {a.lower(): a for a in V.AGENCIES}) | (V.RENAMED if renamed is None else renamed)
    return F.coalesce(looked_up(F.trim(F.lower(c)), known), c)


def organization_of_source(path: Column, head: Column, by_path: list[tuple[str, str]], by_phrase: list[tuple[str, str]], within: int = 500) -> Column:
    """By a part of the path, else by a phrase in the first characters of the text, where case does not count."""
    upper = [(part.upper(), value) for part, value in by_phrase]
    return F.coalesce(first_hit(F.lower(path), [(part.lower(), value) for part, value in by_path]), first_hit(F.upper(F.substring(head, 1, within)), upper))


def appropriation(title: Column, titles: dict[str, list[str]] | None = None, keywords: list[tuple[str, str]] | None = None) -> Column:
    """struct(code, title): by the whole title, by a leading number, or by the first keyword in it."""
    exact = {t: code for code, ts in (titles or V.TITLE_CODES).items() for t in ts}
    s = F.trim(title)
    number, rest = F.regexp_extract(s, r"^([0-9]+)\s+(.+)$", 1), F.regexp_extract(s, r"(?s)^[0-9]+\s+(.+)$", 1)
    code = looked_up(s, exact)
    made = F.when(code.isNotNull(), F.struct(code.alias("code"), s.alias("title")))
    made = made.when((number != "") & (rest != ""), F.struct(number.alias("code"), rest.alias("title")))
    return F.when(s != "", made.otherwise(F.struct(first_hit(F.lower(s), keywords or V.KEYWORD_CODES).alias("code"), s.alias("title"))))


def resolved_code(title: Column, **tables) -> Column:
    """The appropriation code; a title that is only a number is one itself."""
    return F.when(F.trim(title).rlike(r"^[0-9]+$"), F.trim(title)).otherwise(appropriation(title, **tables)["code"])


def color_of_money(title: Column) -> Column:
    """What the appropriation's money is called; an unknown title stays, a missing one is Unknown."""
    upper = F.upper(title)
    hits = [(part, name) for name, parts in V.COLORS for part in parts]
    return F.when(F.coalesce(title, F.lit("")) == "", "Unknown").otherwise(F.coalesce(first_hit(upper, hits), title))


def budget_activity(number: Column, title: Column) -> Column:
    """The label of an activity number, else the title, else Unknown."""
    titled = F.when(F.coalesce(title, F.lit("")) != "", F.trim(title))
    return F.coalesce(looked_up(F.trim(number), V.ACTIVITIES), titled, F.lit("Unknown"))


def activity_of_program(pe: Column) -> Column:
    """struct(number, title) by the third and fourth digit of a program element that begins with 06; else null."""
    number = F.substring(pe, 3, 2)
    label = looked_up(number, V.ACTIVITIES)
    return F.when(F.startswith(pe, F.lit("06")) & label.isNotNull(), F.struct(number.alias("number"), label.alias("title")))


def budget_type(given: Column, code: Column, types: dict[str, str]) -> Column:
    return F.coalesce(given, looked_up(code, types), code, F.lit("Unknown"))


# program elements and projects


def primary_program(*columns: Column) -> Column:
    """struct(pe_number, others): the first program element of several texts and the rest, each once."""
    found = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", *columns), F.lit(rf"\b([0-9]{{7}}{V.PE_LETTERS})\b"), 1))
    return F.struct(F.try_element_at(found, F.lit(1)).alias("pe_number"), F.slice(found, 2, F.greatest(F.size(found), F.lit(1))).alias("others"))


def is_program(c: Column, any_case: bool = False) -> Column:
    return F.coalesce(F.rlike(c, F.lit(("(?i)" if any_case else "") + f"^[0-9]{{7}}{V.PE_LETTERS}$")), F.lit(False))


def project_code(c: Column) -> Column:
    """The code as it is compared: of a number with one letter before it (E, P, J or S) or behind it (any)
    the number without leading zeros, unless it is all zeros; of other codes what is left without dashes."""
    s = F.trim(c)
    shape = F.regexp_replace(F.regexp_replace(s, "[0-9]+", "9"), r"\p{L}", "A")
    number = F.regexp_extract(s, "[0-9]+", 0)
    short = F.ltrim(number, F.lit("0"))
    lettered = (shape == "9A") | ((shape == "A9") & F.upper(F.substring(s, 1, 1)).isin("E", "P", "J", "S"))
    return F.when(lettered, F.when(short == "", number).otherwise(short)).when(F.contains(s, F.lit("-")), F.translate(s, "-", "")).when(c != "", c)


def _is_remark(word: Column) -> Column:
    """An amount with two or three decimals, or a word of dashes and asterisks as tables use them."""
    return F.rlike(word, F.lit("^[0-9,]+[.][0-9]{2,3}$")) | F.translate(word, "*", "").isin("", "-", "--")


def _coded(s: Column) -> Column:
    """struct(code, title) of `code title`, `code: title` or `code.: title`, the code up to three letters and
    up to six digits; null for other texts."""

    def split_at(x: Column) -> Column:
        head, behind = x["head"], x["behind"]
        colon = F.startswith(behind, F.lit(":"))
        label = F.when(colon, F.regexp_replace(head, "[.]$", "")).otherwise(head)
        return F.struct(label.alias("label"), F.trim(F.when(colon, F.substr(behind, F.lit(2))).otherwise(behind)).alias("title"))

    def checked(x: Column) -> Column:
        letters = F.length(F.regexp_extract(x["label"], "^[A-Za-z]*", 0))
        return let(F.struct(letters.alias("n"), F.substr(x["label"], letters + 1).alias("digits")), lambda d: coded(x, d))

    def coded(x: Column, d: Column) -> Column:
        is_code = (d["n"] <= 3) & F.length(d["digits"]).between(1, 6) & (F.translate(d["digits"], "0123456789", "") == "")
        return F.when(is_code & (x["title"] != ""), F.struct(project_code(x["label"]).alias("code"), x["title"].alias("title")))

    parts = let(F.regexp_extract(s, r"^[^\s:]+", 0), lambda head: F.struct(head.alias("head"), F.substr(s, F.length(head) + 1).alias("behind")))
    return let(let(parts, split_at), checked)


def project_title(c: Column) -> Column:
    """struct(code, title) of a table row's title, null where that is no project.

    Words are dropped from the right: amounts and marks, then asterisks at the last word, then one
    abbreviation in brackets. The first word always stays.
    """

    def without_remarks(words: Column) -> Column:
        last = F.array_max(F.transform(words, lambda w, i: F.when((i == 0) | ~_is_remark(F.trim(w)), i + 1)))
        return F.slice(words, 1, F.coalesce(last, F.lit(0)))

    def without_abbreviation(words: Column) -> Column:
        bracketed = F.rlike(F.trim(F.rtrim(F.try_element_at(words, F.lit(-1)), F.lit("*"))), F.lit("^[(][A-Z]{2,6}[)]$"))
        return F.when(bracketed & (F.size(words) > 1), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(words)

    def titled(s: Column) -> Column:
        bare = F.rtrim(s, F.lit("*- "))
        junk = s.isin(V.JUNK_TITLES) | bare.isin(V.JUNK_TITLES) | any_of(F.startswith(s, F.lit(x)) for x in V.JUNK_BEGINNINGS)
        return F.when((s != "") & ~junk, F.coalesce(_coded(s), F.struct(F.lit(None).cast("string").alias("code"), s.alias("title"))))

    words = let(let(F.regexp_extract_all(F.trim(c), F.lit(r"\s*\S+"), F.lit(0)), without_remarks), without_abbreviation)
    return let(F.trim(F.rtrim(F.array_join(words, ""), F.lit("*"))), titled)


def is_project_number(c: Column, labels: list[str] = ("TITLE", "ELEMENT", "NUMBER", "NAME", "PROJECT")) -> Column:
    """Two characters or more, not a small number, not all lower case, not one of the labels."""
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    lower = (letters != "") & (letters == F.lower(letters))
    return F.coalesce((F.length(c) >= 2) & ~F.upper(c).isin(list(labels)) & ~c.rlike(r"^[0-9]{1,2}$") & ~lower, F.lit(False))


def program_title(text: Column) -> Column:
    """What stands behind `PE 1234567A:` or `/`, up to a number or the line's end; null without one."""
    found = F.regexp_extract(text, rf"(?m)PE\s+[0-9]{{7}}{V.PE_LETTERS}\s*[/:]\s*(.+?)(?:\s+[0-9]|$)", 1)
    return F.when(found != "", found)


def program_name(c: Column) -> Column:
    """Lower case, only letters and digits, single spaces: a key for names of one program."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]+", " "), r"\s+", " "))


def stamp(c: Column) -> Column:
    """A time as text, to the second: texts are in the order of the times."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# keywords


def expanded(words: list[str], acronyms: dict[str, str]) -> list[str]:
    """The words and, behind each, what its acronym stands for or the acronym for it; each once, case ignored."""
    both = {}
    for short, long in acronyms.items():
        both.setdefault(short.lower(), []).append(long.lower())
        both.setdefault(long.lower(), []).append(short.lower())
    out: dict[str, str] = {}
    for w in words:
        out.setdefault(w.lower(), w)
        for other in both.get(w.lower(), []):
            out.setdefault(other, other)
    return list(out.values())


def keywords_in(columns: list[Column], words: list[str]) -> Column:
    """The words that occur as whole words in any of the texts, in their order; a word ends where no ASCII
    letter, digit or underscore follows."""
    text = F.lower(F.concat_ws(" ", *columns))
    tests = [F.when(F.rlike(text, F.lit(rf"(?<![a-z0-9_]){literal_pattern(w.lower().strip())}(?![a-z0-9_])")), F.lit(w)) for w in words if w.strip()]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def fuzzy_match(c: Column, word: str) -> Column:
    """`exact` for a part of the text, `fuzzy` for a token within the word's edit budget, else null."""
    w, budget = word.lower(), 1 if len(word) <= 4 else 2 if len(word) <= 8 else 3
    close = F.exists(F.split(F.lower(c), r"\s+"), lambda t: (F.length(t) >= 3) & (F.abs(F.length(t) - len(w)) <= budget) & (F.levenshtein(t, F.lit(w)) <= budget))
    out = F.when(F.contains(F.lower(c), F.lit(w)), "exact")
    return out.when(close, "fuzzy") if len(w) >= 3 else out


# narrative text


def without(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), patterns, c)


#: How the headings begin that page breaks leave in narrative text, and what ends each of them.
NEXT_PARAGRAPH = r"(?=\n[A-Za-z\n])|\z"
HEADINGS = {
    "element": (rf"(?i)PE\s+[0-9]{{7}}{V.PE_LETTERS}?\s*:", r"(?i)B\.\s*Accomplishments/Planned\s+Programs\s*\(\$\s*in\s+Millions\)(?:\s*FY\s*[0-9]{4})+\s*"),
    "exhibit": (r"(?i)Exhibit R-2A?,\s*RDT&E\s+Project\s+Justification:", NEXT_PARAGRAPH),
    "appropriation": (r"(?i)Appropriation/?Budget\s+Activity", rf"(?is)Project(?:\s*\(Number/Name\))?\s*\n.*?(?:{NEXT_PARAGRAPH})"),
}
#: Lines that go whole, and marks that go from within a line.
MARKED_LINES = {"classification": r"[ \t]*UNCLASSIFIED[ \t]*", "title with amounts": r"Title:[ \t].*?[ \t][0-9]+\.[0-9]{3}(?:[ \t]+(?:[0-9]+\.[0-9]{3}|[-0](?:\.[0-9]+)?))+[ \t]*"}
PAGE_MARKS = ["Volume [0-9]+ *- *[0-9]+", "(?:Air Force|Navy|Army|Defense[- ]Wide|MDA) Page [0-9]+ of [0-9]+", "R-1 Line #[0-9]+"]
BEGIN, END = "\x01", "\x02"


def _without_heading(c: Column, begins: str, ends: str) -> Column:
    """Both places are marked; what lies between a beginning and the next end goes."""
    marked = F.regexp_replace(F.regexp_replace(c, begins, BEGIN + "$0"), ends, "$0" + END)
    return F.translate(F.regexp_replace(marked, f"{BEGIN}[^{END}]*{END}", ""), BEGIN + END, "")


def clean_narrative(c: Column) -> Column:
    """The text without what page breaks left in it: three headings, two kinds of line, page marks, and
    more than one empty line in a row."""
    for begins, ends in HEADINGS.values():
        c = _without_heading(c, begins, ends)
    c = F.regexp_replace(c, "(?m)^(?:" + "|".join(MARKED_LINES.values()) + ")$", "")
    c = F.regexp_replace(c, "(?i)" + "|".join(PAGE_MARKS), "")
    return F.btrim(F.regexp_replace(c, r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))


def without_headers(c: Column, patterns: list[str], least: int = 25) -> Column:
    """The text without its headers; null where less than `least` characters are left."""
    left = F.btrim(without(c, patterns), F.lit(" \t\r\n"))
    return F.when(F.length(left) >= least, left)


def sections(c: Column, headers: list[str], least: int = 20) -> Column:
    """array<struct(header, text)>: the text between recognized headers, where it has so many characters."""
    marked = F.regexp_replace(c, "(?im)^[ \\t]*(" + "|".join(headers) + ")[ \\t]*:?[ \\t]*$", "\x01$1\x02")
    parts = F.slice(F.split(marked, "\x01"), 2, 1 << 30)
    cut = F.transform(parts, lambda x: F.struct(F.substring_index(x, "\x02", 1).alias("header"), F.btrim(F.substring_index(x, "\x02", -1), F.lit(" \t\r\n")).alias("text")))
    return F.filter(cut, lambda x: F.length(x["text"]) >= least)


def is_garbage_description(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(s) < V.LEAST_DESCRIPTION) | any_of(F.contains(F.substring(s, 1, V.HEADER_WITHIN), F.lit(m)) for m in V.HEADER_MARKS)


def mission_description(c: Column, begin: str, ends: list[str]) -> Column:
    """What stands between a heading and the first of the next headings; null without one."""
    found = F.regexp_extract(c, f"(?is){begin}\\s*:?\\s*(.*?)(?=" + "|".join([*ends, "\\z"]) + ")", 1)
    return F.when(found != "", F.btrim(found, F.lit(" \t\r\n")))


def table_text(rows: Column) -> Column:
    """array<array<string>> as lines of cells joined by a bar; empty cells and rows go."""
    lines = F.transform(rows, lambda r: F.array_join(F.filter(r, lambda x: x != ""), " | "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


# formats


def truncated(c: Column, size: int, mark: str = "...") -> Column:
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.substring(c, 1, size - len(mark)), F.lit(mark)))


def amount_text(thousands: Column) -> Column:
    """Thousands as $1.23B, $4.5M or $678K; null as a dash."""
    size = F.abs(thousands)
    scaled = F.when(size >= 1_000_000, F.concat(F.lit("$"), F.format_number(thousands / 1_000_000, 2), F.lit("B")))
    scaled = scaled.when(size >= 1_000, F.concat(F.lit("$"), F.format_number(thousands / 1_000, 1), F.lit("M")))
    return F.coalesce(scaled.when(thousands.isNotNull(), F.concat(F.lit("$"), F.format_number(thousands, 0), F.lit("K"))), F.lit("-"))


def _plain_number(c: Column, digits: int) -> Column:
    """Rounded as format_number does, without signs between thousands."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def percent_text(share: Column, digits: int = 1) -> Column:
    return F.concat(_plain_number(share * 100, digits), F.lit("%"))


def file_name(c: Column, most: int = 200) -> Column:
    """A name that every file system takes."""
    return F.substring(F.regexp_replace(c, r'[<>:"/\\|?*\s]+', "_"), 1, most)


def bytes_text(c: Column) -> Column:
    out = None
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        text = F.concat(_plain_number(c / float(1024**power), 1), F.lit(f" {unit}"))
        out = (F.when if out is None else out.when)(c >= 1024**power, text)
    return out.otherwise(F.concat(_plain_number(c.cast("double"), 1), F.lit(" B")))


def set_key(words: Column) -> Column:
    """A key of a set of words: neither order nor case nor repeats count."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(words, lambda w: F.lower(F.trim(w)))))), 256)


# years, numbers, arrays


def canonical_year(c: Column) -> Column:
    """`FY 2026` for anything with such a year, else unchanged."""
    year = F.regexp_extract(c, r"(?i)^\s*(?:FY\s*)?((?:19|20)[0-9]{2})\s*$", 1)
    return F.when(year != "", F.concat(F.lit("FY "), year)).otherwise(c)


def year_key(c: Column) -> Column:
    """The digits as a number, 0 without any: an order of years."""
    return F.coalesce(F.regexp_replace(c, r"[^0-9]", "").try_cast("int"), F.lit(0))


def full_year(two_digits: Column, pivot: int = 50) -> Column:
    n = two_digits.cast("int")
    return F.when(n < pivot, n + 2000).otherwise(n + 1900)


def is_year(c: Column) -> Column:
    """Missing, or four digits with or without FY."""
    return c.isNull() | c.rlike(r"^(FY ?)?[0-9]{4}$")


def is_amount(c: Column, most: float = 1e9) -> Column:
    return F.coalesce(c.between(-most, most), F.lit(False))


def amounts_in(c: Column) -> Column:
    """array<double> of the tokens that are amounts; a dash is zero, words go."""
    tokens = F.transform(F.split(F.trim(c), r"\s+"), lambda t: F.when(t == "-", "0").otherwise(F.regexp_replace(t, r"[,*#$]", "")))
    return F.array_compact(F.transform(tokens, lambda t: t.try_cast("double")))


def paired(labels: Column, amounts: Column) -> Column:
    """array<struct(label, amount)> as long as the shorter one."""
    n = F.least(F.size(labels), F.size(amounts))
    return F.transform(F.slice(F.arrays_zip(labels.alias("label"), amounts.alias("amount")), 1, F.greatest(n, F.lit(1))), lambda x: F.struct(x["label"].alias("label"), x["amount"].alias("amount")))


def padded(values: Column, size: int) -> Column:
    """The array with exactly so many entries, filled up with nulls."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(None).cast("double"), size)), 1, size)


def amount_column(name: str) -> tuple[str, str] | None:
    """(`2026`, `request`) of amount_fy2026_request; None of other names."""
    found = re.fullmatch(r"amount_fy([0-9]{4})_([a-z]+)", name)
    return (found[1], found[2]) if found else None


def json_list(c: Column) -> Column:
    """A JSON array of strings; anything else is an empty one."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def without_year_prefix(values: Column) -> Column:
    return F.transform(values, lambda x: F.regexp_replace(x, r"^FY ", ""))


def is_text(c: Column, within: tuple[int, int] = (1, 200)) -> Column:
    """A name that is there and has a plausible length."""
    return F.coalesce(all_of([F.length(F.trim(c)) >= within[0], F.length(c) <= within[1]]), F.lit(False))
