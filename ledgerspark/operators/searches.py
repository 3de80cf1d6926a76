"""What users type into the search box, read by column functions: one text, or a table of saved searches.

A text may name fields (`pe:`, `org:`, ... with a plain or quoted value), bound the amount (`amount>=N`)
and hold words and quoted phrases. Values of one field are alternatives, different fields and words
must all hold; of several bounds the tightest counts, and > and >= are the same, as < and <= are.
Saved searches meet the lines by equality of one of their conditions, so there is no product of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import fixed_values as V
from ledgerspark.functions.expressions import all_of, words_of
from ledgerspark.operators.filters import where_lines

#: The names of fields in a text, and the columns they are about.
FIELDS = {"pe": "pe_number", "service": "organization_name", "exhibit": "exhibit_type", "fy": "fiscal_year", "tag": "tag", "year": "fiscal_year", "type": "exhibit_type", "org": "organization_name", "approp": "appropriation_code"}
#: Columns in the order in which a search is looked up by them: what few lines have in common comes first.
LOOKED_UP = ["pe_number", "appropriation_code", "tag", "exhibit_type", "organization_name", "fiscal_year"]
#: A column with at most so many values asked for: lines with another value are not dealt out by it.
FEW = 1000
NAME, QUOTED = "(?:" + "|".join(FIELDS) + "):", "\"[^\"]+\"|'[^']+'"
BOUND = r"amount\s*([<>]=?)\s*([0-9]+(?:\.[0-9]+)?)"


def query_terms(c: Column) -> Column:
    """array<string>: the plain terms of a text: no signs or words of query syntax, nothing that is only dashes."""
    plain = F.filter(F.split(F.trim(F.regexp_replace(F.translate(c, V.QUERY_SIGNS, " " * len(V.QUERY_SIGNS)), r"\s+", " ")), " "), lambda t: F.ltrim(t, F.lit("-")) != "")
    return F.filter(plain, lambda t: ~F.upper(t).isin(V.QUERY_WORDS))


def search_parts(c: Column) -> Column:
    """array<struct(kind, value)> of a text, in its order: kind is a column, least, most, phrase or word."""

    def part(x: Column) -> Column:
        name, sign = F.lower(F.regexp_extract(x, f"(?i)^{NAME}", 0)), F.regexp_extract(x, f"(?i)^{BOUND}", 1)
        kind = F.when(name != "", F.element_at(F.create_map(*[F.lit(y) for k, v in FIELDS.items() for y in (k + ":", v)]), name))
        kind = kind.when(F.startswith(sign, F.lit(">")), "least").when(F.startswith(sign, F.lit("<")), "most").when(F.rlike(x, F.lit(f"^(?:{QUOTED})$")), "phrase").otherwise("word")
        value = F.when(sign != "", F.regexp_extract(x, f"(?i)^{BOUND}", 2)).otherwise(F.substr(x, F.length(name) + 1))
        return F.struct(kind.alias("kind"), F.when(F.rlike(value, F.lit(f"^(?:{QUOTED})$")), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value"))

    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?i){NAME}(?:{QUOTED}|\S+)|{BOUND}|{QUOTED}|\S+"), F.lit(0))
    return F.transform(found, part)


def merged_search(c: Column) -> Column:
    """struct of a text's conditions: an array of lower-case values for each column, least, most, words and phrases."""
    parts = search_parts(c)
    of = lambda kind: F.transform(F.filter(parts, lambda p: p["kind"] == kind), lambda p: F.lower(p["value"]))
    number = lambda kind: F.transform(of(kind), lambda v: v.cast("double"))
    words = F.array_distinct(F.flatten(F.transform(of("word"), query_terms)))
    phrases = F.array_distinct(F.filter(F.transform(of("phrase"), lambda v: F.array_join(words_of(v), " ")), lambda v: v != ""))
    words = F.array_distinct(F.flatten(F.transform(words, words_of)))
    return F.struct(*[F.array_distinct(of(column)).alias(column) for column in LOOKED_UP], F.array_max(number("least")).alias("least"), F.array_min(number("most")).alias("most"), words.alias("words"), phrases.alias("phrases"))


def _lookup(s: Column, columns: list[str]) -> Column:
    """array<string> `column=value`: what a search is looked up by; `=` alone where nothing can be equal."""
    out = F.when(F.size(s["words"]) > 0, F.array(F.concat(F.lit("word="), s["words"][0]))).when(F.size(s["phrases"]) > 0, F.array(F.concat(F.lit("word="), F.split(s["phrases"][0], " ")[0]))).otherwise(F.array(F.lit("=")))
    for column in reversed(columns):
        out = F.when(F.size(s[column]) > 0, F.transform(s[column], lambda v: F.concat(F.lit(f"{column}="), v))).otherwise(out)  # noqa: B023
    return out


def search_classes(searches: DataFrame, search: str, text: str) -> DataFrame:
    """(search, same_as): searches with the same conditions find the same lines, and stand for each other by the least of them."""
    s = merged_search(F.col(text))
    canonical = F.struct(*[F.array_sort(s[c]).alias(c) for c in [*LOOKED_UP, "words", "phrases"]], s["least"].alias("least"), s["most"].alias("most"))
    asked = searches.select(search, F.sha2(F.to_json(canonical), 256).alias("_c"))
    return asked.join(asked.groupBy("_c").agg(F.min(search).alias("same_as")), "_c").select(search, "same_as")


def matching_lines(searches: DataFrame, lines: DataFrame, search: str, text: str, titles: list[str]) -> DataFrame:
    """(search, the columns of lines) for every saved search and line that it finds.

    Words are whole words of the titles, phrases words in a row; case is ignored. A search of amounts
    only, or an empty one, finds lines by no equality: it takes all lines, which are its result but
    for the bounds. A search on a column that lines lack finds nothing. Where many searches are the
    same, pass one of each class (`search_classes`).
    """
    columns = [c for c in LOOKED_UP if c in lines.columns]
    asked = searches.select(F.col(search).alias("_search"), merged_search(F.col(text)).alias("_s"))
    asked = asked.where(all_of(F.size(F.col("_s")[c]) == 0 for c in LOOKED_UP if c not in columns)).withColumn("_by", F.explode(_lookup(F.col("_s"), columns)))
    values = asked.select(F.substring_index("_by", "=", 1).alias("c"), "_by").distinct()
    used = {r["c"]: r["n"] for r in values.groupBy("c").agg(F.count("*").alias("n")).collect()}  # as many as there are columns
    few = [c for c, n in used.items() if n <= FEW]
    listed = {c: [r["_by"] for r in values.where(F.col("c").isin(few)).collect() if r["_by"].startswith(f"{c}=")] for c in few}  # at most FEW a column
    asked_for = lambda c, k: k.isin(listed[c]) if c in listed else F.lit(True)
    tokens = words_of(F.concat_ws(" ", *titles))
    key_of = lambda c: F.concat(F.lit(f"{c}="), F.lower(c))
    keys = [F.array(F.when(asked_for(c, key_of(c)), key_of(c))) for c in columns if c in used]
    keys += [F.filter(F.transform(F.array_distinct(F.col("_tokens")), lambda t: F.concat(F.lit("word="), t)), lambda k: asked_for("word", k))] * ("word" in used) + [F.array(F.lit("="))] * ("" in used)
    if not keys:
        return asked.select(F.col("_search").alias(search)).join(lines, F.lit(False))
    by_key = lines.withColumn("_tokens", tokens).withColumn("_by", F.explode(F.array_compact(F.concat(*keys) if len(keys) > 1 else keys[0])))
    s = F.col("_s")
    holds = [(F.size(s[c]) == 0) | F.array_contains(s[c], F.lower(c)) for c in columns]
    holds += [s["least"].isNull() | (F.col("amount") >= s["least"]), s["most"].isNull() | (F.col("amount") <= s["most"])]
    holds += [F.size(F.array_except(s["words"], F.col("_tokens"))) == 0]
    holds += [F.forall(s["phrases"], lambda p: F.contains(F.concat(F.lit(" "), F.array_join("_tokens", " "), F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" "))))]
    found = by_key.join(asked, "_by").where(all_of(holds))
    return found.select(F.col("_search").alias(search), *[found[c] for c in lines.columns])


def where_search(lines: DataFrame, text: str, titles: list[str], exact: dict[str, list[str]] | None = None) -> DataFrame:
    """The lines that one text finds, by conditions that reach the scan where the columns' cases agree.

    exact: the values that a column has, for which the text's are compared without regard to case.
    """
    s = lines.sparkSession.range(1).select(merged_search(F.lit(text)).alias("s")).first()["s"]  # one search
    lists = {}
    for column in LOOKED_UP:
        if s[column]:
            if column not in lines.columns:
                return lines.where(F.lit(False))
            known = {v.lower(): v for v in (exact or {}).get(column, [])}
            lists[column] = sorted({known.get(v, v.upper() if column == "pe_number" else v) for v in s[column]})
    out = where_lines(lines, s["least"], s["most"], **{c: v for c, v in lists.items() if c != "tag"})
    if not s["words"] and not s["phrases"]:
        return out
    tokens = F.concat(F.lit(" "), F.array_join(words_of(F.concat_ws(" ", *titles)), " "), F.lit(" "))
    return out.where(all_of(F.contains(tokens, F.lit(f" {w} ")) for w in [*s["words"], *s["phrases"]]))
