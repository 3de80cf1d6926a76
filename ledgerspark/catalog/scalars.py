"""Scalar functions over whole tables. Inputs that the tables lack are put together from their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions import expressions as X
from ledgerspark.functions import fixed_values as V
from ledgerspark.functions import text as T
from ledgerspark.registry import on_facts, on_table, on_tables


def _case(expression: str, table: list[tuple[str, str]]) -> str:
    """CASE over the parts of a text, in order."""
    return "CASE " + " ".join(f"WHEN contains({expression}, '{k}') THEN '{v}'" for k, v in table) + " END"


# text


@on_table(
    "st02_program_numbers",
    "part",
    r"""WITH t AS (SELECT p_partkey, 'see ' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || 'A and ' || lpad(CAST(p_size AS VARCHAR), 7, '0') || 'D8Z, ' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || 'A' AS t
FROM part)
   
SELECT p_partkey, regexp_extract(t, '[0-9]{7}(?:[A-Z]{1,2}|[A-Z][0-9][A-Z])\b') AS pe_number, lpad(CAST(p_size AS VARCHAR), 7, '0') || 'D8Z' AS others
FROM t JOIN part USING (p_partkey)""",
)
def _(df):
    pe = F.concat(F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("A"))
    text = F.concat(F.lit("see "), pe, F.lit(" and "), F.lpad(F.col("p_size").cast("string"), 7, "0"), F.lit("D8Z, "), pe)
    found = T.primary_program(text)
    return df.select("p_partkey", found["pe_number"].alias("pe_number"), F.array_join(found["others"], ",").alias("others"))


@on_facts("st03_primary_program", " SELECT DISTINCT pe_number AS title_of, pe_number, '' AS others FROM facts", ["pe_number", "line_item_title"])
def _(df):
    found = T.primary_program(F.lit("line"), F.col("pe_number"), F.col("line_item_title"))
    return df.select(F.col("pe_number").alias("title_of"), found["pe_number"].alias("pe_number"), F.array_join(found["others"], ",").alias("others")).distinct()


_TITLES = ["RDT&E, Army", "2035 Aircraft Procurement, Army", "National Guard Military Construction", "Contingency Pay", "  ", "0400"]
_TITLE_OF = "CASE p_size % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TITLES)) + " END"


@on_table("st04_appropriations", "part", f"""WITH t AS (SELECT p_partkey, trim({_TITLE_OF}) AS t FROM part)
SELECT p_partkey, CASE t WHEN 'RDT&E, Army' THEN 'RDTE' WHEN '2035 Aircraft Procurement, Army' THEN '2035' WHEN 'National Guard Military Construction' THEN 'MILCON' END AS code,
CASE WHEN t = '' THEN NULL WHEN starts_with(t, '2035') THEN 'Aircraft Procurement, Army' ELSE t END AS title FROM t""")  # fmt: skip
def _(df):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), F.col("p_size") % 6 + 1)
    found = T.appropriation(title)
    return df.select("p_partkey", found["code"].alias("code"), found["title"].alias("title"))


@on_table("st05_resolved_codes", "part", f"""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'RDTE' WHEN 1 THEN '2035' WHEN 2 THEN 'MILCON' WHEN 5 THEN '0400' END AS code
FROM (SELECT *, {_TITLE_OF} FROM part)""")
def _(df):
    return df.select("p_partkey", T.resolved_code(F.element_at(F.array(*map(F.lit, _TITLES)), F.col("p_size") % 6 + 1)).alias("code"))


_REGIONS = {"Africa": ["AFRICA", "AF"], "Orient": ["ASIA", "MIDDLE EAST"]}


@on_table("st06_organizations", "region", """SELECT r_name, CASE r_name WHEN 'AFRICA' THEN 'Africa' WHEN 'ASIA' THEN 'Orient' WHEN 'MIDDLE EAST' THEN 'Orient' ELSE r_name END AS exact,
CASE r_name WHEN 'AFRICA' THEN 'Africa' WHEN 'ASIA' THEN 'Orient' WHEN 'MIDDLE EAST' THEN 'Orient' WHEN 'EUROPE' THEN 'EU' ELSE ' ' || lower(r_name) END AS loose
FROM region""")  # fmt: skip
def _(df):
    loose = T.organization_loose(F.concat(F.lit(" "), F.lower("r_name")), _REGIONS, {"europe": "EU"})
    return df.select("r_name", T.organization(F.col("r_name"), _REGIONS).alias("exact"), loose.alias("loose"))


@on_table("st07_organizations_of_sources", "documents", """SELECT doc_id, CASE WHEN contains(source, 'rc1') THEN 'One' WHEN contains(source, 'rc2') THEN 'Two'
WHEN contains(upper(substring(text, 1, 500)), 'THE ') THEN 'The' WHEN contains(upper(substring(text, 1, 500)), 'EAUX') THEN 'Eaux' END AS organization
FROM documents""")  # fmt: skip
def _(df):
    return df.select("doc_id", T.organization_of_source(F.col("source"), F.col("text"), [("RC1", "One"), ("rc2", "Two")], [("the ", "The"), ("eaux", "Eaux")]).alias("organization"))


@on_table("st08_project_titles", "part", r"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CASE p_size % 5 WHEN 1 THEN CAST(p_partkey % 900000 + 1 AS VARCHAR) WHEN 2 THEN CAST(p_partkey % 900000 + 1 AS VARCHAR) WHEN 3 THEN 'DD' || CAST((p_partkey % 900000) AS VARCHAR) END END AS code,
CASE WHEN p_size % 5 <> 0 THEN p_name END AS title FROM part""")  # fmt: skip
def _(df):
    key = (F.col("p_partkey") % 900000 + 1).cast("string")
    raw = F.when(F.col("p_size") % 5 == 0, "Total PE Cost 12.345 -").when(F.col("p_size") % 5 == 1, F.concat(key, F.lit(": "), "p_name", F.lit(" 4,439.845 101.694 - *")))
    raw = raw.when(F.col("p_size") % 5 == 2, F.concat(F.lit("E"), key, F.lit(" "), "p_name", F.lit(" (GDI)")))
    raw = raw.when(F.col("p_size") % 5 == 3, F.concat(F.lit("DD"), (F.col("p_partkey") % 900000).cast("string"), F.lit(".: "), "p_name", F.lit(" -"))).otherwise(F.concat("p_name", F.lit(" **")))
    found = T.project_title(raw)
    return df.select("p_partkey", found["code"].alias("code"), found["title"].alias("title"))


@on_table("st09_project_codes", "part", r"""WITH t AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'E' || p_partkey WHEN 1 THEN '000' || p_partkey || 'C' WHEN 2 THEN 'MED-' || p_partkey WHEN 3 THEN 'DX' || p_partkey ELSE '' END AS t, p_size % 5 AS k
FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN CASE WHEN p_partkey = 0 THEN '0000' ELSE CAST(p_partkey AS VARCHAR) END WHEN 2 THEN 'MED' || p_partkey WHEN 3 THEN t END AS code
FROM t""")  # fmt: skip
def _(df):
    key = F.col("p_partkey").cast("string")
    raw = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("E"), key)).when(F.col("p_size") % 5 == 1, F.concat(F.lit("000"), key, F.lit("C")))
    raw = raw.when(F.col("p_size") % 5 == 2, F.concat(F.lit("MED-"), key)).when(F.col("p_size") % 5 == 3, F.concat(F.lit("DX"), key)).otherwise("")
    return df.select("p_partkey", T.project_code(raw).alias("code"))


_BA = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ACTIVITIES.items())


@on_table("st10_activities_of_programs", "part", f"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '06' ELSE '03' END || lpad(CAST(p_size % 10 AS VARCHAR), 2, '0') || '123A' AS pe
FROM part)
SELECT p_partkey, CASE WHEN starts_with(pe, '06') THEN CASE substring(pe, 3, 2) {_BA} END END AS title FROM t""")  # fmt: skip
def _(df):
    pe = F.concat(F.when(F.col("p_partkey") % 2 == 0, "06").otherwise("03"), F.lpad((F.col("p_size") % 10).cast("string"), 2, "0"), F.lit("123A"))
    return df.select("p_partkey", T.activity_of_program(pe)["title"].alias("title"))


@on_table("st11_labels", "part", f"""SELECT p_partkey, CASE lpad(CAST(p_size % 10 AS VARCHAR), 2, '0') {_BA} ELSE p_type END AS activity,
CASE p_size % 4 WHEN 0 THEN 'RDT&E' WHEN 1 THEN 'O&M' WHEN 2 THEN 'Unknown' ELSE p_name END AS color FROM part""")  # fmt: skip
def _(df):
    title = F.when(F.col("p_size") % 4 == 0, "Research and Operations").when(F.col("p_size") % 4 == 1, "Operations, Navy").when(F.col("p_size") % 4 == 2, "").otherwise(F.col("p_name"))
    number = F.lpad((F.col("p_size") % 10).cast("string"), 2, "0")
    return df.select("p_partkey", T.budget_activity(number, F.col("p_type")).alias("activity"), T.color_of_money(title).alias("color"))


_ACRONYMS = {"sr": "small ring", "rw": "red widget"}


@on_table("st15_expanded_keywords", "part", """SELECT DISTINCT p_name FROM part
WHERE contains(lower(p_name), 'sr') OR contains(lower(p_name), 'small ring') OR contains(lower(p_name), 'red widget') OR contains(lower(p_name), 'rw')""")
def _(df):
    return df.where(X.contains_any(["p_name"], T.expanded(["SR", "red widget"], _ACRONYMS))).select("p_name").distinct()


@on_table("st16_whole_words", "documents", r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])license([^a-z0-9_]|$)') THEN 'License' END,
CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])the([^a-z0-9_]|$)') THEN 'the' END, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])error([^a-z0-9_]|$)') THEN 'error' END], lambda x: x IS NOT NULL), ',') AS words
FROM documents""")  # fmt: skip
def _(df):
    return df.select("doc_id", F.array_join(T.keywords_in([F.col("text")], ["License", "the", "error"]), ",").alias("words"))


@on_table("st17_clean_narratives", "documents", r"""SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(9) || chr(13) || chr(10))) AS digest
FROM documents""")
def _(df):
    before = ["", "PE 0601234A: A Name\nof two lines\nB. Accomplishments/Planned Programs ($ in Millions) FY 2024 FY 2025\n", "", "Appropriation/Budget Activity\n3600 / 2\nProject (Number/Name)\n(12 / Name\n\n", " UNCLASSIFIED\t\n", "Title: Some Thing 12.345 6.789 -\n", "Volume 3 - 355\n"]
    behind = ["", "\n\n\n", "\n\nExhibit R-2A, RDT&E Project Justification: PB 2025\n(of Air Force)", "", "\n\nUNCLASSIFIED", "\nTitle: Other 1.000 0.5", "\nDefense-Wide Page 5 of 70 R-1 Line #12"]
    of = lambda kinds: F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 7 + 1).cast("int"))
    marked = F.concat(of(before), F.coalesce("text", F.lit("")), of(behind))
    return df.select("doc_id", F.md5(T.clean_narrative(marked)).alias("digest"))


@on_table("st18_without_headers", "part", "SELECT p_partkey, CASE WHEN length(p_name || p_brand || p_type) >= 25 THEN p_name || p_brand || p_type END AS rest FROM part")
def _(df):
    text = F.concat(F.lit("Exhibit R-2, RDT&E Budget Item\n"), "p_name", "p_brand", "p_type", F.lit("\nPage 3 of 9"))
    return df.select("p_partkey", T.without_headers(text, [r"(?m)^Exhibit R-2.*$", r"Page [0-9]+ of [0-9]+"]).alias("rest"))


@on_table("st19_sections", "part", """SELECT p_partkey, 'Mission' AS header, p_name || ' is made by ' || p_brand AS text FROM part WHERE length(p_name || ' is made by ' || p_brand) >= 20
UNION ALL SELECT p_partkey, 'Plans', 'more of ' || p_type || ' next year' FROM part""")  # fmt: skip
def _(df):
    text = F.concat(F.lit("front\nMission:\n"), "p_name", F.lit(" is made by "), "p_brand", F.lit("\nPLANS\nshort\nPlans \nmore of "), "p_type", F.lit(" next year"))
    return df.select("p_partkey", F.explode(T.sections(text, ["Mission", "Plans"])).alias("s")).select("p_partkey", "s.header", "s.text")


@on_table("st20_first_boundaries", "documents", r"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '\b([A-Z][a-z]{2,9})\.', 1))) AS word, text FROM documents)
SELECT doc_id, word, instr(text, word || '.') AS place FROM t WHERE instr(text, word || '.') > 0 AND regexp_full_match(word, '[A-Za-z]+')""")  # fmt: skip
def _(df):
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b([A-Z][a-z]{2,9})\."), 1))
    each = df.select("doc_id", "text", F.explode(words).alias("word"))
    return each.select("doc_id", "word", F.instr("text", F.concat("word", F.lit("."))).cast("long").alias("place"))


@on_table("st21_project_numbers", "part", """WITH t AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'TITLE' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'funds' WHEN 3 THEN 'x' WHEN 4 THEN 'P' || p_partkey ELSE CAST(1000 + p_partkey AS VARCHAR) END AS t, p_size
FROM part)
SELECT p_partkey, p_size % 6 IN (4, 5) AS valid FROM t""")  # fmt: skip
def _(df):
    key, k = F.col("p_partkey"), F.col("p_size") % 6
    t = F.when(k == 0, "TITLE").when(k == 1, F.col("p_size").cast("string")).when(k == 2, "funds").when(k == 3, "x").when(k == 4, F.concat(F.lit("P"), key.cast("string"))).otherwise((1000 + key).cast("string"))
    return df.select("p_partkey", T.is_project_number(t).alias("valid"))


@on_table("st22_garbage_descriptions", "documents", "SELECT doc_id, length(trim(coalesce(text, ''))) < 80 AS garbage FROM documents")
def _(df):
    return df.select("doc_id", T.is_garbage_description(F.col("text")).alias("garbage"))


@on_table("st23_program_names", "part", r"""SELECT DISTINCT p_brand, trim(regexp_replace(regexp_replace(lower(p_brand || ' (' || p_name || ')'), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS name
FROM part""")
def _(df):
    return df.select("p_brand", T.program_name(F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")"))).alias("name")).distinct()


@on_facts("st24_program_titles", " SELECT DISTINCT pe_number, line_item_title AS title FROM facts", ["pe_number", "line_item_title"])
def _(df):
    page = F.concat(F.lit("Exhibit R-2\nPE "), "pe_number", F.lit(": "), "line_item_title", F.lit("  12.5\nmore"))
    return df.select("pe_number", T.program_title(page).alias("title")).distinct()


@on_table("st25_context_windows", "documents", """WITH d AS (SELECT doc_id, text, instr(text, 'the ') AS hit FROM documents)
SELECT doc_id, replace(substring(text, greatest(1, hit - 100), hit + 104 - greatest(1, hit - 100)), chr(10), ' ') AS context FROM d WHERE hit > 0""")  # fmt: skip
def _(df):
    return df.where(F.contains("text", F.lit("the "))).select("doc_id", X.context(F.col("text"), "the ").alias("context"))


@on_table("st26_missions", "part", "SELECT p_partkey, p_name || ' of' || chr(10) || p_brand AS mission FROM part")
def _(df):
    text = F.concat(F.lit("x\nA. Mission Description: "), "p_name", F.lit(" of\n"), "p_brand", F.lit("\nB. Program Change\ny"))
    return df.select("p_partkey", T.mission_description(text, r"A\. Mission Description", [r"B\. Program"]).alias("mission"))


@on_table("st27_formats", "part", """SELECT p_partkey, CASE WHEN length(p_name || p_type) <= 12 THEN p_name || p_type ELSE substring(p_name || p_type, 1, 9) || '...' END AS short, format('{:.1f}%', p_size::DOUBLE) AS share
FROM part""")
def _(df):
    return df.select("p_partkey", T.truncated(F.concat("p_name", "p_type"), 12).alias("short"), T.percent_text(F.col("p_size") / 100).alias("share"))


@on_table("st28_file_names", "pages", r"""SELECT page_id, substring(regexp_replace(url, '[<>:"/\\|?*\s]+', '_', 'g'), 1, 200) AS name, CASE WHEN strlen(html) >= 1048576 THEN format('{:.1f} MB', strlen(html) / 1048576.0) WHEN strlen(html) >= 1024 THEN format('{:.1f} KB', strlen(html) / 1024.0) ELSE format('{:.1f} B', strlen(html) * 1.0) END AS size
FROM pages""")
def _(df):
    return df.select("page_id", T.file_name(F.col("url")).alias("name"), T.bytes_text(F.octet_length("html")).alias("size"))


@on_table("st29_set_keys", "part", """SELECT DISTINCT p_brand, sha256(CASE WHEN lower(p_brand) < 'z ring' THEN lower(p_brand) || ',z ring' ELSE 'z ring,' || lower(p_brand) END) AS id
FROM part""")
def _(df):
    return df.select("p_brand", T.set_key(F.array(F.lit("Z Ring"), "p_brand", F.lower("p_brand"))).alias("id")).distinct()


@on_table("st30_sql_scalars", "part", """SELECT p_partkey, substr(p_name, 2, 4) AS cut, instr(p_name, 'ring') AS place, upper(trim(p_name)) AS loud, replace(p_name, ' ', '_') AS joined,
regexp_matches(p_brand, '^Brand#[0-9]$') AS globbed, length(p_name || chr(10) || p_type) AS n FROM part""")  # fmt: skip
def _(df):
    return df.select(
        "p_partkey", F.substring("p_name", 2, 4).alias("cut"), F.instr("p_name", "ring").cast("long").alias("place"), F.upper(F.trim("p_name")).alias("loud"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("joined"), F.rlike("p_brand", F.lit("^Brand#[0-9]$")).alias("globbed"), F.length(F.concat("p_name", F.lit("\n"), "p_type")).cast("long").alias("n"),
    )


# years, numbers, JSON, arrays

_YEAR_FORMS = ["'FY ' || y", "'FY' || y", "y", "'FY' || substring(y, 3)", "' ' || y || ' '", "'in ' || y"]
_YEAR_OF = "CASE p_size % 6 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_YEAR_FORMS)) + " END"


def _year_text():
    y = (1990 + F.col("p_partkey") % 40).cast("string")
    forms = [F.concat(F.lit("FY "), y), F.concat(F.lit("FY"), y), y, F.concat(F.lit("FY"), F.substring(y, 3, 2)), F.concat(F.lit(" "), y, F.lit(" ")), F.concat(F.lit("in "), y)]
    return F.element_at(F.array(*forms), F.col("p_size") % 6 + 1)


@on_table("dt01_fiscal_years", "part", f"""WITH t AS (SELECT *, CAST(1990 + p_partkey % 40 AS VARCHAR) AS y FROM part), f AS (SELECT p_partkey, p_size % 6 AS k, y, {_YEAR_OF} AS t FROM t)
SELECT p_partkey, CASE WHEN k IN (0, 1, 2, 4) THEN y WHEN k = 3 THEN '20' || substring(y, 3) END AS bare, CASE WHEN k IN (0, 1, 2, 4) THEN 'FY ' || y ELSE t END AS canonical,
CASE WHEN k = 3 THEN CAST(substring(y, 3) AS INTEGER) ELSE CAST(y AS INTEGER) END AS sort_key FROM f""")  # fmt: skip
def _(df):
    t = _year_text()
    return df.select("p_partkey", X.fiscal_year(t).alias("bare"), T.canonical_year(t).alias("canonical"), T.year_key(t).alias("sort_key"))


@on_table("dt05_year_pivot", "part", "SELECT DISTINCT p_size, CASE WHEN p_size * 2 < 50 THEN 2000 + p_size * 2 ELSE 1900 + p_size * 2 END AS year FROM part WHERE p_size < 50")
def _(df):
    return df.where("p_size < 50").select("p_size", T.full_year((F.col("p_size") * 2).cast("string")).alias("year")).distinct()


@on_table("ma02_parsed_amounts", "part", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN -p_retailprice ELSE 0 END AS lenient,
CASE p_size % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN -p_retailprice END AS token FROM part""")  # fmt: skip
def _(df):
    price, k = F.col("p_retailprice").cast("string"), F.col("p_size") % 4
    lenient = F.when(k == 0, F.concat(F.lit("$"), price)).when(k == 1, F.concat(F.lit("-"), price)).when(k == 2, "TBD")
    token = F.when(k == 0, F.concat(price, F.lit("*"))).when(k == 1, F.concat(F.lit("-"), price)).when(k == 2, "-").otherwise("Continuing")
    return df.select("p_partkey", X.lenient_amount(lenient).alias("lenient"), X.amount_token(token).alias("token"))


@on_table("ma04_amount_lists", "part", "SELECT p_partkey, p_size + 0.5 + p_retailprice AS total, 3 AS n FROM part")
def _(df):
    found = T.amounts_in(F.concat(F.col("p_size").cast("string"), F.lit(".5* - TBD "), F.col("p_retailprice").cast("string")))
    return df.select("p_partkey", F.aggregate(found, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(found).alias("n"))


@on_table("ma05_numbers", "part", """SELECT p_partkey, abs(p_size - 25) AS apart, CASE WHEN p_size > 25 THEN NULL ELSE greatest(p_size, 10) END AS most, round(p_retailprice, 0) AS rounded
FROM part""")
def _(df):
    least = F.when(F.col("p_size") <= 25, F.lit(10))
    most = F.when(F.col("p_size").isNotNull() & least.isNotNull(), F.greatest("p_size", least))  # null if any is
    return df.select("p_partkey", F.abs(F.col("p_size") - 25).alias("apart"), most.alias("most"), F.round("p_retailprice", 0).alias("rounded"))


@on_table("ma06_validity", "part", """SELECT p_partkey, p_size % 6 IN (0, 1, 2) AS year, p_retailprice <= 1500 AS amount, length(p_name) BETWEEN 1 AND 200 AS name, p_brand IN ('Brand#1', 'Brand#2') AS exhibit
FROM part""")
def _(df):
    return df.select("p_partkey", T.is_year(_year_text()).alias("year"), T.is_amount(F.col("p_retailprice"), 1500).alias("amount"), T.is_text(F.col("p_name")).alias("name"), F.col("p_brand").isin("Brand#1", "Brand#2").alias("exhibit"))


@on_table("ma07_amount_texts", "orders", """SELECT o_orderkey, CASE WHEN v >= 1000000 THEN format('${:.2f}B', v / 1000000) WHEN v >= 1000 THEN format('${:.1f}M', v / 1000) ELSE format('${:.0f}K', v) END AS amount
FROM (SELECT o_orderkey, CAST(o_orderkey % 4 * 250 * (1 + o_orderkey % 3 * 999) AS DOUBLE) AS v FROM orders) WHERE v <> 0""")  # fmt: skip
def _(df):
    v = (F.col("o_orderkey") % 4 * 250 * (1 + F.col("o_orderkey") % 3 * 999)).cast("double")
    return df.where(v != 0).select("o_orderkey", T.amount_text(v).alias("amount"))


@on_table("js02_rewritten_lists", "part", "SELECT p_partkey, '1998,' || CAST(1990 + p_size AS VARCHAR) AS years, 0 AS bad FROM part")
def _(df):
    years = T.without_year_prefix(T.json_list(F.to_json(F.array(F.lit("FY 1998"), F.concat(F.lit("FY "), (1990 + F.col("p_size")).cast("string"))))))
    return df.select("p_partkey", F.array_join(years, ",").alias("years"), F.size(T.json_list(F.lit("{not a list"))).alias("bad"))


@on_table("js03_built_json", "part", """SELECT p_partkey, '{"name":"' || p_name || '","size":' || p_size || ',"tags":["' || p_brand || '","' || p_type || '"]}' AS json FROM part""")
def _(df):
    return df.select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.array("p_brand", "p_type").alias("tags"))).alias("json"))


@on_table("ar01_paired_lists", "part", """SELECT p_partkey, x.label, x.amount
FROM (SELECT p_partkey, unnest([{'label': '1998', 'amount': p_size::DOUBLE}, {'label': '1999', 'amount': p_retailprice}]) AS x FROM part)""")
def _(df):
    pairs = T.paired(F.array(F.lit("1998"), F.lit("1999"), F.lit("2000")), F.array(F.col("p_size").cast("double"), "p_retailprice"))
    return df.select("p_partkey", F.inline(pairs))


@on_facts("ar02_amount_columns", """ SELECT pe_number, fiscal_year, 'request' AS kind, CAST(sum(amount) AS DOUBLE) AS amount FROM facts WHERE fiscal_year IN ('2000', '2001')
GROUP BY 1, 2""", ["pe_number", "fiscal_year", "amount"])
def _(df):
    wide = df.groupBy("pe_number").pivot("fiscal_year", ["2000", "2001"]).agg(F.sum("amount").cast("double")).withColumnsRenamed({y: f"amount_fy{y}_request" for y in ("2000", "2001")})
    named = {c: T.amount_column(c) for c in wide.columns if T.amount_column(c)}
    long = wide.unpivot(["pe_number"], list(named), "column", "amount").where("amount IS NOT NULL")
    parts = {c: f"{y} {k}" for c, (y, k) in named.items()}
    both = F.split(T.looked_up(F.col("column"), parts), " ")
    return long.select("pe_number", both[0].alias("fiscal_year"), both[1].alias("kind"), "amount")


@on_tables("sc08_table_texts", "part", "SELECT p_partkey, p_name || ' | ' || p_type || chr(10) || p_brand AS text FROM part")
def _(df):
    return df.select("p_partkey", T.table_text(F.array(F.array("p_name", F.lit(""), "p_type"), F.array(F.lit("")), F.array(F.lit(""), "p_brand"))).alias("text"))
