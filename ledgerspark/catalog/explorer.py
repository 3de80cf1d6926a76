"""Keyword Explorer over the fact view; documents serve as narratives of the programs with their number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions import text as T
from ledgerspark.functions.expressions import words_of
from ledgerspark.operators import explorer as K
from ledgerspark.operators import summaries as S
from ledgerspark.operators.keyword_search import keyword_hits, word_runs
from ledgerspark.operators.near_text import same_titles
from ledgerspark.plans.stored import spread
from ledgerspark.registry import YEARS, on_facts, on_table, on_tables

_NARRATIVES = "n AS (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 7, '0') || 'A' AS pe_number, source, text FROM documents)"


def _narratives(docs):
    return docs.select("doc_id", F.concat(F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit("A")).alias("pe_number"), "source", "text")


#: Keywords as typed, by the part's number: fine ones, one too short, a bad sign, none, too many.
_TYPED = ["{name}, {upper} ,, {type}", "{name},x", "{name};,{type}", " , ,", ",".join(f"w{i}" for i in range(60))]


@on_table("kx01_keyword_set", "part", """SELECT p_partkey, [CAST(NULL AS VARCHAR), 'length', 'sign', 'count', 'count'][p_partkey % 5 + 1] AS problem, [2, 2, 2, 0, 60][p_partkey % 5 + 1] AS n,
CASE WHEN p_partkey % 5 = 0 THEN sha256(CASE WHEN p_name < lower(p_type) THEN p_name || ',' || lower(p_type) ELSE lower(p_type) || ',' || p_name END) END AS id FROM part""")
def _(df):
    typed = F.element_at(F.array(*map(F.lit, _TYPED)), (F.col("p_partkey") % 5 + 1).cast("int"))
    for name, value in {"{name}": F.col("p_name"), "{upper}": F.upper("p_name"), "{type}": F.col("p_type")}.items():
        typed = F.replace(typed, F.lit(name), value)
    checked = spread(df).select("p_partkey", K.checked_keywords(F.split(typed, ",")).alias("c"))
    return checked.select("p_partkey", "c.problem", F.size("c.words").alias("n"), F.when(F.col("c.problem").isNull(), T.set_key(F.col("c.words"))).alias("id"))


@on_tables("kx03_discovered_programs", "facts documents", f""", {_NARRATIVES}, b AS (SELECT DISTINCT pe_number FROM facts
WHERE pe_number = '0000004A' OR contains(lower(line_item_title), 'small') OR contains(lower(account), 'small') OR contains(lower(line_item_title), '0000004a') OR contains(lower(account), '0000004a'))
SELECT pe_number, 'line' AS found_in FROM b UNION ALL SELECT DISTINCT pe_number, 'narrative' FROM n
WHERE contains(lower(text), 'license') AND pe_number NOT IN (SELECT pe_number FROM b)""")  # fmt: skip
def _(df, docs):
    return K.discovered(df, _narratives(docs), ["small", "0000004a"], ["line_item_title", "account"], ["License"])


@on_facts("kx04_forced_programs", " SELECT DISTINCT pe_number FROM facts WHERE pe_number IN ('0000004A', '0000009A', '9999999Z')", ["pe_number"])
def _(df):
    return K.forced(df, ["0000004A", "0000009A", "9999999Z"])


def _year_sql(y: str) -> str:
    best = lambda c: ", ".join(f"max(CASE WHEN fiscal_year = '{y}' AND exhibit_type = '{k}' AND amount > 0 THEN {c} END)" for k in ("r2", "p1"))
    return f"CAST(coalesce({best('amount')}, 0) AS DOUBLE) AS fy{y}, coalesce({best('source_file')}) AS fy{y}_ref"


@on_facts("kx05_years_of_lines", f""" SELECT pe_number, line_item_title, {', '.join(_year_sql(y) for y in YEARS[:2])} FROM facts WHERE CAST(fiscal_year AS INTEGER) >= {YEARS[0]}
GROUP BY 1, 2""", ["pe_number", "line_item_title", "fiscal_year", "exhibit_type", "amount", "source_file"])
def _(df):
    return K.by_year(df, ["pe_number", "line_item_title"], YEARS[:2], ["r2", "p1"])


def _pages(parts):
    key = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")  # a code has six digits
    heads = ["COST ($ in Millions) FY 1998 FY 1999 FY 2000", "COST ($ in Millions)\nFY 1998 FY 1999 FY 2000\nComplete", "Cost ($ in millions) FY98 FY99 FY00\n\nYears follow", "1998 1999 2000\nCOST ($ in Millions)"]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("p_size") % 4 + 1).cast("int"))  # years on its line, the next, of two digits, before it
    price = F.format_number("p_retailprice", 2)
    text = F.concat(F.lit("Exhibit R-2 PE 0602123A: x\n"), head, F.lit("\nTotal PE 1.0 2.0 3.0\n16"), key, F.lit(": "), "p_name", F.lit(" "), price, F.lit(" - 2.5*\nDD7 "), "p_type", F.lit(" TBD 4.0\n\nA. Mission\nzz 1 2 3"))
    return spread(parts).select("p_partkey", text.alias("text"))


_COSTS = """SELECT p_partkey, '16' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS code, p_name AS title, contains(' ' || p_name || ' ', ' ring ') AS matched, y AS year, CASE y WHEN '1998' THEN p_retailprice * 1000 WHEN '2000' THEN 2500.0 END AS amount FROM part, (SELECT unnest(['1998', '1999', '2000']) AS y)
UNION ALL SELECT p_partkey, 'DD7', p_type, false, y, CASE y WHEN '1999' THEN 4000.0 END FROM part, (SELECT unnest(['1998', '1999']) AS y)"""


@on_table("kx06_mined_rows", "part", _COSTS)
def _(df):
    return K.mined(_pages(df), "text", ["ring"])


@on_table("kx07_cost_tables", "part", """SELECT p_partkey, '16' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || ': ' || p_name AS label, 3 AS n FROM part UNION ALL
SELECT p_partkey, 'DD7 ' || p_type, 2 FROM part""")
def _(df):
    pages = _pages(df)
    return pages.select("p_partkey", F.explode(K.cost_table(F.col("text"))).alias("r")).select("p_partkey", "r.label", F.size("r.amounts").alias("n"))


@on_table("kx08_project_descriptions", "part", "SELECT p_partkey, 'A. Mission' AS header, 'the ' || p_name || ' of ' || p_brand || ' for ever' AS text FROM part")
def _(df):
    page = F.concat(F.lit("PE 1\nA. Mission\nthe "), "p_name", F.lit(" of "), "p_brand", F.lit(" for ever\nB. Accomplishments\ntoo short"))
    return df.select("p_partkey", F.inline(T.sections(page, [r"A\. Mission", r"B\. Accomplishments"])))


_MINED = ["pe_number", "line_item_title", "fiscal_year", "source_file", "amount", "quantity"]


@on_facts("kx09_consolidated_series", """, s AS (SELECT pe_number, line_item_title, fiscal_year, source_file, max(CASE WHEN quantity > 25 THEN amount END) AS a FROM facts GROUP BY 1, 2, 3, 4)
SELECT pe_number, line_item_title, CAST(a AS DOUBLE) AS amount, source_file FROM s WHERE a IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY pe_number, line_item_title ORDER BY fiscal_year DESC, source_file DESC) = 1""", _MINED)  # fmt: skip
def _(df):
    submissions = df.groupBy(*_MINED[:4]).agg(F.max(F.when(F.col("quantity") > 25, F.col("amount"))).alias("amount"))
    return S.first_filled(submissions, ["pe_number", "line_item_title"], "fiscal_year", "amount", "source_file").withColumn("amount", S.money(F.col("amount")))


#: Titles around a base that differs by type: kinds 0 and 4 are the base, 1 begins with it, 2 has two other letters,
#: 3 eight (too many), 5 its halves in another order. Which cluster kind 2 comes to depends on what came before it.
_TITLES = """t AS (SELECT substring(p_brand, -1) AS pe, md5(p_type) AS base, p_partkey, p_partkey * 7 % 11 % 6 AS kind FROM part),
r AS (SELECT pe, base, p_partkey, kind, CASE kind WHEN 0 THEN base WHEN 1 THEN base || ' of the second series' WHEN 2 THEN substring(base, 1, 30) || 'zz' WHEN 3 THEN substring(base, 1, 24) || 'yyyyyyyy'
WHEN 4 THEN upper(base) ELSE substring(base, 17) || substring(base, 1, 16) END AS title FROM t)"""


@on_table("kx10_same_titles", "part", f"""WITH {_TITLES}, f AS (SELECT *, min(CASE WHEN kind IN (0, 4) THEN p_partkey END) OVER w AS a, min(CASE WHEN kind = 1 THEN p_partkey END) OVER w AS b, min(CASE WHEN kind = 2 THEN p_partkey END) OVER w AS c
FROM r WINDOW w AS (PARTITION BY pe, base)), g AS (SELECT *, c < coalesce(a, c + 1) AND c < coalesce(b, c + 1) AS turned FROM f),
m AS (SELECT *, CASE WHEN kind IN (3, 5) THEN kind WHEN turned THEN CASE WHEN kind = 1 THEN 1 ELSE 0 END WHEN kind = 2 AND p_partkey > b THEN 2 ELSE 0 END AS of FROM g)
SELECT p_partkey, pe, title, first(title) OVER (PARTITION BY pe, base, of ORDER BY length(title) DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cluster FROM m""")  # fmt: skip
def _(df):
    base, kind = F.md5("p_type"), F.col("p_partkey") * 7 % 11 % 6
    other = {1: F.concat(base, F.lit(" of the second series")), 2: F.concat(F.substring(base, 1, 30), F.lit("zz")), 3: F.concat(F.substring(base, 1, 24), F.lit("y" * 8)), 4: F.upper(base), 5: F.concat(F.substring(base, 17, 16), F.substring(base, 1, 16))}
    title = base
    for k, v in other.items():
        title = F.when(kind == k, v).otherwise(title)
    return same_titles(df.select("p_partkey", F.substring("p_brand", -1, 1).alias("pe"), title.alias("title")), ["pe"], "title", ["p_partkey"])


@on_facts("kx11_inherited_labels", """, p AS (SELECT pe_number, max(CASE WHEN budget_activity_title <> 'Unknown' THEN budget_activity_title END) AS b FROM facts WHERE exhibit_type = 'r1'
GROUP BY 1)
SELECT DISTINCT f.pe_number, f.line_item, coalesce(CASE WHEN line_item = '1' THEN budget_activity_title END, p.b, 'Unknown') AS budget_activity_title
FROM facts f LEFT JOIN p ON p.pe_number = f.pe_number WHERE exhibit_type = 'r2'""", ["pe_number", "line_item", "budget_activity_title", "exhibit_type"])  # fmt: skip
def _(df):
    rows = df.where("exhibit_type = 'r2'").select("pe_number", "line_item", F.when(F.col("line_item") == "1", F.col("budget_activity_title")).otherwise("Unknown").alias("budget_activity_title"))
    return K.inherited(rows, df.where("exhibit_type = 'r1'"), "pe_number", ["budget_activity_title"]).distinct()


_WORDS = "array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])license([^a-z0-9_]|$)') THEN 'license' END, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])error([^a-z0-9_]|$)') THEN 'error' END], lambda x: x IS NOT NULL), ',')"


@on_table("kx12_first_narratives", "documents", f"""WITH h AS (SELECT source, doc_id, {_WORDS} AS words FROM documents) SELECT source, words FROM h
WHERE words <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1""")
def _(df):
    return K.narrative_keywords(df, "source", "text", "doc_id", ["license", "error"]).select("source", F.array_join("words", ",").alias("words"))


@on_tables("kx12_keywords_at_once", "documents benchmark part", r"""WITH b AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark), c AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM b),
k AS (SELECT DISTINCT w[i] AS word FROM c UNION SELECT w[i] || ' ' || w[i + 1] FROM c WHERE i < len(w) UNION SELECT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM c WHERE i + 1 < len(w) UNION SELECT p_name FROM part),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents), e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
r AS (SELECT doc_id, w[i] AS word FROM e UNION SELECT doc_id, w[i] || ' ' || w[i + 1] FROM e WHERE i < len(w) UNION SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM e WHERE i + 1 < len(w))
SELECT word, count(*) AS n_documents, min(doc_id) AS first_document FROM k JOIN r USING (word) GROUP BY 1""")  # fmt: skip
def _(docs, benchmark, parts):
    """Some thousands of keywords: the words, pairs and triples of the benchmark's texts and the parts' names."""
    words = words_of(F.col("text"))
    runs = benchmark.select(F.explode(F.concat(*[word_runs(words, n) for n in (1, 2, 3)])).alias("word"))
    found = keyword_hits(docs, "doc_id", "text", runs.unionByName(parts.select(F.col("p_name").alias("word"))).distinct(), "word")
    return found.groupBy("word").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_document"))


@on_facts("kx13_longest_titles", """, g AS (SELECT account, line_item_title, max(CASE WHEN fiscal_year = '2000' AND quantity > 40 THEN amount END) AS fy2000, max(CASE WHEN fiscal_year = '2001' AND quantity > 49 THEN amount END) AS fy2001
FROM facts GROUP BY 1, 2)
SELECT account, first(line_item_title ORDER BY length(line_item_title) DESC, line_item_title) AS line_item_title, CAST(first(fy2000
ORDER BY line_item_title) FILTER (fy2000 IS NOT NULL) AS DOUBLE) AS fy2000, CAST(first(fy2001
ORDER BY line_item_title) FILTER (fy2001 IS NOT NULL) AS DOUBLE) AS fy2001 FROM g GROUP BY 1""", ["account", "line_item_title", "fiscal_year", "quantity", "amount"])  # fmt: skip
def _(df):
    year = lambda y, q: S.money(F.max(F.when((F.col("fiscal_year") == y) & (F.col("quantity") > q), F.col("amount")))).alias(f"fy{y}")
    rows = df.groupBy("account", "line_item_title").agg(year("2000", 40), year("2001", 49))
    return K.longest_title(rows, "account", "line_item_title", ["fy2000", "fy2001"])


@on_tables("kx14_with_stubs", "facts documents", f""", {_NARRATIVES}, r AS (SELECT pe_number, max(line_item_title) AS title, count(*) AS n FROM facts WHERE fiscal_year = '2001' AND exhibit_type = 'r1'
GROUP BY 1)
SELECT * FROM r UNION ALL SELECT DISTINCT pe_number, coalesce(CASE WHEN source = 'src1' THEN source END, pe_number), NULL FROM n
WHERE pe_number NOT IN (SELECT pe_number FROM r)""")  # fmt: skip
def _(df, docs):
    rows = df.where("fiscal_year = '2001' AND exhibit_type = 'r1'").groupBy("pe_number").agg(F.max("line_item_title").alias("title"), F.count("*").alias("n"))
    n = _narratives(docs)
    return K.with_stubs(rows, n.select("pe_number").distinct(), "pe_number", n.where("source = 'src1'").select("pe_number", F.col("source").alias("title")).distinct())


@on_table("kx15_lineage_notes", "part", """WITH t AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 7, '0') || 'A' AS pe, lower(p_name || ' ' || p_size || ' ' || p_brand) AS n FROM part), g AS (SELECT a.pe, string_agg(DISTINCT b.pe, ', ' ORDER BY b.pe) AS o FROM t a JOIN t b ON a.n = b.n AND a.pe <> b.pe
GROUP BY 1)
SELECT pe, 'Also in PE ' || o AS note FROM g""")  # fmt: skip
def _(df):
    rows = df.select(F.concat(F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("A")).alias("pe"), F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit("), "), "p_brand").alias("title"))
    return K.lineage_notes(rows, "pe", "title")


_CODED = "CASE WHEN fy{0} IS NULL THEN '' WHEN NOT (m OR {1}) THEN 'N' WHEN s AND d THEN 'P' ELSE 'Y' END"


@on_facts("kx16_match_codes", f""", w AS (SELECT pe_number, exhibit_type, contains(max(line_item_title), 'ring') AS m, exhibit_type = 'r1' AS s, max(account) = 'Brand#7' AS d, sum(CASE WHEN fiscal_year = '2000' THEN amount END) AS fy2000, sum(CASE WHEN fiscal_year = '2001' THEN amount END) AS fy2001
FROM facts GROUP BY 1, 2),
c AS (SELECT pe_number, exhibit_type, {_CODED.format(2000, "s")} AS a, {_CODED.format(2001, "false")} AS b FROM w)
SELECT pe_number, exhibit_type, CASE WHEN (a = 'Y' OR b = 'Y') AND a = 'N' THEN 'P' ELSE a END || ',' || CASE WHEN (a = 'Y' OR b = 'Y') AND b = 'N' THEN 'P' ELSE b END AS codes
FROM c""", ["pe_number", "exhibit_type", "line_item_title", "account", "fiscal_year", "amount"])  # fmt: skip
def _(df):
    wide = df.groupBy("pe_number", "exhibit_type").agg(F.max("line_item_title").alias("t"), F.max("account").alias("a"), S.money(S.of_year("2000")).alias("fy2000"), S.money(S.of_year("2001")).alias("fy2001"))
    summary = F.col("exhibit_type") == "r1"
    codes = K.match_codes(F.array("fy2000", "fy2001"), F.array(F.lit("f"), F.lit("f")), F.contains("t", F.lit("ring")), F.array(summary, F.lit(False)), summary, F.col("a") == "Brand#7")
    return wide.select("pe_number", "exhibit_type", F.array_join(codes, ",").alias("codes"))


@on_tables("kx17_included_rows", "facts documents", f""", {_NARRATIVES} SELECT DISTINCT pe_number FROM facts WHERE contains(line_item_title, 'ring') OR pe_number IN (SELECT pe_number FROM n
WHERE contains(lower(text), 'license')) OR pe_number IN ('0000002A')""")
def _(df, docs):
    hits = _narratives(docs).where(F.contains(F.lower("text"), F.lit("license")))
    return K.included(df.select("pe_number", "line_item_title"), "pe_number", F.contains("line_item_title", F.lit("ring")), hits, ["0000002A"]).select("pe_number").distinct()


@on_facts("kx18_totals", """ SELECT exhibit_type, fiscal_year, CAST(sum(amount) AS DOUBLE) AS total, grouping(exhibit_type) AS is_total FROM facts
WHERE contains(line_item_title, 'ring') AND fiscal_year IN ('2000', '2001') GROUP BY GROUPING SETS ((exhibit_type, fiscal_year), (fiscal_year))""", ["exhibit_type", "fiscal_year", "amount", "line_item_title"])
def _(df):
    rows = df.where(F.contains("line_item_title", F.lit("ring")) & F.col("fiscal_year").isin("2000", "2001"))
    both = rows.groupingSets([["exhibit_type", "fiscal_year"], ["fiscal_year"]], "exhibit_type", "fiscal_year")
    return both.agg(S.money(F.sum("amount")).alias("total"), F.grouping("exhibit_type").cast("long").alias("is_total"))


@on_table("kx19_described", "documents", """SELECT doc_id, source FROM documents WHERE lang = 'en' AND length(trim(text)) >= 80 AND NOT contains(substring(trim(text), 1, 300), 'Exhibit R-1')
ORDER BY CASE source WHEN 'src2' THEN 1 WHEN 'src1' THEN 2 ELSE 99 END, length(text) DESC, text LIMIT 1""")
def _(df):
    return K.described(df, "lang", "en", ["src2", "src1"], "source", "text").select("doc_id", "source")


@on_facts("kx20_preset", " SELECT DISTINCT pe_number FROM facts WHERE contains(line_item_title, 'ring') OR contains(line_item_title, 'small') OR pe_number = '0000007A'", ["pe_number", "line_item_title"])
def _(df):
    words, programs = K.PRESETS["rings"]
    return df.where(F.col("pe_number").isin(programs) | K.contains_any(["line_item_title"], words)).select("pe_number").distinct()
