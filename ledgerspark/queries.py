"""Budget queries over the fact view and the text tables, each with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions import expressions as X
from ledgerspark.operators import aggregates as A
from ledgerspark.operators import filters as L
from ledgerspark.operators import quality_checks as Q
from ledgerspark.operators import relations as R
from ledgerspark.operators import search as S
from ledgerspark.registry import LATEST, ORACLES, PREVIOUS, QUERIES, YEARS, on_facts, on_table, on_tables, ysum
from ledgerspark.streaming.incremental import windowed_counts

__all__ = ["ORACLES", "QUERIES"]


# filters, pages, sets

@on_facts("fi01_filtered_lines", """ SELECT order_key, line_item, fiscal_year, organization_name, exhibit_type, account, CAST(amount AS DOUBLE) AS amount FROM facts
WHERE fiscal_year IN ('2000', '2001') AND exhibit_type IN ('r1', 'r2') AND account IN ('Brand#1', 'Brand#2', 'Brand#3') AND amount >= 20000 AND amount <= 60000""")
def _(df):
    out = L.where_lines(df, least=20000, most=60000, fiscal_year=["2000", "2001"], exhibit_type=["r1", "r2"], account=["Brand#1", "Brand#2", "Brand#3"], organization_name=[])
    return out.select("order_key", "line_item", "fiscal_year", "organization_name", "exhibit_type", "account", A.money(F.col("amount")).alias("amount"))


@on_facts("fi03_without_summaries", " SELECT exhibit_type, fiscal_year, count(*) AS n FROM facts WHERE exhibit_type NOT IN ('c1','m1','o1','p1','p1r','r1','rf1') GROUP BY ALL")
def _(df):
    return L.without_summaries(df).groupBy("exhibit_type", "fiscal_year").agg(F.count("*").alias("n"))


@on_table("fi07_contains_any", "part", "SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%ring%' OR p_type ILIKE '%ring%' OR p_name ILIKE '%eco%' OR p_type ILIKE '%eco%'")
def _(df):
    return df.where(X.contains_any(["p_name", "p_type"], ["ring", "eco"])).select("p_partkey", "p_name", "p_type")


@on_facts("fi09_pe_format", " SELECT regexp_matches(pe_number, '^[0-9]{7}[A-Z]{1,2}$') AS valid, count(*) AS n FROM facts GROUP BY 1")
def _(df):
    return df.groupBy(F.rlike("pe_number", F.lit(f"^{X.PE_NUMBER}$")).alias("valid")).agg(F.count("*").alias("n"))


@on_table("so02_page_of_orders", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 100")
def _(df):
    return L.page(df.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 100, 25)


@on_facts("so04_top_programs", " SELECT pe_number, CAST(sum(amount) AS DOUBLE) AS total FROM facts GROUP BY 1 ORDER BY sum(amount) DESC, pe_number LIMIT 10")
def _(df):
    return A.top(df, "pe_number", 10)


@on_facts("se02_unpivoted_amounts", """ SELECT kind, count(*) AS n, CAST(min(value) AS DOUBLE) AS least, CAST(max(value) AS DOUBLE) AS most FROM (SELECT 'amount' AS kind, amount AS value
FROM facts UNION ALL SELECT 'quantity', quantity FROM facts) GROUP BY 1""")
def _(df):
    long = df.unpivot([], ["amount", "quantity"], "kind", "value")
    return long.groupBy("kind").agg(F.count("*").alias("n"), F.min("value").cast("double").alias("least"), F.max("value").cast("double").alias("most"))


@on_facts("se04_only_latest", f""" SELECT DISTINCT pe_number FROM facts WHERE fiscal_year = '{LATEST}' AND pe_number NOT IN (SELECT pe_number FROM facts
WHERE fiscal_year = '{PREVIOUS}')""")
def _(df):
    year = lambda y: df.where(F.col("fiscal_year") == y).select("pe_number")
    return year(LATEST).distinct().join(year(PREVIOUS), "pe_number", "left_anti")


# aggregates

for _dimension in ("organization_name", "fiscal_year", "appropriation_code", "exhibit_type", "budget_activity_title"):
    on_facts(f"ag01_totals_by_{_dimension}", f""", g AS (SELECT {_dimension} AS group_value, count(*) AS row_count, CAST({ysum(LATEST)} AS DOUBLE) AS latest, CAST({ysum(PREVIOUS)} AS DOUBLE) AS previous FROM facts GROUP BY 1)
    SELECT *, round(latest / (SELECT sum(latest) FROM g) * 100, 2) AS pct_of_total, CASE WHEN previous <> 0 THEN round((latest - previous) / abs(previous) * 100, 2) END AS yoy_change_pct FROM g""")(lambda df, c=_dimension: A.totals_by(df, c, LATEST, PREVIOUS))


@on_facts("ag03_hierarchy", f""", g AS (SELECT organization_name, appropriation_code, line_item_title, min(pe_number) AS pe_number, {ysum(LATEST)} AS l, {ysum(PREVIOUS)} AS p
FROM facts GROUP BY 1, 2, 3)
SELECT organization_name, appropriation_code, line_item_title, pe_number, CAST(l AS DOUBLE) AS latest, CAST(coalesce(p, 0) AS DOUBLE) AS previous, round(CAST(l AS DOUBLE) / (SELECT CAST(sum(l) AS DOUBLE)
FROM g WHERE l > 0) * 100, 4) AS pct_of_total FROM g WHERE l > 0""")
def _(df):
    return A.hierarchy(df, LATEST, PREVIOUS)


_CHOSEN = {"organization_name": ["ASIA", "EUROPE"], "fiscal_year": ["2000", "2001"], "exhibit_type": ["r1"], "appropriation_code": ["BUILDING", "MACHINERY", "HOUSEHOLD"]}


def _facet_sql() -> str:
    parts = []
    for c in _CHOSEN:
        others = " AND ".join(f"{o} IN ({', '.join(repr(v) for v in vs)})" for o, vs in _CHOSEN.items() if o != c)
        parts.append(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM facts WHERE {others} GROUP BY 2")
    return " " + " UNION ALL ".join(parts)


@on_facts("ag04_facets", _facet_sql())
def _(df):
    return A.facets(df, _CHOSEN)


@on_facts("ag05_dashboard", f"""
SELECT count(*) AS total_lines, CAST({ysum(LATEST)} AS DOUBLE) AS latest, CAST({ysum(PREVIOUS)} AS DOUBLE) AS previous, count(DISTINCT pe_number) AS n_pe, count(DISTINCT organization_name) AS n_org, count(DISTINCT source_file) AS n_files
FROM facts""")
def _(df):
    return A.dashboard(df, LATEST, PREVIOUS)


@on_facts("ag06_top_offices", " SELECT office, CAST(sum(amount) AS DOUBLE) AS total FROM facts GROUP BY 1 ORDER BY sum(amount) DESC, office LIMIT 6")
def _(df):
    return A.top(df, "office", 6)


@on_facts("ag12_conditional_counts", """
SELECT count(DISTINCT CASE WHEN exhibit_type = 'p1' THEN source_file END) AS p1_files, count(DISTINCT CASE WHEN exhibit_type <> 'p1' THEN source_file END) AS other_files, CAST(sum(CASE WHEN amount > 50000 THEN amount END) AS DOUBLE) AS large
FROM facts""")
def _(df):
    return df.agg(F.countDistinct(F.when(F.col("exhibit_type") == "p1", F.col("source_file"))).alias("p1_files"), F.countDistinct(F.when(F.col("exhibit_type") != "p1", F.col("source_file"))).alias("other_files"), A.money(F.sum(F.when(F.col("amount") > 50000, F.col("amount")))).alias("large"))


@on_facts("ag13_program_years", """ SELECT pe_number, fiscal_year, exhibit_type, organization_name, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(quantity) AS DOUBLE) AS quantity
FROM facts GROUP BY 1, 2, 3, 4""")
def _(df):
    return df.groupBy("pe_number", "fiscal_year", "exhibit_type", "organization_name").agg(A.money(F.sum("amount")).alias("amount"), A.money(F.sum("quantity")).alias("quantity"))


_CHANGES = f""", g AS (SELECT pe_number, coalesce({ysum(LATEST)}, 0) AS l, coalesce({ysum(PREVIOUS)}, 0) AS p FROM facts GROUP BY 1),
c AS (SELECT pe_number, CAST(l AS DOUBLE) AS latest, CAST(p AS DOUBLE) AS previous, CAST(l - p AS DOUBLE) AS delta, CASE WHEN p = 0 THEN 'new' WHEN l = 0 THEN 'terminated' WHEN l > p THEN 'increase' WHEN l < p THEN 'decrease' ELSE 'flat' END AS change_type FROM g WHERE l <> 0 OR p <> 0)"""


@on_facts("ag15_changes", _CHANGES + " SELECT * FROM c")
def _(df):
    return A.changes(df, ["pe_number"], LATEST, PREVIOUS)


@on_facts("ag16_top_increases", _CHANGES + " SELECT * FROM c WHERE delta >= 1000 ORDER BY delta DESC, pe_number LIMIT 20")
def _(df):
    return A.changes(df, ["pe_number"], LATEST, PREVIOUS).where("delta >= 1000").orderBy(F.desc("delta"), "pe_number").limit(20)


@on_tables("ag18_subtotals", "lines described", """ SELECT pe_number, line_item_title, exhibit_type, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n, grouping(exhibit_type) AS is_subtotal
FROM facts GROUP BY GROUPING SETS ((pe_number), (pe_number, line_item_title, exhibit_type))""")
def _(lines, described):
    dealt = R.dealt(lines.select("pe_number", "part_key", "exhibit_type", "amount"), "pe_number")  # else each file's lines make nearly as many groups as they are
    return A.with_subtotals(described(dealt, ["line_item_title"]))


@on_facts("ag21_reference_lists", """ SELECT 'service' AS list, organization_name AS value, count(*) AS n FROM facts GROUP BY 2 UNION ALL SELECT 'exhibit', exhibit_type, count(*)
FROM facts GROUP BY 2 UNION ALL SELECT 'appropriation', appropriation_code, count(*) FROM facts GROUP BY 2""")
def _(df):
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("list"), F.col(c).alias("value")) for k, c in (("service", "organization_name"), ("exhibit", "exhibit_type"), ("appropriation", "appropriation_code"))]))
    return df.select(each.alias("x")).groupBy("x.list", "x.value").agg(F.count("*").alias("n"))


_BEST = lambda y: "CAST(coalesce(" + ", ".join(f"max(CASE WHEN fiscal_year = '{y}' AND exhibit_type = '{k}' AND amount > 0 THEN amount END)" for k in ("r2", "p1", "r1")) + f", 0) AS DOUBLE) AS fy{y}"


@on_facts("ag23_best_by_year", " SELECT pe_number, " + ", ".join(map(_BEST, YEARS)) + " FROM facts GROUP BY 1")
def _(df):
    return A.best_by_year(df, "pe_number", YEARS, ["r2", "p1", "r1"])


@on_facts("ag26_main_organization", """, c AS (SELECT pe_number, organization_name, count(*) AS n FROM facts GROUP BY 1, 2) SELECT pe_number, organization_name, n FROM c
QUALIFY row_number() OVER (PARTITION BY pe_number ORDER BY n DESC, organization_name) = 1""")
def _(df):
    return A.most_frequent(df, "pe_number", "organization_name")


@on_facts("ag27_distinct_lists", """ SELECT pe_number, string_agg(DISTINCT fiscal_year, ',' ORDER BY fiscal_year) AS fiscal_year_list, string_agg(DISTINCT exhibit_type, ','
ORDER BY exhibit_type) AS exhibit_type_list FROM facts GROUP BY 1""")
def _(df):
    return A.distinct_lists(df, "pe_number", ["fiscal_year", "exhibit_type"])


@on_facts("ag33_pivot_years", " SELECT account, organization_name, " + ", ".join(f"CAST({ysum(y)} AS DOUBLE) AS fy{y}" for y in YEARS) + " FROM facts GROUP BY 1, 2")
def _(df):
    return A.pivot_years(df, ["account", "organization_name"], YEARS)


@on_table("ag35_word_matrix", "part", """WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS a FROM part) SELECT x.a AS a, y.a AS b, count(*) AS n
FROM w x JOIN w y USING (p_partkey) GROUP BY 1, 2""")
def _(df):
    return A.co_occurrence(df.select("p_partkey", F.split("p_name", " ").alias("w")), "p_partkey", "w")


@on_table("ag42_response_quantile", "events", "SELECT event_type, round(quantile_cont(value, 0.95) * 1.5, 4) AS timeout FROM events GROUP BY 1")
def _(df):
    return df.groupBy("event_type").agg(F.round(F.percentile("value", 0.95) * 1.5, 4).alias("timeout"))


# joins and windows

@on_table("jo06_turns_in_ranges", "conversations", """WITH r AS (SELECT conv_id, min(turn) + 1 AS s, max(turn) AS e FROM conversations GROUP BY 1) SELECT c.conv_id, turn, s, e
FROM conversations c JOIN r ON c.conv_id = r.conv_id AND turn BETWEEN s AND e""")
def _(df):
    r = df.groupBy("conv_id").agg((F.min("turn") + 1).alias("s"), F.max("turn").alias("e"))
    return R.in_ranges(df.select("conv_id", "turn"), r, "conv_id", "turn", "s", "e")


@on_facts("jo07_all_exhibits", " SELECT pe_number FROM facts WHERE fiscal_year = '2001' AND exhibit_type IN ('p1','r1','r2') GROUP BY 1 HAVING count(DISTINCT exhibit_type) = 3")
def _(df):
    return R.having_all(df.where("fiscal_year = '2001'"), "pe_number", "exhibit_type", ["p1", "r1", "r2"])


@on_facts("jo17_filled_programs", """, f AS (SELECT order_key, line_item, source_file, account, line_item_title, budget_activity_title, CASE WHEN quantity > 25 THEN pe_number END AS pe
FROM facts),
k AS (SELECT source_file, account, line_item_title, budget_activity_title, min(pe) AS a FROM f WHERE pe IS NOT NULL GROUP BY ALL
HAVING count(DISTINCT pe) = 1)
SELECT f.order_key, f.line_item, coalesce(f.pe, k.a) AS pe FROM f
LEFT JOIN k ON f.source_file = k.source_file AND f.account = k.account AND f.line_item_title = k.line_item_title AND f.budget_activity_title = k.budget_activity_title""")
def _(df):
    keys = ["source_file", "account", "line_item_title", "budget_activity_title"]
    gaps = df.select("order_key", "line_item", *keys, F.when(F.col("quantity") > 25, F.col("pe_number")).alias("pe"))
    return R.fill_from_unambiguous(gaps, keys, "pe").select("order_key", "line_item", "pe")


@on_facts("jo18_best_with_ties", """ SELECT office, fiscal_year, order_key, line_item, CAST(quantity AS DOUBLE) AS quantity FROM facts
QUALIFY rank() OVER (PARTITION BY office, fiscal_year ORDER BY quantity DESC) = 1""")
def _(df):
    out = R.best_with_ties(df.select("office", "fiscal_year", "order_key", "line_item", "quantity"), ["office", "fiscal_year"], F.desc("quantity"))
    return out.withColumn("quantity", A.money(F.col("quantity")))


@on_table("wi09_role_runs", "conversations", """WITH m AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS c
FROM conversations), r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT conv_id, CAST(run AS BIGINT) AS run, role, min(turn) AS first_place, max(turn) AS last_place, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def _(df):
    return R.runs(df.select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


@on_facts("wi03_one_row_a_line", """
SELECT fiscal_year, pe_number, line_item_title, organization_name, exhibit_type, amount_type, appropriation_code, source_file, order_key, line_item, CAST(amount AS DOUBLE) AS amount
FROM facts
QUALIFY row_number() OVER (PARTITION BY fiscal_year, pe_number, line_item_title, organization_name, exhibit_type, amount_type, appropriation_code
ORDER BY CASE WHEN source_file LIKE '%FY' || fiscal_year || '%' THEN 0 ELSE 1 END, source_file DESC, order_key, line_item, facts.amount) = 1""")
def _(df):
    return Q.one_row_a_line(df).select(*Q.LINE_KEY, "source_file", "order_key", "line_item", A.money(F.col("amount")).alias("amount"))


# quality, repair, consolidation

@on_facts("dq01_missing_years", """, t AS (SELECT DISTINCT pe_number, fiscal_year FROM facts) SELECT a.pe_number, b.fiscal_year FROM (SELECT DISTINCT pe_number
FROM t) a, (SELECT DISTINCT fiscal_year FROM t) b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.pe_number = a.pe_number AND t.fiscal_year = b.fiscal_year)""")
def _(df):
    return Q.missing_years(df, "pe_number")


@on_table("dq02_duplicate_keys", "lineitem", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(df):
    return Q.duplicate_keys(df, ["l_orderkey", "l_linenumber"])


@on_facts("dq11_jumps", """, y AS (SELECT pe_number, fiscal_year, CAST(sum(amount) AS DOUBLE) AS amount FROM facts
GROUP BY 1, 2), b AS (SELECT *, lag(amount) OVER (PARTITION BY pe_number ORDER BY fiscal_year) AS before FROM y)
SELECT * FROM b WHERE before > 0 AND (amount > 10 * before OR amount * 10 < before)""")
def _(df):
    return Q.jumps(df.groupBy("pe_number", "fiscal_year").agg(A.money(F.sum("amount")).alias("amount")), ["pe_number"], "amount", 10)


@on_facts("dq12_several_titles", " SELECT account, count(DISTINCT line_item_title) AS n_values FROM facts GROUP BY 1 HAVING count(DISTINCT line_item_title) > 8")
def _(df):
    return Q.several_values(df, "account", "line_item_title", 8)


@on_table("dq28_null_rates", "documents", """SELECT 'text' AS column_name, round(avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0 END), 4) AS null_rate FROM documents UNION ALL
SELECT 'lang', round(avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0 END), 4) FROM documents UNION ALL
SELECT 'source', round(avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0 END), 4) FROM documents""")
def _(df):
    return Q.null_rates(df, ["text", "lang", "source"])


@on_table("dq33_text_audit", "documents", r"""WITH d AS (SELECT source, coalesce(text, '') AS t FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (length(trim(t)) < 20) AS short, count(*) FILTER (2 * len(list_filter(string_split(t, chr(10)), lambda x: trim(x) = '')) > len(string_split(t, chr(10)))) AS blank,
count(*) FILTER (100 * (length(t) - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g'))) > 15 * length(t)) AS foreign FROM d GROUP BY 1""")
def _(df):
    return Q.text_audit(df)


@on_table("rp12_canonical_titles", "part", """WITH c AS (SELECT p_brand, p_name, count(*) AS n, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS plain FROM part GROUP BY 1, 2)
SELECT p_brand, plain, p_name AS canonical, n FROM c QUALIFY row_number() OVER (PARTITION BY p_brand, plain ORDER BY n DESC, p_name) = 1""")
def _(df):
    return Q.canonical_titles(df, "p_brand", "p_name")


@on_facts("rc02_exhibits_reconciled", """, a AS (SELECT pe_number, sum(amount) AS x FROM facts WHERE exhibit_type = 'p1' GROUP BY 1), b AS (SELECT pe_number, sum(amount) AS y FROM facts
WHERE exhibit_type = 'r1' GROUP BY 1)
SELECT pe_number, CAST(x AS DOUBLE) AS left_total, CAST(y AS DOUBLE) AS right_total, CASE WHEN x IS NULL THEN 'left missing' WHEN y IS NULL THEN 'right missing' WHEN abs(x - y) > 0.05 * abs(y) THEN 'mismatch' ELSE 'match' END AS state
FROM a FULL JOIN b USING (pe_number)""")
def _(df):
    return Q.reconcile(df.where("exhibit_type = 'p1'"), df.where("exhibit_type = 'r1'"), "pe_number", 0.05)


@on_facts("co01_line_items", """
SELECT exhibit_type, account, pe_number, min(fiscal_year) AS first_fy, max(fiscal_year) AS last_fy, count(*) AS n, max_by(line_item_title, fiscal_year || line_item_title) AS latest_title
FROM facts GROUP BY 1, 2, 3""")
def _(df):
    return Q.line_items(df)


# text and scalars

@on_table("ft07_substring_search", "documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under')")
def _(df):
    return df.where(X.contains_any(["text"], ["Licensed under"])).select("doc_id")


@on_table("ft09_suggest", "part", """SELECT field, value, priority
FROM (SELECT DISTINCT 'title' AS field, p_name AS value, CASE WHEN starts_with(lower(p_name), 's') THEN 0 ELSE 1 END AS priority FROM part
WHERE contains(lower(p_name), 's') UNION ALL SELECT DISTINCT 'activity', p_type, CASE WHEN starts_with(lower(p_type), 's') THEN 0 ELSE 1 END FROM part
WHERE contains(lower(p_type), 's')) ORDER BY priority, field, value LIMIT 20""")
def _(df):
    return S.suggest([("title", df, "p_name"), ("activity", df, "p_type")], "S", 20)


@on_table("ft13_snippets", "documents", """WITH d AS (SELECT doc_id, text, instr(lower(text), 'license') AS hit FROM documents), s AS (SELECT *, greatest(1, hit - 80) AS start FROM d
WHERE hit > 0)
SELECT doc_id, CASE WHEN start > 1 THEN '...' ELSE '' END || substring(text, start, 200) || CASE WHEN length(text) > start + 199 THEN '...' ELSE '' END AS snippet
FROM s""")
def _(df):
    return df.where(X.contains_any(["text"], ["license"])).select("doc_id", X.snippet(F.col("text"), "license").alias("snippet"))


@on_table("st01_normalized_space", "documents", r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM documents")
def _(df):
    return df.select("doc_id", F.md5(X.normalized_space(F.coalesce("text", F.lit("")))).alias("digest"))


@on_table("st14_fuzzy_words", "part", """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word, levenshtein(word, 'rung') AS edits FROM w
WHERE levenshtein(word, 'rung') <= CASE WHEN length(word) <= 4 THEN 1 WHEN length(word) <= 8 THEN 2 ELSE 3 END""")
def _(df):
    w = df.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return w.withColumn("edits", F.levenshtein("word", F.lit("rung"))).where(F.col("edits") <= X.edit_budget(F.col("word")))


@on_facts("dt03_years_of_paths", " SELECT DISTINCT source_file, regexp_extract(source_file, 'FY([0-9]{4})/', 1) AS fiscal_year FROM facts")
def _(df):
    return df.select("source_file").distinct().withColumn("fiscal_year", X.fiscal_year_of_path(F.col("source_file")))


@on_table("js01_json_fields", "events", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def _(df):
    return df.groupBy("event_type").agg(F.sum(F.from_json("props", "k long").getField("k")).alias("k"))


# extension: event time

@on_table("ext_windowed_events", "events", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(df):
    return windowed_counts(df)


# the rest of the catalog registers itself
from ledgerspark import catalog  # noqa: E402, F401
