"""Data quality, repair, header mapping, full-text search and file operators with SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from ledgerspark.functions import text as T
from ledgerspark.functions.expressions import contains_any, fiscal_year_of_path, pe_numbers
from ledgerspark.operators import headers as H
from ledgerspark.operators import quality_checks as Q
from ledgerspark.operators import relations as R
from ledgerspark.operators import repair as P
from ledgerspark.operators import substring_index as N
from ledgerspark.operators import summaries as S
from ledgerspark.operators import text_index as I
from ledgerspark.operators.searches import query_terms
from ledgerspark.plans.facts import read
from ledgerspark.plans.stored import shared_folder, spread
from ledgerspark.registry import ORACLES, QUERIES, YEARS, on_facts, on_table, on_tables
from ledgerspark.sources import files
from ledgerspark.streaming import store

# checks


@on_table("dq02_duplicate_rows", "part", "SELECT p_name, p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def _(df):
    return Q.duplicate_keys(df, [c for c in df.columns if c not in ("p_partkey", "p_retailprice")])


@on_facts("dq03_all_zero", """, w AS (SELECT pe_number, sum(CASE WHEN fiscal_year = '2000' THEN amount END) AS a, sum(CASE WHEN fiscal_year = '2001' THEN amount END) AS b
FROM facts WHERE quantity > 48 GROUP BY 1)
SELECT pe_number FROM w WHERE coalesce(a, 0) = 0 AND coalesce(b, 0) = 0""", ["pe_number", "fiscal_year", "amount", "quantity"])  # fmt: skip
def _(df):
    wide = df.where("quantity > 48").groupBy("pe_number").agg(S.of_year("2000").alias("a"), S.of_year("2001").alias("b"))
    return Q.all_zero(wide, ["a", "b"]).select("pe_number")


@on_facts("dq04_account_without_organization", " SELECT account, count(*) AS n FROM facts WHERE nullif(organization_name, 'ASIA') IS NULL GROUP BY 1", ["account", "organization_name"])
def _(df):
    org = F.nullif("organization_name", F.lit("ASIA"))
    return df.where(F.col("account").isNotNull() & org.isNull()).groupBy("account").agg(F.count("*").alias("n"))


@on_facts("dq05_unknown_exhibits", " SELECT exhibit_type, count(*) AS n FROM facts WHERE exhibit_type NOT IN ('p1', 'r1') GROUP BY 1", ["exhibit_type"])
def _(df):
    known = df.sparkSession.createDataFrame([("p1",), ("r1",)], "exhibit_type string")
    return df.join(F.broadcast(known), "exhibit_type", "left_anti").groupBy("exhibit_type").agg(F.count("*").alias("n"))


@on_table("dq06_error_events", "events", "SELECT user_id, count(*) AS n, CAST(max(ts) AS VARCHAR) IS NOT NULL AS dated FROM events WHERE event_type = 'error' GROUP BY 1")
def _(df):
    return df.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").isNotNull().alias("dated"))


@on_table("dq07_other_units", "part", "SELECT CASE WHEN p_size % 5 = 0 THEN 'millions' ELSE 'thousands' END AS unit, count(*) AS n FROM part WHERE p_size % 5 = 0 GROUP BY 1")
def _(df):
    unit = F.when(F.col("p_size") % 5 == 0, "millions").otherwise("thousands")
    return df.select(unit.alias("unit")).where("unit <> 'thousands'").groupBy("unit").agg(F.count("*").alias("n"))


@on_table("dq08_empty_files", "documents", "SELECT source, count(*) AS n_empty FROM documents WHERE coalesce(n_chars, 0) = 0 OR trim(coalesce(text, '')) = '' GROUP BY 1")
def _(df):
    return df.where((F.coalesce("n_chars", F.lit(0)) == 0) | (F.trim(F.coalesce("text", F.lit(""))) == "")).groupBy("source").agg(F.count("*").alias("n_empty"))


@on_table("dq09_malformed_programs", "part", "SELECT p_partkey FROM part WHERE p_size % 3 = 2")
def _(df):
    k = F.col("p_size") % 3
    pe = F.when(k == 0, "0603183D8Z").when(k == 1, "0602702E").otherwise("602702E")
    return df.where(~T.is_program(pe)).select("p_partkey")


@on_tables("dq10_negative_amounts", "customer", """SELECT column_name, count(*) AS n FROM (SELECT 'c_acctbal' AS column_name, c_acctbal AS v FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey
FROM customer) WHERE v < 100 GROUP BY 1""")
def _(df):
    return Q.cells(df.withColumn("c_nationkey", F.col("c_nationkey").cast("double")), [], ["c_acctbal", "c_nationkey"]).where("value < 100").groupBy("column_name").agg(F.count("*").alias("n"))


@on_facts("dq13_rollups", """, t AS (SELECT account, fiscal_year, sum(amount) AS x FROM facts WHERE exhibit_type = 'p1'
GROUP BY 1, 2), d AS (SELECT account, fiscal_year, sum(amount) AS y FROM facts WHERE exhibit_type <> 'p1' GROUP BY 1, 2)
SELECT account, fiscal_year, CAST(x AS DOUBLE) AS total, CAST(y AS DOUBLE) AS detail FROM t JOIN d USING (account, fiscal_year)
WHERE abs(x - y) > 100000""", ["account", "fiscal_year", "amount", "exhibit_type"])  # fmt: skip
def _(df):
    return Q.rollup_mismatches(df, ["account", "fiscal_year"], F.col("exhibit_type") == "p1", 100000)


@on_tables("dq14_unknown_organizations", "customer nation", """SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment NOT IN (SELECT n_name
FROM nation) AND c_mktsegment NOT IN (SELECT CASE WHEN n_nationkey = 1 THEN 'BUILDING' ELSE n_name END FROM nation) GROUP BY 1""")
def _(customers, nation):
    names = nation.select(F.col("n_name").alias("code"), F.when(F.col("n_nationkey") == 1, "BUILDING").otherwise(F.col("n_name")).alias("full_name"))
    return Q.unknown_values(customers, "c_mktsegment", names, ["code", "full_name"])


@on_facts("dq15_expected_years", " SELECT y AS missing FROM (SELECT unnest(['1980', '1998', '2001']) AS y) WHERE y NOT IN (SELECT fiscal_year FROM facts)", ["fiscal_year"])
def _(df):
    expected = df.sparkSession.createDataFrame([("1980",), ("1998",), ("2001",)], "missing string")
    return R.anti(F.broadcast(expected), df.select("fiscal_year").distinct(), "missing", "fiscal_year")


@on_table("dq16_extraction_scores", "documents", r"""SELECT source, count(*) AS n, count(*) FILTER (length(trim(coalesce(text, ''))) < 20) AS short, count(*) FILTER (contains(text, '�')) AS broken,
round(100 - 100.0 * (count(*) FILTER (length(trim(coalesce(text, ''))) < 20) + count(*) FILTER (contains(text, '�'))) / count(*), 1) AS score
FROM documents GROUP BY 1""")  # fmt: skip
def _(df):
    short, broken = F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) < 20), F.count_if(F.contains("text", F.lit("�")))
    return df.groupBy("source").agg(F.count("*").alias("n"), short.alias("short"), broken.alias("broken"), F.round(100 - 100.0 * (short + broken) / F.count("*"), 1).alias("score"))


@on_tables("dq17_index_in_step", "documents", "SELECT count(*) AS n_documents, count(*) AS n_indexed, true AS in_step FROM documents")
def _(df):
    spark = df.sparkSession
    folder = I.stored_index(df, "dq17", "doc_id", ["text"])
    indexed = I.live_keys(spark, folder).agg(F.count("*").alias("n_indexed"))
    return df.agg(F.count("*").alias("n_documents")).join(indexed).withColumn("in_step", F.col("n_documents") == F.col("n_indexed"))


@on_table("dq18_budget_type_domain", "customer", "SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def _(df):
    domain = df.sparkSession.createDataFrame([("BUILDING",), ("MACHINERY",)], "value string")
    return Q.unknown_values(df.withColumnRenamed("c_mktsegment", "value"), "value", domain, ["value"])


@on_table("dq19_missing_years_rate", "documents", """SELECT round(avg(CASE WHEN doc_id % 17 = 0 THEN 1.0 ELSE 0 END), 4) AS rate, avg(CASE WHEN doc_id % 17 = 0 THEN 1.0 ELSE 0 END) > 0.05 AS too_high
FROM documents""")
def _(df):
    return Q.null_rate(df.select(F.when(F.col("doc_id") % 17 != 0, F.lit("2001")).alias("fiscal_year")), "fiscal_year", 0.05)


@on_tables("dq20_junction_populated", "documents labels", "SELECT count(*) AS n_pages, (SELECT count(DISTINCT doc_id) FROM labels) AS n_linked, (SELECT count(*) FROM labels) > 0 AS populated FROM documents")
def _(docs, labels):
    links = labels.agg(F.countDistinct("doc_id").alias("n_linked"), (F.count("*") > 0).alias("populated"))
    return docs.agg(F.count("*").alias("n_pages")).join(links)


@on_table("dq21_provenance_rate", "labels", """SELECT round(avg(CASE WHEN toxic IS NULL THEN 1.0 ELSE 0 END), 4) AS rate, avg(CASE WHEN toxic IS NULL THEN 1.0 ELSE 0 END) > 0.5 AS too_high
FROM labels""")
def _(df):
    return Q.null_rate(df, "toxic", 0.5)


@on_facts("dq22_many_activities", """ SELECT account, exhibit_type, count(DISTINCT budget_activity_title) AS n_values FROM facts GROUP BY 1, 2
HAVING count(DISTINCT budget_activity_title) > 4""", ["account", "exhibit_type", "budget_activity_title"])
def _(df):
    return df.groupBy("account", "exhibit_type").agg(F.countDistinct("budget_activity_title").alias("n_values")).where("n_values > 4")


@on_facts("dq23_extreme_outliers", """ SELECT kind AS column_name, count(*) AS n, CAST(max(v) AS DOUBLE) AS most FROM (SELECT 'amount' AS kind, amount AS v FROM facts UNION ALL
SELECT 'quantity', quantity FROM facts) WHERE abs(v) > 90000 GROUP BY 1""", ["amount", "quantity"])
def _(df):
    return Q.cells(df, [], ["amount", "quantity"]).where("abs(value) > 90000").groupBy("column_name").agg(F.count("*").alias("n"), S.money(F.max("value")).alias("most"))


@on_facts("dq24_programs_of_many", " SELECT pe_number, count(DISTINCT organization_name) AS n_values FROM facts GROUP BY 1 HAVING count(DISTINCT organization_name) > 1", ["pe_number", "organization_name"])
def _(df):
    return Q.several_values(df, "pe_number", "organization_name")


@on_tables("dq25_orphans", "documents labels conversations", """SELECT 'labels' AS edge, count(DISTINCT doc_id) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL
SELECT 'conversations', count(DISTINCT conv_id) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)""")
def _(docs, labels, turns):
    edges = [("labels", labels, "doc_id", docs, "doc_id"), ("conversations", turns, "conv_id", labels, "doc_id")]
    return Q.orphans(edges)


@on_facts("dq26_unfilled_programs", """, k AS (SELECT DISTINCT account, line_item FROM facts WHERE quantity > 49) SELECT account, line_item, count(*) AS n FROM facts
WHERE exhibit_type = 'p1' AND quantity > 45 AND NOT EXISTS (SELECT 1 FROM k WHERE k.account = facts.account AND k.line_item = facts.line_item)
GROUP BY 1, 2""", ["account", "line_item", "quantity", "exhibit_type"])
def _(df):
    known = df.where("quantity > 49").select("account", "line_item").distinct()
    return df.where("exhibit_type = 'p1' AND quantity > 45").join(known, ["account", "line_item"], "left_anti").groupBy("account", "line_item").agg(F.count("*").alias("n"))


@on_tables("dq27_staleness", "part lineitem", """SELECT count(*) AS n_programs, count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem
WHERE l_quantity > 30)) AS n_stale, 100.0 * count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem
WHERE l_quantity > 30)) > 5 * count(*) AS stale FROM part""")
def _(parts, lines):
    fresh = lines.where("l_quantity > 30").select(F.col("l_partkey").alias("k")).distinct()
    both = parts.join(fresh, F.col("p_partkey") == F.col("k"), "left")
    return both.agg(F.count("*").alias("n_programs"), F.count_if(F.col("k").isNull()).alias("n_stale"), (F.count_if(F.col("k").isNull()) * 100 > F.count("*") * 5).alias("stale"))


@on_tables("dq30_untracked_files", "facts nation", " SELECT DISTINCT source_file FROM facts WHERE regexp_extract(source_file, '/(.*)\\.xlsx', 1) NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 20)")
def _(df, nation):
    files = df.select("source_file").distinct().withColumn("n", F.regexp_extract("source_file", r"/(.*)\.xlsx", 1))
    return R.anti(files, nation.where("n_nationkey < 20"), "n", "n_name").select("source_file")


@on_facts("dq32_year_coverage", """, o AS (SELECT count(DISTINCT organization_name) AS m FROM facts)
SELECT fiscal_year, count(DISTINCT organization_name) AS n, count(DISTINCT organization_name) * 4 < max(m) AS thin FROM facts, o
WHERE quantity > 49 OR fiscal_year < '1999' GROUP BY 1""", ["fiscal_year", "organization_name", "quantity"])
def _(df):
    whole = df.agg(F.countDistinct("organization_name").alias("m"))
    counts = df.where("quantity > 49 OR fiscal_year < '1999'").groupBy("fiscal_year").agg(F.countDistinct("organization_name").alias("n"))
    return counts.join(F.broadcast(whole)).select("fiscal_year", "n", (F.col("n") * 4 < F.col("m")).alias("thin"))


_VALIDATED = "fiscal_year organization_name source_file exhibit_type pe_number line_item amount_type amount".split()


@on_facts("dq32_validations", f""", v AS (SELECT fiscal_year, CASE WHEN fiscal_year = '1998' AND organization_name <> 'ASIA' THEN NULL ELSE organization_name END AS organization_name, source_file, exhibit_type, pe_number, CASE WHEN line_item = '7' THEN 'seven' ELSE line_item END AS line_item, amount_type, CASE WHEN quantity > 20 THEN NULL ELSE amount END AS amount FROM facts),
e AS (SELECT source_file, count(*) + CASE WHEN source_file LIKE '%FRANCE%' THEN 1 ELSE 0 END AS n FROM v WHERE source_file NOT LIKE '%CHINA%' GROUP BY 1 UNION ALL SELECT 'absent.xlsx', 3),
f AS (SELECT source_file, count(*) AS n FROM v GROUP BY 1), o AS (SELECT count(DISTINCT organization_name) AS a FROM v)
SELECT 'rows' AS "check", exhibit_type AS subject, count(*)::DOUBLE AS value, false AS failed FROM v GROUP BY 2
UNION ALL SELECT 'unknown_exhibit', exhibit_type, count(*), true FROM v WHERE exhibit_type = 'r2' GROUP BY 2
UNION ALL SELECT 'duplicate_keys', 'pe_number,fiscal_year,exhibit_type', count(*), count(*) > 0 FROM (SELECT 1 FROM v GROUP BY pe_number, fiscal_year, exhibit_type HAVING count(*) > 1)
UNION ALL {' UNION ALL '.join(f"SELECT 'null_share', '{c}', round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END), 4), avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) > 0.5 FROM v" for c in _VALIDATED)}
UNION ALL SELECT 'out_of_range', 'amount', count(*), count(*) > 0 FROM v WHERE abs(amount) > 30000
UNION ALL SELECT 'row_count', coalesce(f.source_file, e.source_file), coalesce(f.n, 0) - coalesce(e.n, 0), true FROM f FULL JOIN e ON f.source_file = e.source_file WHERE coalesce(f.n, 0) <> coalesce(e.n, 0)
UNION ALL SELECT 'organizations', fiscal_year, count(DISTINCT organization_name), count(DISTINCT organization_name) < 0.25 * max(a) FROM v, o GROUP BY 2
UNION ALL SELECT 'not_a_number', 'line_item', count(*), count(*) > 0 FROM v WHERE line_item = 'seven'""", [*_VALIDATED, "quantity"])  # fmt: skip
def _(df):
    """All eight checks over a table with planted faults: missing organizations and amounts, a word for a number, other row counts."""
    far = (F.col("fiscal_year") == "1998") & (F.col("organization_name") != "ASIA")
    lines = df.withColumn("organization_name", F.when(~far | far.isNull(), F.col("organization_name"))).withColumn("line_item", F.when(F.col("line_item") == "7", "seven").otherwise(F.col("line_item"))).withColumn("amount", F.when(F.col("quantity") <= 20, F.col("amount"))).select(*_VALIDATED)
    named = F.contains("source_file", F.lit("FRANCE")).cast("int")
    expected = lines.where(~F.contains("source_file", F.lit("CHINA"))).groupBy("source_file").agg((F.count("*") + F.max(named)).alias("n_rows")).unionByName(df.sparkSession.createDataFrame([("absent.xlsx", 3)], "source_file string, n_rows long"))
    return Q.validations(lines, expected, ["p1", "r1"], ["pe_number", "fiscal_year", "exhibit_type"], ["line_item"], 30000)


@on_table("dq33_empty_tables", "documents", """SELECT source, count(*) FILTER (contains(text, '|')) AS with_tables, count(*) FILTER (regexp_matches(text, '\\|\\s*\\|')) AS empty_cells
FROM documents GROUP BY 1""")
def _(df):
    return df.groupBy("source").agg(F.count_if(F.contains("text", F.lit("|"))).alias("with_tables"), F.count_if(F.rlike("text", F.lit(r"\|\s*\|"))).alias("empty_cells"))


@on_facts("dq34_yearly_outliers", """, y AS (SELECT pe_number, CAST(sum(CASE WHEN fiscal_year = '2001' THEN amount END) AS DOUBLE) AS l, CAST(sum(CASE WHEN fiscal_year = '2000' THEN amount END) AS DOUBLE) AS p
FROM facts GROUP BY 1)
SELECT pe_number, round((l - p) / abs(p) * 100, 2) AS pct FROM y WHERE p <> 0 AND abs((l - p) / abs(p) * 100) > 50
ORDER BY abs(l - p) DESC, 1 LIMIT 500""", ["pe_number", "fiscal_year", "amount"])  # fmt: skip
def _(df):
    y = df.groupBy("pe_number").agg(S.money(S.of_year("2001")).alias("l"), S.money(S.of_year("2000")).alias("p"))
    pct = (F.col("l") - F.col("p")) / F.abs("p") * 100
    return y.where((F.col("p") != 0) & (F.abs(pct) > 50)).orderBy(F.desc(F.abs(F.col("l") - F.col("p"))), "pe_number").limit(500).select("pe_number", F.round(pct, 2).alias("pct"))


@on_tables("dq35_all_checks", "documents labels", """SELECT 'short_texts' AS name, 'warning' AS severity, count(*) AS n, count(*) > 0 AS failed FROM documents WHERE length(text) < 20 UNION ALL
SELECT 'orphans', 'error', count(*), count(*) > 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(docs, labels):
    registry = Q.Checks().add("short_texts", "warning", docs.where(F.length("text") < 20)).add("orphans", "error", R.anti(labels, docs, "doc_id", "doc_id"))
    return registry.report()


# repair, reconciliation, consolidation


@on_table("rp01_seeded", "region", "SELECT r_name FROM region UNION ALL SELECT 'OCEANIA'")
def _(df):
    seeds = df.sparkSession.createDataFrame([("ASIA",), ("OCEANIA",)], "r_name string")
    return P.seeded(df.select("r_name"), seeds, "r_name")


@on_table("rp02_normalized_organizations", "region", "SELECT r_regionkey, CASE r_name WHEN 'ASIA' THEN 'Orient' ELSE r_name END AS r_name FROM region")
def _(df):
    return df.withColumn("r_name", T.organization(F.col("r_name"), {"Orient": ["ASIA"]}))


@on_table("rp03_filled_codes", "part", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type WHEN contains(p_name, 'ring') THEN 'R' WHEN contains(p_name, 'widget') THEN 'W' END AS code
FROM part""")
def _(df):
    code = T.appropriation(F.col("p_name"), titles={"X": ["no such title"]}, keywords=[("ring", "R"), ("widget", "W")])["code"]
    return df.select("p_partkey", F.coalesce(F.when(F.col("p_size") % 2 == 0, F.col("p_type")), code).alias("code"))


@on_tables("rp05_dimension_from_facts", "facts region", """
SELECT exhibit_type AS code, CASE WHEN contains(exhibit_type, 'p') THEN 'procurement' WHEN contains(exhibit_type, 'r1') THEN 'summary' ELSE 'other' END AS category
FROM (SELECT DISTINCT exhibit_type FROM facts WHERE exhibit_type <> 'r2') UNION ALL SELECT 'r2', 'known'""")
def _(df, _region):
    known = df.sparkSession.createDataFrame([("r2", "known")], "code string, category string")
    return P.dimension_from_facts(known, df.withColumnRenamed("exhibit_type", "code"), "code", [("p", "procurement"), ("r1", "summary")])


@on_facts("rp06_years_of_paths", " SELECT source_file, min(fiscal_year) AS source_fiscal_year FROM facts GROUP BY 1", ["source_file"])
def _(df):
    return df.select("source_file").distinct().withColumn("source_fiscal_year", fiscal_year_of_path(F.col("source_file")))


@on_table("rp07_programs_by_pattern", "part", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 7, '0') || 'A' END AS pe_number FROM part")
def _(df):
    item = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("BLI "), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("A"))).otherwise("BLI 12")
    return df.select("p_partkey", F.try_element_at(pe_numbers(item), F.lit(1)).alias("pe_number"))


@on_table("rp08_without_leaked_headers", "part", "SELECT p_partkey, p_name || ' made by ' || p_brand AS text FROM part WHERE length(p_name || ' made by ' || p_brand) >= 25")
def _(df):
    rows = df.select("p_partkey", F.concat(F.lit("Exhibit R-2A, x\n"), "p_name", F.lit(" made by "), "p_brand").alias("text"))
    return P.without_leaked_headers(rows, "text", [r"(?m)^Exhibit R-2A.*$"])


@on_table("rp09_without_aggregates", "part", "SELECT p_partkey FROM part WHERE p_size % 4 NOT IN (0, 1)")
def _(df):
    k = F.col("p_size") % 4
    title = F.when(k == 0, "Total PE").when(k == 1, "Total of all").when(k == 2, F.col("p_name"))
    return P.without_aggregates(df.withColumn("title", title), "title").select("p_partkey")


@on_tables("rp10_organizations_by_page", "part", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'own' WHEN p_size % 3 = 1 THEN 'Army' ELSE 'Navy' END AS organization FROM part")
def _(df):
    k = F.col("p_size") % 3
    path, head = F.when(k == 1, "US_Army/x.pdf").otherwise("x.pdf"), F.lit("Department of the Navy\nx")
    org = T.organization_of_source(path, head, [("us_army", "Army")], [("DEPARTMENT OF THE NAVY", "Navy")])
    return df.select("p_partkey", F.coalesce(F.when(k == 0, "own"), org).alias("organization"))


@on_facts("rp11_bare_years", " SELECT pe_number, string_agg(DISTINCT fiscal_year, ',' ORDER BY fiscal_year) AS years FROM facts GROUP BY 1", ["pe_number", "fiscal_year"])
def _(df):
    lists = df.groupBy("pe_number").agg(F.array_sort(F.collect_set(F.concat(F.lit("FY "), "fiscal_year"))).alias("years"))
    return lists.select("pe_number", F.array_join(T.without_year_prefix(F.col("years")), ",").alias("years"))


@on_table("rp13_plausible_organizations", "part", "SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'a' WHEN 3 THEN 'Army' END AS organization FROM part")
def _(df):
    k = F.col("p_size") % 4
    org = F.when(k == 0, "92").when(k == 1, "a").when(k == 2, "K").otherwise("Army")
    return df.select("p_partkey", P.plausible_organization(org, F.concat(F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("A"))).alias("organization"))


@on_facts("rp15_deduplicated_and_counted", f""", k AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(Q.LINE_KEY)} ORDER BY CASE WHEN source_file LIKE '%FY' || fiscal_year || '%' THEN 0 ELSE 1 END, source_file DESC, order_key, line_item, facts.amount) AS r FROM facts)
SELECT fiscal_year, exhibit_type, count(*) AS n_rows, count(*) FILTER (r = 1) AS n_kept, count(*) FILTER (r > 1) AS n_dropped, CAST(sum(amount) FILTER (r = 1) AS DOUBLE) AS kept_amount FROM k GROUP BY 1, 2""", [*Q.LINE_KEY, "source_file", "order_key", "line_item", "amount"])  # fmt: skip
def _(df):
    kept = Q.one_row_a_line(df)
    return P.counts_before_and_after(df, kept, ["fiscal_year", "exhibit_type"], "amount")


@on_table("rp16_fixed_rows", "part", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Army' ELSE 'Unspecified' END AS organization FROM part WHERE p_partkey % 5 <> 0")
def _(df):
    k = F.col("p_size") % 3
    path = F.concat(F.when(k == 1, "FY2001/US_Army/").otherwise("FY2001/"), F.when(F.col("p_partkey") % 5 == 0, "r1a.xlsx").otherwise("r1.xlsx"))
    rows = P.without_alternates(df.withColumn("path", path), "path")
    return rows.select("p_partkey", P.filled_organization(F.when(k == 0, F.col("p_name")).otherwise(" "), F.col("path"), [("us_army", "Army")]).alias("organization"))


@on_table("rp17_upserted", "customer", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_nationkey END AS c_nationkey, c_custkey % 10 = 0 AS fresh FROM customer")
def _(df):
    """Two batches into a store, the second one twice."""
    folder, rows = shared_folder(df.sparkSession, "store"), df.select("c_custkey", "c_nationkey", F.lit(1).alias("at"))
    fresh = rows.where("c_custkey % 10 = 0").withColumn("c_nationkey", F.lit(0).cast(df.schema["c_nationkey"].dataType)).withColumn("at", F.lit(2))
    for batch, part in ((0, rows), (1, fresh), (1, fresh.withColumn("at", F.lit(3)))):
        store.upsert(df.sparkSession, folder, "customer", part, ["c_custkey"], "at", batch)
    return store.read_store(df.sparkSession, folder, "customer").select("c_custkey", "c_nationkey", (F.col("at") == 2).alias("fresh"))


@on_facts("rc01_against_the_total", """, p AS (SELECT exhibit_type, fiscal_year, sum(amount) AS x FROM facts GROUP BY 1, 2), t AS (SELECT exhibit_type, fiscal_year, sum(amount) AS y
FROM facts WHERE organization_name <> 'ASIA' OR fiscal_year = '2001' GROUP BY 1, 2)
SELECT exhibit_type || fiscal_year AS k, CAST(x AS DOUBLE) AS parts, CAST(y AS DOUBLE) AS total, abs(CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) > 0.01 * abs(CAST(y AS DOUBLE)) AS mismatch
FROM p JOIN t USING (exhibit_type, fiscal_year)""", ["exhibit_type", "fiscal_year", "amount", "organization_name"])  # fmt: skip
def _(df):
    rows = df.withColumn("k", F.concat("exhibit_type", "fiscal_year"))
    return P.against_total(rows, rows.where("organization_name <> 'ASIA' OR fiscal_year = '2001'"), "k", "amount", 0.01)


@on_facts("rc03_summary_and_detail", """, a AS (SELECT account, sum(amount) AS x FROM facts WHERE exhibit_type = 'r1' GROUP BY 1), b AS (SELECT account, sum(amount) AS y FROM facts
WHERE exhibit_type = 'r2' GROUP BY 1)
SELECT account, CAST(x AS DOUBLE) AS summary, CAST(y AS DOUBLE) AS detail FROM a JOIN b USING (account) WHERE abs(x - y) > 0.05 * abs(x)""", ["account", "exhibit_type", "amount"])  # fmt: skip
def _(df):
    side = lambda e, name: df.where(F.col("exhibit_type") == e).groupBy("account").agg(F.sum("amount").alias(name))
    both = side("r1", "x").join(side("r2", "y"), "account").where(F.abs(F.col("x") - F.col("y")) > 0.05 * F.abs("x"))
    return both.select("account", S.money(F.col("x")).alias("summary"), S.money(F.col("y")).alias("detail"))


def _wide(df):
    amounts = df.groupBy("pe_number", "source_file").pivot("fiscal_year", YEARS[-2:]).agg(F.sum("amount"))
    return amounts.withColumnsRenamed({"2000": "amount_fy2000_actual", "2001": "amount_fy2001_request"})


_WIDE = ["pe_number", "source_file", "fiscal_year", "amount"]


@on_facts("co02_submitted_amounts", """
SELECT pe_number, source_file, fiscal_year AS target_fy, CASE fiscal_year WHEN '2000' THEN 'actual' ELSE 'request' END AS kind, CAST(sum(amount) AS DOUBLE) AS amount, CASE fiscal_year WHEN '2000' THEN 1 ELSE 5 END AS precedence
FROM facts WHERE fiscal_year IN ('2000', '2001') GROUP BY 1, 2, 3 HAVING sum(amount) <> 0""", _WIDE)
def _(df):
    return P.submitted_amounts(_wide(df), ["pe_number", "source_file"])


@on_facts("co02_best_amounts", """, a AS (SELECT pe_number, fiscal_year AS target_fy, CASE exhibit_type WHEN 'p1' THEN 'actual' WHEN 'r1' THEN 'enacted' ELSE 'request' END AS kind, CASE exhibit_type WHEN 'p1' THEN 1 WHEN 'r1' THEN 2 ELSE 5 END AS precedence, sum(amount) AS s
FROM facts GROUP BY ALL)
SELECT pe_number, target_fy, kind, CAST(s AS DOUBLE) AS amount FROM a QUALIFY row_number() OVER (PARTITION BY pe_number, target_fy
ORDER BY precedence) = 1""", ["pe_number", "fiscal_year", "exhibit_type", "amount"])  # fmt: skip
def _(df):
    e = F.col("exhibit_type")
    kind, rank = F.when(e == "p1", "actual").when(e == "r1", "enacted").otherwise("request"), F.when(e == "p1", 1).when(e == "r1", 2).otherwise(5)
    rows = df.groupBy("pe_number", F.col("fiscal_year").alias("target_fy"), kind.alias("kind"), rank.alias("precedence")).agg(S.money(F.sum("amount")).alias("amount"))
    return P.best_amounts(rows, ["pe_number"])


@on_facts("co03_raw_submissions", """, w AS (SELECT pe_number, source_file, CAST(sum(CASE WHEN fiscal_year = '2000' THEN amount END) AS DOUBLE) AS a, CAST(sum(CASE WHEN fiscal_year = '2001' THEN amount END) AS DOUBLE) AS r
FROM facts GROUP BY 1, 2)
SELECT pe_number, source_file, a, r FROM w""", _WIDE)  # fmt: skip
def _(df):
    raw = P.raw_submissions(_wide(df), ["pe_number", "source_file"])
    cells = F.from_json("raw_amounts", "map<string,double>")
    return raw.select("pe_number", "source_file", cells["amount_fy2000_actual"].alias("a"), cells["amount_fy2001_request"].alias("r"))


# headers of staged sheets


def _sheets(df):
    header = F.array(F.lit("Account"), F.lit("PE / BLI"), F.lit("Line Item\nTitle"), F.lit("FY 2025"), F.lit("FY2026"), F.lit("Quantity FY 2026"), F.lit("Authorization Amount"), F.lit("Account"))
    below = F.when(F.col("p_size") % 2 == 0, F.array(F.lit(""), F.lit(None).cast("string"), F.lit(""), F.lit("Enacted"), F.lit("Disc Request"), F.lit("Total"), F.lit(""), F.lit(""))).otherwise(F.array(*[F.lit("1")] * 8))
    return spread(df).select("p_partkey", F.lit("r1").alias("exhibit"), F.lit("2026").alias("year"), H.merged_header(header, below).alias("header"))


@on_table("hm01_merged_headers", "part", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'FY 2025 Enacted|FY2026 Disc Request|Quantity FY 2026 Total' ELSE 'FY 2025|FY2026|Quantity FY 2026' END AS header
FROM part""")
def _(df):
    return _sheets(df).select("p_partkey", F.array_join(F.slice("header", 4, 3), "|").alias("header"))


@on_table("hm02_mapped_columns", "part", """SELECT p_partkey, f.field, f.place
FROM part, (VALUES (0, 'account', 0), (0, 'line_item', 1), (0, 'line_item_title', 2), (0, 'amount_fy2026_request', 6), (0, 'quantity_fy2026', 5), (1, 'account', 0), (1, 'line_item', 1), (1, 'line_item_title', 2), (1, 'amount_fy2025_enacted', 3), (1, 'amount_fy2026_request', 4), (1, 'quantity_fy2026_total', 5)) f(two, field, place)
WHERE f.two = CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END""")  # fmt: skip
def _(df):
    return H.mapped_columns(_sheets(df), ["p_partkey"], "header", "exhibit", "year")


@on_table("hm03_year_headers", "part", """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'amount_fy2024_actual' WHEN 1 THEN 'amount_fy2025_supplemental' WHEN 2 THEN 'amount_fy2026_request' WHEN 3 THEN 'quantity_fy2025_request' ELSE 'amount_fy2026_total' END AS field
FROM part""")
def _(df):
    h = F.element_at(F.array(*map(F.lit, ["FY 2024 Actuals", "FY 2025 Supplemental", "FY2026 Authorization", "FY 2025 Disc Quantity", "fy 2026 Total Obligation"])), F.col("p_size") % 5 + 1)
    return df.select("p_partkey", H.field_of(h, F.lit("p1"), F.lit("2026")).alias("field"))


@on_table("hm04_yearless_headers", "part", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'amount_fy2026_request' WHEN 1 THEN 'amount_fy2026_enacted' ELSE 'amount_fy2026_total' END AS field
FROM part""")
def _(df):
    h = F.element_at(F.array(*map(F.lit, ["Authorization Amount", "Appropriation Amount", "Total Obligation Authority"])), F.col("p_size") % 3 + 1)
    return df.select("p_partkey", H.field_of(h, F.lit("c1"), F.lit("2026")).alias("field"))


@on_table("hm05_catalog_columns", "part", "SELECT p_partkey, 1 AS place, 'title' AS field FROM part UNION ALL SELECT p_partkey, 0, 'line' FROM part")
def _(df):
    sheets = df.select("p_partkey", F.array(F.lit("The Line Item"), F.lit("Line Item Title"), F.lit("Other")).alias("header"))
    return H.catalog_columns(sheets, ["p_partkey"], "header", [("line item", "line"), ("line item title", "title")])


@on_table("hm06_exhibits_of_files", "part", """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'p1r' WHEN 1 THEN 'r2' WHEN 2 THEN 'p5' WHEN 3 THEN 'oco' WHEN 4 THEN 'p5' ELSE 'unknown' END AS exhibit, CASE p_size % 6 WHEN 0 THEN 'summary' WHEN 1 THEN 'detail' WHEN 2 THEN 'detail' WHEN 4 THEN 'detail' ELSE 'other' END AS category
FROM part""")
def _(df):
    name = F.element_at(F.array(*map(F.lit, ["P1R_display.xlsx", "book_r2.pdf", "proc_dla.pdf", "FY20_OCO_file.xlsx", "apn_ba1.pdf", "notes.xlsx"])), F.col("p_size") % 6 + 1)
    category = H.category_of(name, families=[(r"proc|apn", "detail"), (r"omn", "summary")])
    return df.select("p_partkey", H.exhibit_of(name, [("apn", "p5")], [("oco", "oco")]).alias("exhibit"), category.alias("category"))


@on_table("hm07_categories", "part", """SELECT DISTINCT p_brand, CASE WHEN contains(lower(p_brand), '#1') THEN 'detail' WHEN contains(lower(p_brand), '#2') THEN 'summary' ELSE 'other' END AS category
FROM part""")
def _(df):
    return df.select("p_brand", H.category_of(F.col("p_brand"), ["#1"], ["#2"]).alias("category")).distinct()


@on_table("hm08_units", "part", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_retailprice * 1000 ELSE p_retailprice END AS thousands, CASE WHEN p_size % 3 = 0 THEN 'constant' ELSE 'then-year' END AS currency
FROM part""")
def _(df):
    unit = H.unit_of(F.array(F.lit("Department"), F.when(F.col("p_size") % 2 == 0, "(Dollars in Millions)").otherwise("(Dollars in Thousands)")))
    currency = H.currency_of(F.when(F.col("p_size") % 3 == 0, "Constant Dollars").otherwise("R1"), F.lit("r1.xlsx"))
    return df.select("p_partkey", (F.col("p_retailprice") * unit).alias("thousands"), currency.alias("currency"))


@on_table("hm09_currency_years", "part", "SELECT DISTINCT p_type, CASE WHEN contains(lower(p_type), 'constant') THEN 'constant' ELSE 'then-year' END AS currency FROM part")
def _(df):
    return df.select("p_type", H.currency_of(F.col("p_type"), F.lit("file")).alias("currency")).distinct()


@on_facts("hm10_places_of_paths", " SELECT DISTINCT source_file, fiscal_year AS year, 'pb' AS cycle, 'Other' AS category FROM facts", ["source_file"])
def _(df):
    return df.select("source_file").distinct().select("source_file", H.place_of_path(F.col("source_file")).alias("p")).select("source_file", "p.*")


# full-text search


def _document_index(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return I.stored_index(docs, f"{sf_dir}/documents", "doc_id", ["text"])


def _on_index(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, _document_index(spark, sf_dir), read(spark, sf_dir, "documents"))
        ORACLES[name] = sql
        return f

    return add


def _on_stored(name: str, table: str, sql: str, make):
    """Register a query of a folder that `make(df)` gives, and the table."""

    def add(f):
        def run(spark, sf_dir):
            df = read(spark, sf_dir, table)
            return f(spark, make(df, f"{sf_dir}/{table}"), df)

        QUERIES[name] = run
        ORACLES[name] = sql
        return f

    return add


_W = r"w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents), u AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM w)"


@_on_index("ft01_postings", f"WITH {_W} SELECT doc_id AS key, term, count(*) AS frequency, max(size) AS size FROM u WHERE term IN ('license', 'error') GROUP BY 1, 2")
def _(spark, folder, docs):
    return I.hits(spark, folder, ["License", "error"]).select("key", "term", "frequency", "size")


@_on_stored("ft02_page_index", "pages", r"""WITH u AS (SELECT page_id, unnest(regexp_extract_all(lower(url || ' ' || html), '[\p{L}\p{N}]+')) AS term FROM pages)
SELECT page_id AS key, count(*) AS frequency FROM u WHERE term = 'html' GROUP BY 1""", lambda df, name: I.stored_index(df, name, "page_id", ["url", "html"]))  # fmt: skip
def _(spark, folder, df):
    return I.hits(spark, folder, ["html"]).select("key", "frequency")


def _changed_conversations(df, name):
    """An index of half of the turns, with other texts for some, brought up to the table; then merged."""
    keyed = df.withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    known = (df.sparkSession.sparkContext.applicationId, name)
    if known not in _CHANGED:
        _CHANGED[known] = folder = shared_folder(df.sparkSession, "text-index")
        old = keyed.where("k % 2 = 0").withColumn("text", F.when(F.col("k") % 6 == 0, "the the other text").otherwise(F.col("text")))
        more = old.where("k % 10 = 0").withColumn("k", -F.col("k") - 1)
        I.build_index(old.unionByName(more), "k", ["text"], folder)
        I.update_index(keyed, "k", ["text"], folder)
        I.merge_segments(df.sparkSession, folder)
    return _CHANGED[known]


_CHANGED: dict[tuple, str] = {}


@_on_stored("ft03_narrative_index", "conversations", r"""WITH u AS (SELECT conv_id * 1000 + turn AS k, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM conversations)
SELECT k AS key, count(*) AS frequency FROM u WHERE term = 'the' GROUP BY 1""", _changed_conversations)  # fmt: skip
def _(spark, folder, df):
    return I.hits(spark, folder, ["the"]).select("key", "frequency")


@on_table("ft04_plain_terms", "documents", r"""WITH t AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(translate(coalesce(text, '') || ' "x*" AND (--) NOT', '"()*:^+', '       '), '[\s\x0b]+', ' ', 'g')), ' '), lambda t: ltrim(t, '-') <> '' AND upper(t) NOT IN ('AND', 'OR', 'NOT', 'NEAR')) AS terms FROM documents)
SELECT doc_id, CAST(len(terms) AS INTEGER) AS n, md5(array_to_string(terms, ' ')) AS digest FROM t""")  # fmt: skip
def _(df):
    terms = query_terms(F.concat(F.coalesce("text", F.lit("")), F.lit(' "x*" AND (--) NOT')))
    return df.select("doc_id", terms.alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


_RANKED = ["the", "license", "error"]


def _ranked_sql(where: str = "true", limit: str = "") -> str:
    terms = ", ".join(f"'{t}'" for t in _RANKED)
    idf = "CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END"
    return f"""WITH {_W}, p AS (SELECT doc_id, term, count(*) AS f, max(size) AS size FROM u WHERE term IN ({terms}) GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1), t AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w)
SELECT doc_id, round(-sum({idf} * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM p JOIN d USING (term) JOIN documents USING (doc_id), t WHERE {where} GROUP BY 1 {limit}"""


@_on_index("ft05_ranked_search", _ranked_sql())
def _(spark, folder, docs):
    return I.ranked(spark, folder, _RANKED).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@_on_index("ft06_ranked_and_filtered", _ranked_sql("lang = 'en'"))
def _(spark, folder, docs):
    kept = docs.where("lang = 'en'").select(F.col("doc_id").alias("key"))
    return I.ranked(spark, folder, _RANKED).join(kept, "key", "left_semi").select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def _substrings(key, text, columns=None):
    def make(df, name):
        known = (df.sparkSession.sparkContext.applicationId, name, text, I.files_fingerprint(df))
        if known not in _CHANGED:
            folder = shared_folder(df.sparkSession, "substring-index")
            N.build_substring_index(df, key, text, folder, columns)
            _CHANGED[known] = folder
        return _CHANGED[known]

    return make


@_on_stored("ft07_ordered_substrings", "documents", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'licensed under') ORDER BY source, doc_id LIMIT 50", _substrings("doc_id", "text", ["source"]))
def _(spark, folder, docs):
    return N.rows_with(spark, folder, "doc_id", "text", "Licensed under").orderBy("source", "doc_id").limit(50).select("doc_id", "source")


@_on_stored("ft07_stored_substrings", "part", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'all r')", _substrings("p_partkey", "p_name"))
def _(spark, folder, parts):
    return N.rows_with(spark, folder, "p_partkey", "p_name", "ALL R").select("p_partkey", "p_name")


@on_tables("ft08_unified_search", "documents part", r"""SELECT * FROM (SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE contains(lower(text), 'license')
ORDER BY doc_id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part WHERE contains(lower(p_name), 'ring')
ORDER BY p_partkey LIMIT 20)""")
def _(docs, parts):
    part = lambda kind, df, key, c, word: df.where(contains_any([c], [word])).orderBy(key).limit(20).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
    return part("document", docs, "doc_id", "text", "license").unionByName(part("part", parts, "p_partkey", "p_name", "ring"))


@on_tables("ft09_suggestions_by_field", "part customer", """WITH u AS (SELECT DISTINCT 0 AS rank, 'program' AS field, p_name AS value FROM part WHERE contains(lower(p_name), 'bu') UNION
SELECT 1, 'segment', c_mktsegment FROM customer WHERE contains(lower(c_mktsegment), 'bu'))
SELECT field, value, CASE WHEN starts_with(lower(value), 'bu') THEN 0 ELSE 1 END AS priority FROM u""")  # fmt: skip
def _(parts, customers):
    from ledgerspark.operators.search import suggest

    return suggest([("program", parts, "p_name"), ("segment", customers, "c_mktsegment")], "BU", 1000)


@_on_index("ft10_prefiltered_ids", f"""WITH {_W}, h AS (SELECT DISTINCT doc_id FROM u WHERE term = 'license') SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id
FROM h) AND n_chars > 500""")
def _(spark, folder, docs):
    found = I.hits(spark, folder, ["license"]).select(F.col("key").alias("doc_id")).distinct()
    return docs.where("n_chars > 500").join(found, "doc_id", "left_semi").select("doc_id", "n_chars")


@_on_index("ft11_hits_by_size", f"""WITH {_W}, h AS (SELECT DISTINCT doc_id FROM u WHERE term = 'license') SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id
FROM h) AND contains(source, 'src') ORDER BY coalesce(n_chars, 0) DESC, doc_id LIMIT 30""")
def _(spark, folder, docs):
    found = I.hits(spark, folder, ["license"]).select(F.col("key").alias("doc_id")).distinct()
    return docs.where(F.contains("source", F.lit("src"))).join(found, "doc_id", "left_semi").orderBy(F.desc(F.coalesce("n_chars", F.lit(0))), "doc_id").limit(30).select("doc_id")


@_on_index("ft12_prefix_or_title", f"""WITH {_W}, h AS (SELECT DISTINCT doc_id FROM u WHERE starts_with(term, 'licen')) SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id
FROM h) OR contains(lower(source), 'src1')""")
def _(spark, folder, docs):
    return S.matching_or_titled(docs, "doc_id", I.hits(spark, folder, ["licen"], prefix=True).select(F.col("key").alias("doc_id")), "source", "src1").select("doc_id")


_CUT = "substring(text, greatest(1, hit - 80), 200)"


@on_table("ft13_highlighted_snippets", "documents", rf"""WITH d AS (SELECT doc_id, text, instr(lower(text), 'license') AS hit FROM documents)
SELECT doc_id, CASE WHEN greatest(1, hit - 80) > 1 THEN '...' ELSE '' END || regexp_replace(replace(replace(replace(replace({_CUT}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '(license)', '<mark>\1</mark>', 'gi') || CASE WHEN length(text) > greatest(1, hit - 80) + 199 THEN '...' ELSE '' END AS snippet
FROM d WHERE hit > 0""")  # fmt: skip
def _(df):
    return df.where(contains_any(["text"], ["license"])).select("doc_id", I.highlighted(F.col("text"), ["license"]).alias("snippet"))


@on_table("ft14_marked_terms", "part", "SELECT p_partkey, regexp_replace(p_name, '(ring|red)', '<mark>\\1</mark>', 'gi') AS marked FROM part")
def _(df):
    return df.select("p_partkey", I.highlighted(F.col("p_name"), ["ring", "red"]).alias("marked"))


# files and manifests


_SITE = "regexp_extract(url, 'example[.]([a-z]+)', 1)"


@on_table("sc14_pending_entries", "pages", "SELECT page_id FROM pages WHERE page_id % 3 = 0 OR page_id < 20")
def _(df):
    manifest = df.select("page_id", "url", F.when(F.col("page_id") % 3 == 0, "failed").otherwise("ok").alias("status"), F.col("page_id").alias("at"))
    return files.pending(manifest, F.lit(20)).select("page_id")


@on_table("sc15_manifest_summary", "pages", f"""SELECT {_SITE} AS source, page_id % 4 + 2020 AS year, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 7 = 0 THEN 'size' WHEN page_id % 11 = 0 THEN 'digest' ELSE 'ok' END AS state, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes
FROM pages GROUP BY 1, 2, 3""")  # fmt: skip
def _(df):
    """A manifest of all pages against what is found: some are missing, some of another size or content."""
    k, digest = F.col("page_id"), F.sha2("html", 256)
    manifest = df.select("page_id", k.cast("string").alias("url"), F.regexp_extract("url", "example[.]([a-z]+)", 1).alias("source"), (k % 4 + 2020).alias("year"), F.octet_length("html").alias("size"), digest.alias("digest"))
    found = df.where(k % 5 != 0).select(k.cast("string").alias("url"), F.when(k % 7 == 0, -1).otherwise(F.octet_length("html")).alias("size"), F.when(k % 11 == 0, "other").otherwise(digest).alias("digest"))
    return files.verified(manifest, found).groupBy("source", "year", "state").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@on_table("sc17_first_source_wins", "pages", f"""WITH f AS (SELECT page_id, {_SITE} AS source, page_id % 4 AS year, CASE WHEN page_id % 2 = 0 THEN upper(url) ELSE url END AS file FROM pages),
n AS (SELECT *, lower(regexp_extract(file, '/([^/]*)$', 1)) AS name, CASE source WHEN 'org' THEN 1 WHEN 'com' THEN 2 ELSE 3 END AS place FROM f)
SELECT year, name, source, min(page_id) AS page_id FROM (SELECT *, rank() OVER (PARTITION BY year, name ORDER BY place) AS r FROM n WHERE (year, name) NOT IN (SELECT (year, name) FROM n WHERE page_id % 10 = 3)) WHERE r = 1 GROUP BY 1, 2, 3""")  # fmt: skip
def _(df):
    """Files of three sites by year and name, without those that are there: every tenth page's; of one site's the first page."""
    url = F.when(F.col("page_id") % 2 == 0, F.upper("url")).otherwise(F.col("url"))
    found = df.select(F.regexp_extract("url", "example[.]([a-z]+)", 1).alias("source"), (F.col("page_id") % 4).alias("year"), F.regexp_extract(url, "/([^/]*)$", 1).alias("file"), "page_id")
    return files.first_source_wins(found, ["org", "com"], found.where("page_id % 10 = 3"), "page_id").select("year", F.lower("file").alias("name"), "source", "page_id")


@on_table("so10_dropped_tables", "events", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r > 50")
def _(df):
    return files.beyond_newest(df.select("event_id", "ts"), "event_id", "ts").select("event_id")


@on_table("hm11_added_columns", "part", "SELECT p_partkey, p_name, CAST(NULL AS DOUBLE) AS amount_fy2027, CAST(NULL AS VARCHAR) AS note FROM part")
def _(df):
    return files.with_absent(df.select("p_partkey", "p_name"), {"P_NAME": "int", "amount_fy2027": "double", "note": "string"})


@on_facts("sc18_exhibit_inventory", """, h AS (SELECT DISTINCT exhibit_type, source_file, account || '/' || amount_type AS header FROM facts), s AS (SELECT exhibit_type, source_file, string_agg(header, '|' ORDER BY header) AS headers FROM h GROUP BY 1, 2),
n AS (SELECT exhibit_type, source_file, count(*) AS n FROM facts GROUP BY 1, 2)
SELECT exhibit_type, md5(headers) AS headers, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_rows, min(source_file) AS first_file FROM s JOIN n USING (exhibit_type, source_file) GROUP BY 1, 2""", ["exhibit_type", "source_file", "account", "amount_type"])  # fmt: skip
def _(df):
    found = files.inventory(df.select("exhibit_type", "source_file", F.concat_ws("/", "account", "amount_type").alias("header")), "exhibit_type", "source_file", "header")
    return found.withColumn("headers", F.md5(F.array_join("headers", "|")))


@on_table("sc19_header_signatures", "part", """SELECT exhibit, header, min(p_partkey) AS first_seen, count(*) AS n
FROM (SELECT p_partkey, 'r1' AS exhibit, CASE WHEN p_size % 2 = 0 THEN 'account|line_item|line_item_title|amount_fy2025_enacted|amount_fy2026_request|quantity_fy2026_total' ELSE 'account|line_item|line_item_title|amount_fy2026_request|quantity_fy2026' END AS header
FROM part) GROUP BY 1, 2""")
def _(df):
    fields = H.mapped_columns(_sheets(df), ["p_partkey"], "header", "exhibit", "year")
    kind = F.when(F.startswith("field", F.lit("amount")), 1).when(F.startswith("field", F.lit("quantity")), 2).otherwise(0)
    signature = fields.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(kind.alias("k"), "field"))), lambda x: x["field"]), "|").alias("header"))
    return signature.groupBy(F.lit("r1").alias("exhibit"), "header").agg(F.min("p_partkey").alias("first_seen"), F.count("*").alias("n"))


@on_facts("sk05_program_funding", """
SELECT fiscal_year, CAST(sum(amount) AS DOUBLE) AS amount, round((CAST(sum(amount) AS DOUBLE) - lag(CAST(sum(amount) AS DOUBLE)) OVER (ORDER BY fiscal_year)) / abs(lag(CAST(sum(amount) AS DOUBLE)) OVER (ORDER BY fiscal_year)) * 100, 2) AS change_pct
FROM facts WHERE pe_number = '0000007A' GROUP BY 1""", ["pe_number", "fiscal_year", "amount"])
def _(df):
    years = df.where("pe_number = '0000007A'").groupBy("fiscal_year").agg(S.money(F.sum("amount")).alias("amount"))
    from ledgerspark.sources.files import program_funding

    return program_funding(years)


@on_tables("sk06_program_pages", "conversations", """WITH r AS (SELECT conv_id, min(turn) + 1 AS s, max(turn) AS e FROM conversations GROUP BY 1)
SELECT 'conv_' || c.conv_id || '/page_' || turn || '.txt' AS file, md5(coalesce(text, '')) AS digest
FROM conversations c JOIN r ON c.conv_id = r.conv_id AND turn BETWEEN s AND e""")
def _(turns):
    """Written to a shared folder, a row a file, and read back."""
    from ledgerspark.sources.files import page_files, read_pages, write_pages

    ranges = turns.groupBy("conv_id").agg((F.min("turn") + 1).alias("s"), F.max("turn").alias("e"))
    pages = R.in_ranges(turns.select("conv_id", "turn", "text"), ranges, "conv_id", "turn", "s", "e", 4)
    folder = shared_folder(turns.sparkSession, "pages")
    write_pages(page_files(pages, F.concat(F.lit("conv_"), F.col("conv_id").cast("string")), "turn", "text"), folder)
    return read_pages(turns.sparkSession, folder).select("file", F.md5("text").alias("digest"))


@on_tables("in01_changed_files", "documents", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def _(docs):
    from ledgerspark.streaming.incremental import changed_files

    at = lambda shift: docs.select(F.col("doc_id").cast("string").alias("path"), "n_chars", (F.lit(1000.0) + shift).alias("mtime")).withColumnRenamed("n_chars", "size")
    before = at(F.when(F.col("doc_id") % 7 == 0, 60.0).otherwise(0.4)).where("CAST(path AS BIGINT) % 11 <> 0")
    return changed_files(before, at(F.lit(0.0))).select(F.col("path").cast("long").alias("doc_id"))


@on_tables("in03_removed_files", "documents labels", """SELECT 'documents' AS table_name, doc_id FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT 'labels', doc_id FROM labels WHERE doc_id % 3 <> 0""")
def _(docs, labels):
    """Removed documents take their labels with them, in one commit."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "store")
    store.replace_sources(spark, folder, {"documents": docs.select("doc_id", "source"), "labels": labels}, "doc_id")
    store.replace_sources(spark, folder, {}, "doc_id", gone=docs.where("doc_id % 3 = 0"))
    of = lambda name: store.read_store(spark, folder, name).select(F.lit(name).alias("table_name"), "doc_id")
    return of("documents").unionByName(of("labels"))


@on_facts("in08_replaced_sources", " SELECT source_file, CASE WHEN fiscal_year = '2001' THEN -1 ELSE count(*) END AS n FROM facts GROUP BY source_file, fiscal_year", ["source_file", "fiscal_year"])
def _(df):
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "store")
    counts = df.groupBy("source_file", "fiscal_year").agg(F.count("*").alias("n"))
    store.replace_sources(spark, folder, {"counts": counts})
    store.replace_sources(spark, folder, {"counts": counts.where("fiscal_year = '2001'").withColumn("n", F.lit(-1).cast("long"))})
    return store.read_store(spark, folder, "counts").select("source_file", "n")


@on_table("ud04_exploded_lists", "part", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def _(df):
    return df.select("p_partkey", F.explode(T.json_list(F.to_json(F.split("p_name", " ")))).alias("word"))


