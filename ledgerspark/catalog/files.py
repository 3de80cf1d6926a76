"""Staged tables, exports and reports, written to a shared folder and read back; and the plain forms of some operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions import text as T
from ledgerspark.functions.expressions import amount_token, change_percent, edit_budget
from ledgerspark.operators import aggregates as A
from ledgerspark.operators import quality_checks as Q
from ledgerspark.operators import relations as R
from ledgerspark.operators import summaries as S
from ledgerspark.operators.near_text import fuzzy_terms, same_titles
from ledgerspark.plans.stored import shared_folder
from ledgerspark.registry import YEARS, on_facts, on_table, on_tables, ysum
from ledgerspark.sources import files
from ledgerspark.streaming.incremental import ingest_new_files


@on_table("sc05_selected_files", "documents", "SELECT doc_id FROM documents WHERE doc_id % 10 NOT IN (1, 2)")
def _(df):
    k, n = F.col("doc_id") % 10, F.col("doc_id").cast("string")
    twin = F.concat(F.lit("f"), (F.col("doc_id") - 1).cast("string"), F.lit("_display.xlsx"))  # of the file before
    path = F.when(k == 1, twin).when(k == 2, F.concat(F.lit("p"), n, F.lit("a.xlsx"))).otherwise(F.concat(F.lit("f"), n, F.lit(".xlsx")))
    return files.without_twins(df.select("doc_id", path.alias("path"))).select("doc_id")


_STAGED = ["pe_number", "fiscal_year", "amount"]


def _staged(df):
    """A staged table whose second year's files have a column that the first year's lack."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "staged")
    for year in ("2000", "2001"):
        files.write_staged_year(df.where(F.col("fiscal_year") == year).groupBy("pe_number").agg(S.money(F.sum("amount")).alias(f"amount_fy{year}")), folder, year)
    return spark, folder


@on_facts("sc09_staged_tables", """ SELECT pe_number, CAST(sum(amount) AS DOUBLE) AS amount_fy2000, NULL AS amount_fy2001 FROM facts WHERE fiscal_year = '2000' GROUP BY 1 UNION ALL
SELECT pe_number, NULL, CAST(sum(amount) AS DOUBLE) FROM facts WHERE fiscal_year = '2001' GROUP BY 1""", _STAGED)
def _(df):
    spark, folder = _staged(df)
    return files.read_staged(spark, folder).select("pe_number", "amount_fy2000", "amount_fy2001")


@on_facts("sc10_staged_columns", " SELECT DISTINCT 'amount_fy' || fiscal_year AS name FROM facts WHERE fiscal_year IN ('2000', '2001')", _STAGED)
def _(df):
    spark, folder = _staged(df)
    names = [(c,) for c in files.read_staged(spark, folder).columns if c.startswith("amount_fy")]
    return spark.createDataFrame(names, "name string")


@on_facts("sk08_staged_and_counted", " SELECT fiscal_year AS source_fy, count(*) AS n FROM facts GROUP BY 1", ["fiscal_year", "pe_number", "amount"])
def _(df):
    folder = shared_folder(df.sparkSession, "staged")
    files.write_staged(df, folder)
    return df.sparkSession.read.json(f"{folder}/_sidecar").select("source_fy", "n")


_EXPORT = "SELECT p_name, p_partkey FROM part ORDER BY p_partkey LIMIT 300"


@on_table("sk01_exported_csv", "part", _EXPORT)
def _(df):
    folder = shared_folder(df.sparkSession, "export")
    files.write_csv(files.exported(df, ["p_name", "p_partkey"], "p_partkey", False, limit=300), folder, ["a public table", "no warranty"])
    lines = df.sparkSession.read.text(folder).where("value NOT LIKE '#%' AND value <> 'p_name,p_partkey'")
    cells = F.split("value", ",")
    return lines.select(cells[0].alias("p_name"), cells[1].cast("long").alias("p_partkey"))


@on_table("sk02_exported_json_lines", "part", _EXPORT)
def _(df):
    folder = shared_folder(df.sparkSession, "export")
    files.write_json_lines(files.exported(df, ["p_name", "p_partkey"], "p_partkey", False, limit=300), folder, {"rows": "300"})
    return df.sparkSession.read.schema("_metadata string, p_name string, p_partkey long").json(folder).where("_metadata IS NULL").select("p_name", "p_partkey")


@on_table("sk07_exported_results", "part", "SELECT p_partkey, p_type FROM part WHERE contains(p_name, 'ring') ORDER BY p_type DESC, p_partkey LIMIT 50")
def _(df):
    folder = shared_folder(df.sparkSession, "export")
    rows = df.where(F.contains("p_name", F.lit("ring"))).select("p_partkey", "p_type")
    files.write_json_lines(files.exported(rows, None, "p_type", True, limit=50), folder)
    return df.sparkSession.read.schema("p_partkey long, p_type string").json(folder)


@on_tables("sk10_quality_report", "documents labels", """SELECT 'ok   error   orphans: 0' AS line UNION ALL SELECT CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'ok  ' END || ' warning short_texts: ' || count(*)
FROM documents WHERE length(text) < 20""")
def _(docs, labels):
    checks = Q.Checks().add("short_texts", "warning", docs.where(F.length("text") < 20)).add("orphans", "error", R.anti(labels, docs, "doc_id", "doc_id"))
    return docs.sparkSession.createDataFrame([(x,) for x in files.report_text(checks.report()).splitlines()], "line string")


_DESCRIBED = {"customer": ["c_custkey:bigint", "c_name:string", "c_nationkey:int", "c_acctbal:double", "c_mktsegment:string"], "supplier": ["s_suppkey:bigint", "s_name:string", "s_nationkey:int", "s_acctbal:double"]}


@on_tables("sk11_data_dictionary", "customer supplier", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c.split(':')[0]}' AS column_name, '{c.split(':')[1]}' AS type, count(*) AS n_rows, count({c.split(':')[0]}) AS n_filled, count(DISTINCT {c.split(':')[0]}) AS n_distinct FROM {t}" for t, columns in _DESCRIBED.items() for c in columns))
def _(customers, suppliers):
    return files.described({"customer": customers, "supplier": suppliers})


@on_table("in02_resumed_ingestion", "customer", "SELECT c_custkey, c_mktsegment FROM customer")
def _(df):
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "ingest")
    rows = df.select("c_custkey", "c_mktsegment")
    rows.where("c_custkey % 2 = 0").write.mode("append").parquet(f"{folder}/in")
    ingest_new_files(spark, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/checkpoint")
    rows.where("c_custkey % 2 = 1").write.mode("append").parquet(f"{folder}/in")
    ingest_new_files(spark, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/checkpoint")  # takes up what is new only
    return spark.read.parquet(f"{folder}/out")


# plain forms


@on_facts("fi02_in_lists", " SELECT account, count(*) AS n FROM facts WHERE account IN ('Brand#1', 'Brand#2') GROUP BY 1")
def _(df):
    from ledgerspark.operators.filters import where_lines

    return where_lines(df, account=["Brand#1", "Brand#2"], fiscal_year=[]).groupBy("account").agg(F.count("*").alias("n"))


@on_table("fi06_substrings", "part", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RinG%'")
def _(df):
    return df.where(F.contains(F.lower("p_name"), F.lit("ring"))).select("p_partkey")


@on_tables("jo11_orphans", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(customers, orders):
    return R.anti(customers, orders.where("o_totalprice > 300000"), "c_custkey", "o_custkey").select("c_custkey")


@on_facts("ag07_by_year", " SELECT fiscal_year, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM facts GROUP BY 1")
def _(df):
    return df.groupBy("fiscal_year").agg(F.count("*").alias("n"), S.money(F.sum("amount")).alias("total"))


@on_facts("wi01_mode_of_programs", """, c AS (SELECT pe_number, account, exhibit_type, count(*) AS n FROM facts GROUP BY 1, 2, 3) SELECT pe_number, exhibit_type, n FROM c
QUALIFY row_number() OVER (PARTITION BY pe_number ORDER BY n DESC, exhibit_type) = 1""")
def _(df):
    return A.most_frequent(df, "pe_number", "exhibit_type")


@on_facts("se05_distinct_pairs", " SELECT DISTINCT organization_name, fiscal_year FROM facts")
def _(df):
    return df.select("organization_name", "fiscal_year").distinct()


@on_table("st12_edit_distances", "part", "SELECT DISTINCT p_name, levenshtein(p_name, 'smell rink') AS edits FROM part")
def _(df):
    return df.select("p_name").distinct().withColumn("edits", F.levenshtein("p_name", F.lit("smell rink")))


@on_table("st13_edit_budgets", "part", "SELECT DISTINCT p_brand, CASE WHEN length(p_brand) <= 4 THEN 1 WHEN length(p_brand) <= 8 THEN 2 ELSE 3 END AS budget FROM part")
def _(df):
    return df.select("p_brand", edit_budget(F.col("p_brand")).alias("budget")).distinct()


@on_table("dt02_canonical_years", "orders", "SELECT DISTINCT 'FY ' || year(o_orderdate) AS canonical, 'y' || year(o_orderdate) AS unchanged FROM orders")
def _(df):
    year = F.year("o_orderdate").cast("string")
    return df.select(T.canonical_year(F.concat(F.lit("fy"), year)).alias("canonical"), T.canonical_year(F.concat(F.lit("y"), year)).alias("unchanged")).distinct()


@on_table("dt04_year_keys", "orders", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS k FROM orders")
def _(df):
    return df.select(T.year_key(F.concat(F.lit("FY "), F.year("o_orderdate").cast("string"), F.lit(" (est)"))).alias("k")).distinct()


@on_table("dt06_stamps", "events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, true AS past FROM events")
def _(df):
    return df.select("event_id", T.stamp(F.col("ts")).alias("stamp"), (T.stamp(F.col("ts")) < T.stamp(F.current_timestamp())).alias("past"))


@on_facts("ma01_changes", f""", g AS (SELECT account, CAST({ysum('2001')} AS DOUBLE) AS c, CASE WHEN account = 'Brand#3' THEN 0 ELSE CAST({ysum('2000')} AS DOUBLE) END AS p
FROM facts GROUP BY 1) SELECT account, CASE WHEN p <> 0 THEN round((c - p) / abs(p) * 100, 1) END AS pct FROM g""")
def _(df):
    g = df.groupBy("account").agg(S.money(S.of_year("2001")).alias("c"), S.money(S.of_year("2000")).alias("p"))
    before = F.when(F.col("account") == "Brand#3", 0.0).otherwise(F.col("p"))
    return g.select("account", change_percent(F.col("c"), before, 1).alias("pct"))


@on_table("ma03_amount_tokens", "part", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size + 0.25 AS DOUBLE) END AS amount FROM part")
def _(df):
    k = F.col("p_size") % 3
    token = F.when(k == 0, F.concat(F.col("p_size").cast("string"), F.lit(".25**"))).when(k == 1, "-").otherwise("Continuing")
    return df.select("p_partkey", amount_token(token).alias("amount"))


@on_facts("co04_pivoted_back", " SELECT account, exhibit_type, " + ", ".join(f"CAST(max(CASE WHEN fiscal_year = '{y}' THEN amount END) AS DOUBLE) AS fy{y}" for y in YEARS) + " FROM facts GROUP BY 1, 2", ["account", "exhibit_type", "fiscal_year", "amount"])
def _(df):
    wide = df.groupBy("account", "exhibit_type").pivot("fiscal_year", YEARS).agg(S.money(F.max("amount")))
    return wide.withColumnsRenamed({y: f"fy{y}" for y in YEARS})


@on_facts("dq29_duplicate_lines", " SELECT account, pe_number, fiscal_year, exhibit_type, count(*) AS n FROM facts GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def _(df):
    return Q.duplicate_keys(df, ["account", "pe_number", "fiscal_year", "exhibit_type"])


@on_table("ud02_table_valued_parsers", "part", "SELECT p_partkey, 'Plans' AS header, length('more of ' || p_type || ' next year') AS n FROM part")
def _(df):
    text = F.concat(F.lit("front\nMission:\nshort\nPlans\nmore of "), "p_type", F.lit(" next year"))
    return df.select("p_partkey", F.inline(T.sections(text, ["Mission", "Plans"]))).select("p_partkey", "header", F.length("text").alias("n"))


@on_table("ud03_order_dependent_groups", "part", """WITH t AS (SELECT p_type, p_brand, p_partkey, substring(md5(p_brand), 1, 10 + p_partkey % 20) AS title FROM part)
SELECT p_partkey, title, first(title) OVER (PARTITION BY p_type, p_brand ORDER BY length(title) DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cluster FROM t""")  # fmt: skip
def _(df):
    """Cut titles: each is the beginning of the others of its brand, whatever their order."""
    title = F.expr("substring(md5(p_brand), 1, CAST(10 + p_partkey % 20 AS INT))")
    return same_titles(df.select("p_type", "p_partkey", title.alias("title")), ["p_type"], "title", ["p_partkey"]).select("p_partkey", "title", "cluster")


@on_tables("st14_near_vocabulary", "documents part", """WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents),
w AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS word FROM part)
SELECT word, term, levenshtein(word, term) AS edits FROM w JOIN v ON levenshtein(word, term) <= CASE WHEN length(word) <= 4 THEN 1 WHEN length(word) <= 8 THEN 2 ELSE 3 END
WHERE length(word) >= 3 AND length(term) >= 3""")  # fmt: skip
def _(docs, parts):
    """Every word of the documents near a word of the parts' names and types."""
    terms = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).distinct()
    words = parts.select(F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("word")).distinct()
    return fuzzy_terms(terms, words)
