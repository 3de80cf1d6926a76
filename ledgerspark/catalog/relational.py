"""Filters, joins, aggregates, windows, sorting, sets and subqueries over the fact view."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerspark.functions import text as T
from ledgerspark.functions.expressions import change_percent, contains_any
from ledgerspark.operators import filters as L
from ledgerspark.operators import relations as R
from ledgerspark.operators import searches as Z
from ledgerspark.operators import sketches as K
from ledgerspark.operators import summaries as S
from ledgerspark.plans.sorted_copy import read_page, write_sorted
from ledgerspark.plans.stored import shared_folder, stored
from ledgerspark.registry import LATEST, PREVIOUS, YEARS, on_facts, on_table, on_tables, ysum

# filters


@on_facts("fi04_validated_amount", " SELECT order_key, line_item, CAST(quantity AS DOUBLE) AS quantity FROM facts WHERE quantity BETWEEN 10 AND 20", ["order_key", "line_item", "quantity"])
def _(df):
    c = F.col(S.non_negative_columns(df, "quantity"))
    return df.where(c.between(10, 20)).select("order_key", "line_item", S.money(c).alias("quantity"))


@on_table("fi05_valid_years", "part", "SELECT p_partkey FROM part WHERE p_size % 3 <> 1")
def _(df):
    year = F.when(F.col("p_size") % 3 == 0, "FY 2001").when(F.col("p_size") % 3 == 1, "in 2001")
    return df.where(T.is_year(year)).select("p_partkey")


@on_table("fi08_list_contains", "part", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')")
def _(df):
    as_json = F.to_json(F.split("p_name", " "))
    return df.where(F.array_contains(T.json_list(as_json), "ring")).select("p_partkey")


@on_table("fi09_pe_format_both", "part", "SELECT p_partkey, p_size % 3 = 0 AS strict, p_size % 3 IN (0, 1) AS loose FROM part")
def _(df):
    k = F.col("p_size") % 3
    pe = F.when(k == 0, "0603183D8Z").when(k == 1, "0602702e").otherwise("602702E")
    return df.select("p_partkey", T.is_program(pe).alias("strict"), T.is_program(pe, any_case=True).alias("loose"))


#: Saved searches, one a supplier: what is typed differs by the supplier's number.
_TYPED = {0: "pe:{pe} fy:2000 FY:1999", 1: "org:\"Europe\" year:1998 amount>=50000 amount > 90000 amount<=95000", 2: "Type:p1 approp:'building' \"ring\" amount<=20000.5", 3: "small AND ring (amount>60000) service:asia", 4: "\"small ring\" pe:{pe} pe:0000000A"}
_SEARCHES = "q AS (SELECT s_suppkey AS id, s_suppkey % 5 AS k, lpad(CAST(s_suppkey AS VARCHAR), 7, '0') || 'A' AS pe FROM supplier)"


def _searches(suppliers):
    pe = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 7, "0"), F.lit("A"))
    text = F.lit(_TYPED[0])
    for k, v in _TYPED.items():
        text = F.when(F.col("s_suppkey") % 5 == k, v).otherwise(text)
    return suppliers.select(F.col("s_suppkey").alias("id"), F.replace(text, F.lit("{pe}"), pe).alias("typed"))


@on_table("fi10_search_parts", "supplier", f"""WITH {_SEARCHES}, p AS (SELECT id, unnest(CASE k WHEN 0 THEN ['pe_number=' || pe, 'fiscal_year=2000', 'fiscal_year=1999']
WHEN 1 THEN ['organization_name=Europe', 'fiscal_year=1998', 'least=50000', 'least=90000', 'most=95000'] WHEN 2 THEN ['exhibit_type=p1', 'appropriation_code=building', 'phrase=ring', 'most=20000.5']
WHEN 3 THEN ['word=small', 'word=AND', 'word=ring', 'word=(amount>60000)', 'organization_name=asia'] ELSE ['phrase=small ring', 'pe_number=' || pe, 'pe_number=0000000A'] END) AS part FROM q) SELECT id, part FROM p""")  # fmt: skip
def _(df):
    return _searches(df).select("id", F.explode(Z.search_parts(F.col("typed"))).alias("p")).select("id", F.concat_ws("=", "p.kind", "p.value").alias("part"))


@on_tables("fi11_saved_searches", "supplier facts", f""", {_SEARCHES}, h AS (SELECT q.id, f.amount FROM q JOIN facts f ON CASE k WHEN 0 THEN pe_number = pe AND fiscal_year IN ('2000', '1999')
WHEN 1 THEN organization_name = 'EUROPE' AND fiscal_year = '1998' AND amount BETWEEN 90000 AND 95000
WHEN 2 THEN exhibit_type = 'p1' AND appropriation_code = 'BUILDING' AND ' ' || line_item_title || ' ' LIKE '% ring %' AND amount <= 20000.5
WHEN 3 THEN organization_name = 'ASIA' AND ' ' || line_item_title || ' ' LIKE '% small %' AND ' ' || line_item_title || ' ' LIKE '% ring %' AND line_item_title LIKE '%amount%60000%'
ELSE pe_number IN (pe, '0000000A') AND line_item_title = 'small ring' END)
SELECT id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM h GROUP BY 1""")  # fmt: skip
def _(suppliers, df):
    lines = df.select("pe_number", "organization_name", "exhibit_type", "fiscal_year", "appropriation_code", "line_item_title", "amount")
    searches = _searches(suppliers)
    members = Z.search_classes(searches, "id", "typed")
    one_each = searches.join(members.where("id = same_as").select("id"), "id", "left_semi")
    found = Z.matching_lines(one_each, lines, "id", "typed", ["line_item_title"]).withColumnRenamed("id", "same_as")
    return members.join(found.groupBy("same_as").agg(F.count("*").alias("n"), S.money(F.sum("amount")).alias("total")), "same_as").select("id", "n", "total")


@on_facts("fi11_typed_search", " SELECT order_key, line_item, pe_number FROM facts WHERE exhibit_type IN ('r1', 'r2') AND fiscal_year = '1999' AND amount BETWEEN 20000 AND 80000 AND line_item_title = 'small ring'")
def _(df):
    found = Z.where_search(df, 'exhibit:r1 type:R2 fy:1999 amount>20000 amount>10000 "Small Ring" amount<80000 ring', ["line_item_title"], {"exhibit_type": ["p1", "r1", "r2"]})
    return found.select("order_key", "line_item", "pe_number")


@on_facts("fi12_results_page", """ SELECT order_key, line_item, pe_number, CAST(amount AS DOUBLE) AS amount FROM facts
WHERE fiscal_year IN ('2001') AND amount >= 50000 AND contains(lower(line_item_title), 'ring')
ORDER BY amount DESC, order_key, line_item LIMIT 20 OFFSET 20""", ["order_key", "line_item", "pe_number", "amount", "fiscal_year", "line_item_title"])
def _(df):
    hits = df.where(contains_any(["line_item_title"], ["ring"])).select("order_key").distinct()
    rows = L.where_lines(df, least=50000, fiscal_year=["2001"]).where(contains_any(["line_item_title"], ["ring"])).join(hits, "order_key", "left_semi")
    return L.page(rows, [F.desc("amount"), F.asc("order_key"), F.asc("line_item")], 20, 20).select("order_key", "line_item", "pe_number", S.money(F.col("amount")).alias("amount"))


@on_facts("fi15_column_subset", " SELECT DISTINCT pe_number, account FROM facts", ["pe_number", "account", "line_item_title"])
def _(df):
    return S.projected(df, ["pe_number", "secret", "account"], ["account", "pe_number", "line_item_title"]).distinct()


@on_facts("fi16_related_programs", """, m AS (SELECT account, string_agg(DISTINCT pe_number, ', ' ORDER BY pe_number) AS related FROM facts WHERE fiscal_year = '2001' AND quantity > 49
GROUP BY 1)
SELECT DISTINCT f.account, f.exhibit_type, CASE WHEN f.exhibit_type = 'p1' THEN m.related END AS related_pes FROM facts f
LEFT JOIN m ON m.account = f.account""", ["account", "exhibit_type", "pe_number", "fiscal_year", "quantity"])  # fmt: skip
def _(df):
    related = df.where("fiscal_year = '2001' AND quantity > 49").groupBy("account").agg(S.joined_list("pe_number", ", ").alias("r"))
    shown = F.when(F.col("exhibit_type") == "p1", F.col("r"))
    return df.select("account", "exhibit_type").distinct().join(related, "account", "left").select("account", "exhibit_type", shown.alias("related_pes"))


@on_facts("fi17_shared_filters", """ SELECT count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM facts
WHERE fiscal_year IN ('2000') AND organization_name IN ('ASIA') AND exhibit_type IN ('p1', 'r1') AND appropriation_code IN ('BUILDING') AND amount BETWEEN 1000 AND 90000""")
def _(df):
    chosen = {"fiscal_year": ["2000"], "organization_name": ["ASIA"], "exhibit_type": ["p1", "r1"], "appropriation_code": ["BUILDING"], "pe_number": None}
    return L.where_lines(df, least=1000, most=90000, **chosen).agg(F.count("*").alias("n"), S.money(F.sum("amount")).alias("total"))


@on_facts("fi18_detected_columns", " SELECT account, CAST(sum(CASE WHEN fiscal_year = '2001' THEN amount END) AS DOUBLE) AS latest FROM facts GROUP BY 1", ["account", "fiscal_year", "amount"])
def _(df):
    wide = df.groupBy("account").pivot("fiscal_year", ["2000", "2001"]).agg(S.money(F.sum("amount"))).withColumnsRenamed({"2000": "amount_fy2000_actual", "2001": "amount_fy2001_enacted"})
    return wide.select("account", F.col(S.year_column(wide, 2001, ["request", "enacted", "actual"])).alias("latest"))


@on_facts("fi19_line_details", """
SELECT order_key, line_item, fiscal_year, organization_name, exhibit_type, account, pe_number, line_item_title, appropriation_code, CAST(amount AS DOUBLE) AS amount
FROM facts WHERE order_key < 100""")
def _(df):
    return df.where("order_key < 100").select("order_key", "line_item", "fiscal_year", "organization_name", "exhibit_type", "account", "pe_number", "line_item_title", "appropriation_code", S.money(F.col("amount")).alias("amount"))


@on_facts("fi20_consolidated_list", """ SELECT pe_number, min(line_item_title) AS title, min(organization_name) AS organization, CAST(sum(amount) AS DOUBLE) AS total FROM facts
WHERE (contains(lower(pe_number), 'ring') OR contains(lower(line_item_title), 'ring') OR contains(lower(organization_name), 'ring')) AND organization_name = 'ASIA' AND exhibit_type = 'r1'
GROUP BY 1""")  # fmt: skip
def _(df):
    rows = df.where(contains_any(["pe_number", "line_item_title", "organization_name"], ["ring"]) & (F.col("organization_name") == "ASIA") & (F.col("exhibit_type") == "r1"))
    return rows.groupBy("pe_number").agg(F.min("line_item_title").alias("title"), F.min("organization_name").alias("organization"), S.money(F.sum("amount")).alias("total"))


# joins


@on_tables("jo01_hits_with_rows", "documents labels", "SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id) WHERE contains(lower(text), 'license')")
def _(docs, labels):
    hits = docs.where(contains_any(["text"], ["license"])).select("doc_id", "source")
    return hits.join(labels, "doc_id").select("doc_id", "source", "quality")


@on_facts("jo02_named_facets", " SELECT exhibit_type, count(*) AS n, CASE exhibit_type WHEN 'p1' THEN 'Procurement' WHEN 'r1' THEN 'Research' END AS title FROM facts GROUP BY 1", ["exhibit_type"])
def _(df):
    names = df.sparkSession.createDataFrame([("p1", "Procurement"), ("r1", "Research")], "exhibit_type string, title string")
    return df.groupBy("exhibit_type").agg(F.count("*").alias("n")).join(F.broadcast(names), "exhibit_type", "left")


@on_tables("jo03_case_folded", "nation region", """SELECT n_name, r_name FROM nation
LEFT JOIN region ON lower(r_name) = lower(CASE WHEN n_regionkey = 0 THEN 'africa' WHEN n_regionkey = 2 THEN 'Asia' ELSE '?' END)""")
def _(nation, region):
    key = F.when(F.col("n_regionkey") == 0, "africa").when(F.col("n_regionkey") == 2, "Asia").otherwise("?")
    return nation.join(region, F.lower(key) == F.lower("r_name"), "left").select("n_name", "r_name")


@on_tables("jo04_titles_of_links", "lineitem part", "SELECT l_suppkey, l_partkey, min(p_name) AS title FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25 GROUP BY 1, 2")
def _(lines, parts):
    links = lines.select("l_suppkey", "l_partkey").distinct()
    return links.join(parts.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title")), "l_partkey", "left").select("l_suppkey", "l_partkey", "title")


_LINKS = "l AS (SELECT 'P' || l_partkey AS source, 'S' || l_suppkey AS target, CAST(year(l_shipdate) AS VARCHAR) AS y, round(1 - l_discount, 2) AS confidence, 'line ' || l_linenumber AS snippet FROM lineitem)"


@on_tables("ag19_related_programs", "lineitem supplier", f"""WITH {_LINKS} SELECT source, target, max(confidence) AS confidence, string_agg(DISTINCT y, ','
ORDER BY y) AS years, count(*) AS n, min(snippet) AS snippet, min(s_name) AS title FROM l
LEFT JOIN supplier ON target = 'S' || s_suppkey AND s_suppkey % 2 = 0 WHERE confidence >= 0.95 GROUP BY 1, 2""")
def _(lines, suppliers):
    links = lines.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target"), F.year("l_shipdate").cast("string").alias("year"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("snippet"))
    titles = suppliers.where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("pe_number"), F.col("s_name").alias("title"))
    return S.related(links, titles, 0.95)


@on_tables("jo05_grouped_lineage", "lineitem supplier", "SELECT l_partkey, l_suppkey, count(*) AS n, min(s_name) AS name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def _(lines, suppliers):
    counts = lines.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))  # grouped first: fewer rows to join
    return counts.join(suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name")), "l_suppkey", "left")


@on_tables("jo08_sorted_by_funding", "part lineitem", """SELECT p_partkey, p_name, CAST(f AS DOUBLE) AS funding FROM part LEFT JOIN (SELECT l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS f
FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_partkey = p_partkey ORDER BY f DESC NULLS LAST, p_partkey LIMIT 50""")
def _(parts, lines):
    sums = lines.where("l_returnflag = 'A'").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("f"))
    out = parts.join(sums, F.col("p_partkey") == F.col("l_partkey"), "left").orderBy(F.col("f").desc_nulls_last(), "p_partkey").limit(50)
    return out.select("p_partkey", "p_name", S.money(F.col("f")).alias("funding"))


@on_tables("jo09_semi_join", "part lineitem", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50)")
def _(parts, lines):
    return R.semi(parts, lines.where("l_quantity = 50"), "p_partkey", "l_partkey").select("p_partkey", "p_name")


@on_tables("jo10_hits_or_titles", "documents labels", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR contains(lower(source), 'src1')")
def _(docs, labels):
    return S.matching_or_titled(docs, "doc_id", labels.where("toxic = 1"), "source", "SRC1").select("doc_id")


@on_tables("jo12_untracked_null_aware", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def _(customers, orders):
    return R.anti(customers, orders, "c_custkey", "o_custkey").select("c_custkey")


@on_tables("jo13_unmatched", "documents labels", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
def _(docs, labels):
    return R.anti(docs, labels, "doc_id", "doc_id").select("doc_id")


@on_tables("jo14_either_key", "customer nation", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM nation
WHERE c_mktsegment = n_name OR CASE WHEN c_nationkey < 5 THEN 'NATION_' || c_nationkey ELSE c_mktsegment END = n_name)""")
def _(customers, nation):
    keyed = customers.withColumn("org", F.when(F.col("c_nationkey") < 5, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_mktsegment")))
    names = nation.select(F.col("n_name").alias("code"), F.concat(F.lit("the "), "n_name").alias("full_name"))
    return R.matching_either(keyed, names, "org", "code", "full_name").select("c_custkey")


@on_tables("jo15_union_of_counts", "customer supplier nation", """WITH u AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1)
SELECT n_name, CAST(sum(n) AS BIGINT) AS n FROM nation JOIN u ON k = n_nationkey GROUP BY 1""")
def _(customers, suppliers, nation):
    both = customers.groupBy(F.col("c_nationkey").alias("k")).count().unionByName(suppliers.groupBy(F.col("s_nationkey").alias("k")).count())
    return both.groupBy("k").agg(F.sum("count").alias("n")).join(nation, F.col("k") == F.col("n_nationkey")).select("n_name", "n")


@on_tables("jo16_derived_key", "part lineitem", "SELECT p_partkey, count(*) AS n FROM part JOIN lineitem ON p_partkey = l_partkey AND l_linenumber = p_size % 7 + 1 GROUP BY 1")
def _(parts, lines):
    sheets = parts.select("p_partkey", F.concat(F.lit("page_"), (F.col("p_size") % 7 + 1).cast("string")).alias("sheet_name"))
    page = F.regexp_replace("sheet_name", "page_", "").try_cast("int")
    return sheets.join(lines, (F.col("p_partkey") == F.col("l_partkey")) & (page == F.col("l_linenumber"))).groupBy("p_partkey").agg(F.count("*").alias("n"))


_TAGS = "t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part)"


def _tags(parts):
    return parts.select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag"))


@on_table("jo19_shared_tags", "part", f"""WITH {_TAGS} SELECT p_partkey, count(DISTINCT tag) AS n_shared, string_agg(DISTINCT tag, ',' ORDER BY tag) AS shared FROM t
WHERE p_partkey <> 7 AND tag IN (SELECT tag FROM t WHERE p_partkey = 7) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(df):
    return S.shared_tags(_tags(df), "p_partkey", 7, 10)


@on_table("jo20_accounts_in_text", "part", "SELECT p_partkey, b AS word FROM part, (SELECT unnest(['ring', 'widget']) AS b) WHERE contains(' ' || lower(p_name) || ' ', ' ' || b || ' ')")
def _(df):
    words = df.sparkSession.createDataFrame([(1, "ring"), (2, "widget")], "id int, word string")
    return S.contained(df.select("p_partkey", "p_name"), "p_name", F.broadcast(words), "word", "id").select("p_partkey", "word")


@on_tables("jo21_titles_in_narratives", "benchmark documents", r"""WITH b AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:5], ' ') AS title FROM benchmark),
d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') || ' ' AS t FROM documents) SELECT item_id, doc_id
FROM b, d WHERE contains(t, ' ' || title || ' ')""")  # fmt: skip
def _(items, docs):
    return R.with_titles(docs, "doc_id", "text", items, "item_id", "text", 5)


@on_facts("jo22_batch_lookups", """, k AS (SELECT DISTINCT pe_number FROM facts WHERE fiscal_year = '2001' ORDER BY 1 LIMIT 25)
SELECT pe_number, string_agg(DISTINCT exhibit_type, ','
ORDER BY exhibit_type) AS tags, count(DISTINCT source_file) AS n_files, CAST(sum(amount) AS DOUBLE) AS funding FROM facts JOIN k USING (pe_number)
GROUP BY 1""")  # fmt: skip
def _(df):
    keys = df.where("fiscal_year = '2001'").select("pe_number").distinct().orderBy("pe_number").limit(25)
    return df.join(F.broadcast(keys), "pe_number").groupBy("pe_number").agg(S.joined_list("exhibit_type").alias("tags"), F.countDistinct("source_file").alias("n_files"), S.money(F.sum("amount")).alias("funding"))


@on_tables("jo23_page_ids", "conversations", """SELECT a.conv_id, a.turn, b.turn AS reply FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user'""")
def _(turns):
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("reply"))
    return turns.where("role = 'user'").select("conv_id", "turn").join(replies, ["conv_id", "turn"])


@on_tables("jo24_pages_or_scan", "labels documents", """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'index' ELSE 'scan' END AS found_by FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR (contains(lower(text), 'license') AND doc_id NOT IN (SELECT doc_id FROM labels))""")
def _(labels, docs):
    return R.indexed_or_scanned(docs, "doc_id", labels.where("toxic = 1"), labels, contains_any(["text"], ["license"])).select("doc_id", "found_by")


_ASKED = ["0000007A", "0000003A", "9999999Z"]


@on_facts("ag17_compared_programs", f""" SELECT position, q.pe_number, latest, previous, CASE WHEN previous <> 0 THEN round((latest - previous) / abs(previous) * 100, 2) END AS change_pct
FROM (VALUES (0, '0000007A'), (1, '0000003A'), (2, '9999999Z')) q(position, pe_number)
LEFT JOIN (SELECT pe_number, CAST({ysum(LATEST)} AS DOUBLE) AS latest, CAST({ysum(PREVIOUS)} AS DOUBLE) AS previous FROM facts
GROUP BY 1) f ON f.pe_number = q.pe_number""", ["pe_number", "fiscal_year", "amount"])  # fmt: skip
def _(df):
    return S.compared(df, _ASKED, LATEST, PREVIOUS)


@on_facts("jo25_order_asked_for", """ SELECT position, q.pe_number, n FROM (VALUES (0, '0000007A'), (1, '0000003A'), (2, '9999999Z')) q(position, pe_number)
LEFT JOIN (SELECT pe_number, count(*) AS n FROM facts GROUP BY 1) f ON f.pe_number = q.pe_number ORDER BY position""", ["pe_number"])
def _(df):
    asked = df.sparkSession.createDataFrame(list(enumerate(_ASKED)), "position int, pe_number string")
    counts = df.where(F.col("pe_number").isin(_ASKED)).groupBy("pe_number").agg(F.count("*").alias("n"))
    return F.broadcast(asked).join(counts, "pe_number", "left").orderBy("position")


@on_tables("jo26_items_with_amounts", "orders lineitem", """SELECT o_orderkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS "A",
CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS "N" FROM orders
LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")  # fmt: skip
def _(orders, lines):
    flags = lines.groupBy("l_orderkey").pivot("l_returnflag", ["A", "N"]).agg(S.money(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))))
    return orders.select("o_orderkey").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "A", "N")


# aggregates

_TYPES = {"BUILDING": "Construction", "MACHINERY": "Procurement"}
_TYPE_SQL = "coalesce(CASE WHEN amount_type = 'F' THEN 'Fixed' END, CASE appropriation_code WHEN 'BUILDING' THEN 'Construction' WHEN 'MACHINERY' THEN 'Procurement' END, appropriation_code, 'Unknown')"


def _typed(df):
    return df.withColumn("budget_type", T.budget_type(F.when(F.col("amount_type") == "F", "Fixed"), F.col("appropriation_code"), _TYPES))


@on_facts("ag02_budget_types", f" SELECT {_TYPE_SQL} AS budget_type, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM facts GROUP BY 1", ["appropriation_code", "amount_type", "amount"])
def _(df):
    return _typed(df).groupBy("budget_type").agg(F.count("*").alias("n"), S.money(F.sum("amount")).alias("total"))


@on_facts("ag05_sketched_counts", " SELECT count(*) AS n_rows, count(DISTINCT pe_number) AS programs, count(DISTINCT order_key) AS orders, true AS near FROM facts", ["fiscal_year", "pe_number", "order_key"])
def _(df):
    """Years' stored sketches put together: within five percent of the exact counts."""
    kept = stored(K.sketched(df, ["fiscal_year"], ["pe_number", "order_key"], []), "sketches")
    rough = K.distinct_counts(kept, [], ["pe_number", "order_key"]).select("n_rows", F.col("pe_number").alias("_p"), F.col("order_key").alias("_o"))
    both = rough.join(df.agg(F.countDistinct("pe_number").alias("programs"), F.countDistinct("order_key").alias("orders")))  # a row each
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.05 * F.col(b)
    return both.select("n_rows", "programs", "orders", (off("_p", "programs") & off("_o", "orders")).alias("near"))


@on_facts("ag11_sketched_medians", " SELECT exhibit_type, count(*) AS n, true AS near FROM facts WHERE amount IS NOT NULL GROUP BY 1", ["fiscal_year", "exhibit_type", "amount"])
def _(df):
    """Exhibits' medians from years' sketches: the share of amounts up to each lies within 0.04 of a half."""
    kept = stored(K.sketched(df, ["fiscal_year", "exhibit_type"], [], ["amount"]), "sketches")
    rough = K.quantiles(kept, ["exhibit_type"], "amount", [0.5])
    shares = df.where("amount IS NOT NULL").join(rough, "exhibit_type").groupBy("exhibit_type").agg(F.count("*").alias("n"), F.avg((F.col("amount") <= F.col("q50")).cast("double")).alias("_share"))
    return shares.select("exhibit_type", "n", F.col("_share").between(0.46, 0.54).alias("near"))


@on_facts("ag08_packed_sections", """, y AS (SELECT fiscal_year, count(*) AS n FROM facts GROUP BY 1), e AS (SELECT exhibit_type, count(*) AS n FROM facts GROUP BY 1)
SELECT 'years' AS section, '[' || string_agg('{"value":"' || fiscal_year || '","n":' || n || '}', ',' ORDER BY fiscal_year) || ']' AS body FROM y
UNION ALL SELECT 'exhibits', '[' || string_agg('{"value":"' || exhibit_type || '","n":' || n || '}', ',' ORDER BY exhibit_type) || ']' FROM e""", ["fiscal_year", "exhibit_type"])  # fmt: skip
def _(df):
    one = lambda name, c: df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("body")).select(F.lit(name).alias("section"), "body")
    return one("years", "fiscal_year").unionByName(one("exhibits", "exhibit_type"))


@on_facts("ag09_known_budget_types", f" SELECT {_TYPE_SQL} AS budget_type, CAST(sum(amount) AS DOUBLE) AS total FROM facts WHERE {_TYPE_SQL} <> 'Unknown' GROUP BY 1", ["appropriation_code", "amount_type", "amount"])
def _(df):
    return _typed(df).where("budget_type <> 'Unknown'").groupBy("budget_type").agg(S.money(F.sum("amount")).alias("total"))


@on_facts("ag10_exhibits_or_unknown", " SELECT coalesce(CASE WHEN exhibit_type <> 'r2' THEN exhibit_type END, 'Unknown') AS exhibit, count(*) AS n FROM facts GROUP BY 1", ["exhibit_type"])
def _(df):
    return df.groupBy(F.coalesce(F.when(F.col("exhibit_type") != "r2", F.col("exhibit_type")), F.lit("Unknown")).alias("exhibit")).agg(F.count("*").alias("n"))


@on_tables("ag11_coverage", "documents labels conversations", """WITH c AS (SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id
FROM documents)) AS labelled,
(SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents)) AS talked)
SELECT *, round(100.0 * labelled / total, 1) AS labelled_pct, round(100.0 * talked / total, 1) AS talked_pct FROM c""")  # fmt: skip
def _(docs, labels, turns):
    return S.coverage(docs, "doc_id", {"labelled": labels, "talked": turns.select(F.col("conv_id").alias("doc_id"))})


@on_facts("ag14_exhibit_breakdown", " SELECT pe_number, exhibit_type, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, CAST(min(amount) AS DOUBLE) AS least FROM facts GROUP BY 1, 2", ["pe_number", "exhibit_type", "amount"])
def _(df):
    return df.groupBy("pe_number", "exhibit_type").agg(F.count("*").alias("n"), S.money(F.sum("amount")).alias("total"), S.money(F.min("amount")).alias("least"))


@on_table("ag20_tag_counts", "part", f"""WITH {_TAGS} SELECT tag, count(DISTINCT p_partkey) AS n FROM t JOIN part USING (p_partkey) WHERE p_size >= 10 GROUP BY 1
HAVING count(DISTINCT p_partkey) <= floor((SELECT count(DISTINCT p_partkey) FROM t) * 0.5)""")
def _(df):
    tags = df.select("p_partkey", (F.col("p_size") / 50).alias("confidence"), F.explode(F.split("p_name", " ")).alias("tag"))
    return S.tag_counts(tags, "p_partkey", 0.2, 0.5)


@on_facts("ag22_dropdowns", """ SELECT lower(trim(organization_name)) AS value, count(*) AS n FROM facts WHERE trim(organization_name) <> '' AND organization_name <> 'AFRICA'
GROUP BY 1""", ["organization_name"])
def _(df):
    value = F.lower(F.trim("organization_name"))
    return df.where((F.trim("organization_name") != "") & (F.col("organization_name") != "AFRICA")).groupBy(value.alias("value")).agg(F.count("*").alias("n"))


@on_facts("ag24_program_summaries", """ SELECT pe_number, max(CASE WHEN exhibit_type = 'r1' THEN line_item_title END) AS title, count(*) FILTER (exhibit_type = 'p1') AS n_p1, count(*) AS n
FROM facts GROUP BY 1""", ["pe_number", "exhibit_type", "line_item_title"])
def _(df):
    return df.groupBy("pe_number").agg(F.max(F.when(F.col("exhibit_type") == "r1", F.col("line_item_title"))).alias("title"), F.count_if(F.col("exhibit_type") == "p1").alias("n_p1"), F.count("*").alias("n"))


@on_facts("ag25_active_years", " SELECT account, fiscal_year FROM facts GROUP BY 1, 2 HAVING max(CASE WHEN quantity > 10 THEN amount END) IS NOT NULL", ["account", "fiscal_year", "amount", "quantity"])
def _(df):
    return S.active_years(df.withColumn("amount", F.when(F.col("quantity") > 10, F.col("amount"))), "account")


@on_table("ag28_modes", "lineitem", """WITH c AS (SELECT l_partkey, l_shipdate, l_suppkey, l_returnflag FROM lineitem), f AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM c
GROUP BY 1, 2), s AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM c GROUP BY 1, 2)
SELECT a.l_partkey, a.l_returnflag AS flag, b.l_suppkey AS supplier FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY l_partkey
ORDER BY n DESC, l_returnflag) = 1) a JOIN (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_partkey
ORDER BY n DESC, l_suppkey) = 1) b USING (l_partkey)""")  # fmt: skip
def _(df):
    mode = lambda c: df.groupBy("l_partkey", c).agg(F.count("*").alias("n")).groupBy("l_partkey").agg(F.min_by(c, F.struct(-F.col("n"), c)).alias("m"))
    return mode("l_returnflag").withColumnRenamed("m", "flag").join(mode("l_suppkey").withColumnRenamed("m", "supplier"), "l_partkey")


@on_table("ag29_joined_texts", "part", "SELECT p_brand, string_agg(DISTINCT p_name, ' ' ORDER BY p_name) AS text FROM part GROUP BY 1")
def _(df):
    return df.groupBy("p_brand").agg(S.joined_list("p_name", " ").alias("text"))


@on_facts("ag30_program_totals", " SELECT pe_number, CAST(sum(amount) AS DOUBLE) AS total, min(fiscal_year) AS first_fy, max(fiscal_year) AS last_fy FROM facts GROUP BY 1", ["pe_number", "amount", "fiscal_year"])
def _(df):
    return df.groupBy("pe_number").agg(S.money(F.sum("amount")).alias("total"), F.min("fiscal_year").alias("first_fy"), F.max("fiscal_year").alias("last_fy"))


@on_facts("ag31_top_accounts", """ SELECT account, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM facts WHERE fiscal_year = '2001' GROUP BY 1
ORDER BY sum(amount) DESC, 1 LIMIT 15""", ["account", "amount", "fiscal_year"])
def _(df):
    sums = df.where("fiscal_year = '2001'").groupBy("account").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return sums.orderBy(F.desc("total"), "account").limit(15).withColumn("total", S.money(F.col("total")))


@on_tables("ag32_metadata", "documents labels pages", """SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*)
FROM pages""")
def _(docs, labels, pages):
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
    return one("documents", docs).unionByName(one("labels", labels)).unionByName(one("pages", pages))


@on_facts("ag34_service_totals", f""" SELECT organization_name, CAST({ysum(LATEST)} AS DOUBLE) AS total FROM facts WHERE organization_name IS NOT NULL AND organization_name <> ''
GROUP BY 1 HAVING {ysum(LATEST)} IS NOT NULL""", ["organization_name", "amount", "fiscal_year"])
def _(df):
    return df.where("organization_name <> ''").groupBy("organization_name").agg(S.money(S.of_year(LATEST)).alias("total")).where("total IS NOT NULL")


_CODES = """c AS (SELECT account, line_item_title, fiscal_year, amount, CASE WHEN amount = 0 THEN '' WHEN contains(line_item_title, 'ring') THEN CASE WHEN exhibit_type = 'r1' THEN 'P' ELSE 'Y' END ELSE 'N' END AS code FROM facts)"""


@on_facts("ag36_sums_by_code", f", {_CODES} SELECT account, " + ", ".join(f"CAST(sum(CASE WHEN code = '{k}' THEN amount ELSE 0 END) AS DOUBLE) AS {k.lower()}" for k in "YPN") + " FROM c GROUP BY 1", ["account", "line_item_title", "exhibit_type", "fiscal_year", "amount"])
def _(df):
    match = F.contains("line_item_title", F.lit("ring"))
    code = F.when(F.col("amount") == 0, "").when(match, F.when(F.col("exhibit_type") == "r1", "P").otherwise("Y")).otherwise("N")
    return df.withColumn("code", code).groupBy("account").agg(*[S.money(F.sum(F.when(F.col("code") == k, F.col("amount")).otherwise(0))).alias(k.lower()) for k in "YPN"])


@on_facts("ag37_chart_by_office", f""", t AS (SELECT office FROM facts GROUP BY 1 ORDER BY sum(amount) DESC, 1 LIMIT 8)
SELECT office, fiscal_year, round(CAST(sum(amount) AS DOUBLE) / 1000, 3) AS thousands FROM facts WHERE office IN (SELECT office
FROM t) AND fiscal_year IN ({', '.join(map(repr, YEARS))}) GROUP BY 1, 2""", ["office", "fiscal_year", "amount"])
def _(df):
    top = df.groupBy("office").agg(F.sum("amount").alias("s")).orderBy(F.desc("s"), "office").limit(8).select("office")
    rows = df.where(F.col("fiscal_year").isin(YEARS)).join(F.broadcast(top), "office")
    return rows.groupBy("office", "fiscal_year").agg(F.round(S.money(F.sum("amount")) / 1000, 3).alias("thousands"))


@on_facts("ag38_chart_of_titles", """, t AS (SELECT order_key, line_item, line_item_title, amount FROM facts ORDER BY amount DESC, order_key, line_item LIMIT 30)
SELECT line_item_title, CAST(max(amount) AS DOUBLE) AS amount FROM t GROUP BY 1 ORDER BY max(amount) DESC, 1 LIMIT 10""", ["order_key", "line_item", "line_item_title", "amount"])  # fmt: skip
def _(df):
    top = df.orderBy(F.desc("amount"), "order_key", "line_item").limit(30)
    return top.groupBy("line_item_title").agg(F.max("amount").alias("a")).orderBy(F.desc("a"), "line_item_title").limit(10).select("line_item_title", S.money(F.col("a")).alias("amount"))


@on_facts("ag39_treemap", """
SELECT organization_name, appropriation_code, CAST(sum(amount) AS DOUBLE) AS total, round(100 * CAST(sum(amount) AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE)
FROM facts), 2) AS pct FROM facts GROUP BY 1, 2 ORDER BY sum(amount) DESC, 1, 2 LIMIT 200""", ["organization_name", "appropriation_code", "amount"])
def _(df):
    parts = df.groupBy("organization_name", "appropriation_code").agg(F.sum("amount").alias("s"))
    whole = parts.agg(S.money(F.sum("s")).alias("w"))  # one row
    out = parts.join(F.broadcast(whole)).orderBy(F.desc("s"), "organization_name", "appropriation_code").limit(200)
    return out.select("organization_name", "appropriation_code", S.money(F.col("s")).alias("total"), F.round(100 * S.money(F.col("s")) / F.col("w"), 2).alias("pct"))


_BEST = "first(amount ORDER BY CASE exhibit_type WHEN 'r2' THEN 1 WHEN 'p1' THEN 2 ELSE 3 END, fiscal_year DESC, order_key, line_item)"


@on_facts("ag40_consolidated_scalars", f" SELECT pe_number, CAST({_BEST} AS DOUBLE) AS best, CAST(sum(amount) AS DOUBLE) AS total, count(DISTINCT fiscal_year) AS n_years FROM facts GROUP BY 1", ["pe_number", "amount", "exhibit_type", "fiscal_year", "order_key", "line_item"])
def _(df):
    rank = F.when(F.col("exhibit_type") == "r2", 1).when(F.col("exhibit_type") == "p1", 2).otherwise(3)
    best = F.min_by("amount", F.struct(rank, -F.col("fiscal_year").cast("int"), "order_key", "line_item"))
    return df.groupBy("pe_number").agg(S.money(best).alias("best"), S.money(F.sum("amount")).alias("total"), F.countDistinct("fiscal_year").alias("n_years"))


@on_facts("ag41_unaccounted_funding", """, t AS (SELECT pe_number, fiscal_year, sum(amount) AS amount FROM facts GROUP BY 1, 2), p AS (SELECT pe_number, fiscal_year, sum(amount) AS s
FROM facts WHERE exhibit_type <> 'p1' GROUP BY 1, 2)
SELECT pe_number, fiscal_year, CAST(amount AS DOUBLE) AS amount, round(CAST(amount - coalesce(s, 0) AS DOUBLE), 1) AS unaccounted FROM t
LEFT JOIN p USING (pe_number, fiscal_year) WHERE round(CAST(amount - coalesce(s, 0) AS DOUBLE), 1) > 0.5""", ["pe_number", "fiscal_year", "amount", "exhibit_type"])  # fmt: skip
def _(df):
    totals = df.groupBy("pe_number", "fiscal_year").agg(F.sum("amount").alias("amount"))
    return S.unaccounted(totals, df.where("exhibit_type <> 'p1'"), ["pe_number", "fiscal_year"]).withColumn("amount", S.money(F.col("amount")))


@on_table("ag42_clamped_quantile", "events", """WITH h AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT event_type, round(least(12.0, greatest(5.0, quantile_cont(value, 0.95) * 1.5)), 4) AS timeout FROM h WHERE r <= 100 GROUP BY 1""")  # fmt: skip
def _(df):
    recent = df.withColumn("_r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))).where("_r <= 100")  # the history's bound
    return recent.groupBy("event_type").agg(F.round(F.least(F.lit(12.0), F.greatest(F.lit(5.0), F.percentile("value", 0.95) * 1.5)), 4).alias("timeout"))


@on_facts("ag16_top_changes", f""", g AS (SELECT pe_number, coalesce({ysum(LATEST)}, 0) AS l, coalesce({ysum(PREVIOUS)}, 0) AS p FROM facts
GROUP BY 1), c AS (SELECT pe_number, CAST(l - p AS DOUBLE) AS delta, CASE WHEN p = 0 THEN 'new' WHEN l = 0 THEN 'terminated' WHEN l > p THEN 'increase' WHEN l < p THEN 'decrease' ELSE 'flat' END AS kind
FROM g WHERE l <> 0 OR p <> 0)
SELECT * FROM (SELECT 'row' AS part, pe_number AS name, kind, delta FROM c WHERE delta <= -1000 ORDER BY delta, pe_number LIMIT 20) UNION ALL
SELECT 'count', kind, kind, CAST(count(*) AS DOUBLE) FROM c GROUP BY 2""", ["pe_number", "fiscal_year", "amount"])  # fmt: skip
def _(df):
    from ledgerspark.operators.aggregates import changes

    all_of_them = changes(df, ["pe_number"], LATEST, PREVIOUS)
    rows = all_of_them.where("delta <= -1000").orderBy("delta", "pe_number").limit(20)  # the filter comes before the limit
    counts = all_of_them.groupBy("change_type").agg(S.money(F.count("*")).alias("delta"))
    return rows.select(F.lit("row").alias("part"), F.col("pe_number").alias("name"), F.col("change_type").alias("kind"), "delta").unionByName(counts.select(F.lit("count").alias("part"), F.col("change_type").alias("name"), F.col("change_type").alias("kind"), "delta"))


# windows


@on_facts("wi02_latest_rows", """ SELECT pe_number, fiscal_year, order_key, line_item FROM facts QUALIFY row_number() OVER (PARTITION BY pe_number
ORDER BY fiscal_year DESC, order_key, line_item) = 1""", ["pe_number", "fiscal_year", "order_key", "line_item"])
def _(df):
    best = F.min_by(F.struct("fiscal_year", "order_key", "line_item"), F.struct(-F.col("fiscal_year").cast("int"), "order_key", "line_item"))
    return df.groupBy("pe_number").agg(best.alias("x")).select("pe_number", "x.*")


_TOP3 = "WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'assistant' THEN 0 ELSE 1 END, turn) AS r FROM conversations), j AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY r) AS t FROM r WHERE r <= 3 GROUP BY 1)"


@on_table("wi04_top_texts", "conversations", f"{_TOP3} SELECT conv_id, md5(CASE WHEN length(t) > 200 THEN substring(t, 1, 200) || '…' ELSE t END) AS digest FROM j")
def _(df):
    first = F.when(F.col("role") == "assistant", 0).otherwise(1)
    return S.top_texts(df, "conv_id", [first, F.asc("turn")], "text", 3, 200).select("conv_id", F.md5("text").alias("digest"))


@on_table("wi05_first_long_texts", "conversations", "SELECT conv_id, role, turn FROM conversations WHERE length(text) >= 20 QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1")
def _(df):
    return df.where(F.length("text") >= 20).groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))


_SUBMITTED = ["pe_number", "exhibit_type", "fiscal_year", "source_file", "amount"]


@on_facts("wi06_first_filled", """, s AS (SELECT pe_number, exhibit_type, fiscal_year, source_file, max(CASE WHEN amount > 30000 THEN amount END) AS a FROM facts GROUP BY 1, 2, 3, 4)
SELECT pe_number, exhibit_type, CAST(a AS DOUBLE) AS amount, source_file FROM s WHERE a IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY pe_number, exhibit_type ORDER BY fiscal_year DESC, source_file DESC) = 1""", _SUBMITTED)  # fmt: skip
def _(df):
    submissions = df.groupBy("pe_number", "exhibit_type", "fiscal_year", "source_file").agg(F.max(F.when(F.col("amount") > 30000, F.col("amount"))).alias("amount"))
    return S.first_filled(submissions, ["pe_number", "exhibit_type"], "fiscal_year", "amount", "source_file").withColumn("amount", S.money(F.col("amount")))


@on_facts("wi07_latest_submissions", """, s AS (SELECT pe_number, exhibit_type, fiscal_year, source_file, sum(amount) AS a FROM facts GROUP BY 1, 2, 3, 4)
SELECT pe_number, exhibit_type, fiscal_year, CAST(a AS DOUBLE) AS amount FROM s
QUALIFY row_number() OVER (PARTITION BY pe_number, exhibit_type, fiscal_year ORDER BY source_file DESC) = 1""", _SUBMITTED)  # fmt: skip
def _(df):
    submissions = df.groupBy(*_SUBMITTED[:4]).agg(F.sum("amount").alias("amount"))
    return submissions.groupBy("pe_number", "exhibit_type", "fiscal_year").agg(S.money(F.max_by("amount", "source_file")).alias("amount"))


@on_table("wi08_page_runs", "conversations", """SELECT conv_id, role, min(turn) AS page_start, max(turn) AS page_end, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations
GROUP BY 1, 2""")
def _(df):
    return S.page_runs(df.where("text IS NOT NULL"), ["conv_id", "role"], "turn", "text").select("conv_id", "role", "page_start", "page_end", F.md5("text").alias("digest"))


@on_facts("wi10_adjacent_changes", f"""
SELECT account, CAST({ysum(LATEST)} AS DOUBLE) AS latest, CAST({ysum(PREVIOUS)} AS DOUBLE) AS previous, CASE WHEN {ysum(PREVIOUS)} <> 0 THEN round((CAST({ysum(LATEST)} AS DOUBLE) - CAST({ysum(PREVIOUS)} AS DOUBLE)) / abs(CAST({ysum(PREVIOUS)} AS DOUBLE)) * 100, 2) END AS pct
FROM facts GROUP BY 1""", ["account", "fiscal_year", "amount"])
def _(df):
    wide = df.groupBy("account").agg(S.money(S.of_year(LATEST)).alias("latest"), S.money(S.of_year(PREVIOUS)).alias("previous"))
    return wide.withColumn("pct", change_percent(F.col("latest"), F.col("previous")))


# sorting and pages


@on_table("so01_allowed_orders", "orders", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 40")
def _(df):
    allowed = {"key": F.col("o_orderkey"), "priority": F.col("o_orderpriority")}
    return S.ordered(df, "priority", True, allowed, ["o_orderkey"]).limit(40).select("o_orderkey", "o_orderpriority")


@on_table("so02_page_with_total", "orders", """SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, 2 AS page, CAST(ceil((SELECT count(*)
FROM orders) / 50.0) AS INTEGER) AS page_count, (SELECT count(*) FROM orders) > 150 AS has_next FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100""")
def _(df):
    return S.page_of(df.select("o_orderkey"), [F.asc("o_orderkey")], 100, 50)


@on_table("so02_deep_pages", "orders", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 1000")
def _(df):
    """The fiftieth page from a sorted copy: the files that hold it are known by their numbers of rows."""
    folder = shared_folder(df.sparkSession, "orders-by-date")
    write_sorted(df.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], folder)
    return read_page(df.sparkSession, folder, ["o_orderdate", "o_orderkey"], 50, 20).select("o_orderkey", "o_orderdate")


@on_table("so03_has_more", "customer", "SELECT c_custkey, (SELECT count(*) FROM customer) > 30 AS has_more FROM customer ORDER BY c_custkey LIMIT 30")
def _(df):
    return S.with_more(df.select("c_custkey"), [F.asc("c_custkey")], 30)


@on_table("so05_capped_search", "documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') ORDER BY n_chars DESC, doc_id LIMIT 40")
def _(df):
    return df.where(contains_any(["text"], ["the"])).orderBy(F.desc("n_chars"), "doc_id").limit(40).select("doc_id")  # no cap before the order


@on_facts("so06_by_best_amount", """, w AS (SELECT account, sum(CASE WHEN fiscal_year = '2001' AND exhibit_type = 'r1' THEN amount END) AS request, sum(CASE WHEN fiscal_year = '2001' THEN amount END) AS enacted
FROM facts GROUP BY 1)
SELECT account, CAST(coalesce(request, enacted, 0) AS DOUBLE) AS amount FROM w ORDER BY coalesce(request, enacted, 0) DESC, 1 LIMIT 12""", ["account", "fiscal_year", "exhibit_type", "amount"])  # fmt: skip
def _(df):
    year = F.col("fiscal_year") == "2001"
    wide = df.groupBy("account").agg(F.sum(F.when(year & (F.col("exhibit_type") == "r1"), F.col("amount"))).alias("request"), F.sum(F.when(year, F.col("amount"))).alias("enacted"))
    best = wide.select("account", F.coalesce("request", "enacted", F.lit(0)).alias("amount")).orderBy(F.desc("amount"), "account").limit(12)
    return best.withColumn("amount", S.money(F.col("amount")))


@on_facts("so07_program_orders", " SELECT pe_number, line_item_title, CAST(sum(amount) AS DOUBLE) AS funding FROM facts GROUP BY 1, 2 ORDER BY line_item_title, pe_number LIMIT 30", ["pe_number", "line_item_title", "amount"])
def _(df):
    sums = df.groupBy("pe_number", "line_item_title").agg(S.money(F.sum("amount")).alias("funding"))
    return S.ordered(sums, "name", False, {"funding": F.col("funding"), "name": F.col("line_item_title")}, ["pe_number"]).limit(30)


@on_table("so08_prioritized", "part", """WITH u AS (SELECT 0 AS priority, 'brand' AS field, p_brand AS value FROM part WHERE starts_with(lower(p_brand), 'brand#2') UNION
SELECT 1, 'name', p_name FROM part WHERE contains(lower(p_name), 'blue'))
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY field, value ORDER BY priority) = 1 ORDER BY priority, field, value LIMIT 15""")  # fmt: skip
def _(df):
    brands = df.where(F.startswith(F.lower("p_brand"), F.lit("brand#2"))).select(F.lit(0).alias("priority"), F.lit("brand").alias("field"), F.col("p_brand").alias("value"))
    names = df.where(contains_any(["p_name"], ["blue"])).select(F.lit(1).alias("priority"), F.lit("name").alias("field"), F.col("p_name").alias("value"))
    best = brands.unionByName(names).groupBy("field", "value").agg(F.min("priority").alias("priority"))
    return best.orderBy("priority", "field", "value").limit(15)


@on_facts("so09_consolidated_orders", " SELECT pe_number, count(DISTINCT fiscal_year) AS n_years FROM facts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", ["pe_number", "fiscal_year", "amount"])
def _(df):
    allowed = {"program": F.col("pe_number"), "total": F.col("total"), "years": F.col("n_years")}
    sums = df.groupBy("pe_number").agg(S.money(F.sum("amount")).alias("total"), F.countDistinct("fiscal_year").alias("n_years"))
    return S.ordered(sums, "years", True, allowed, ["pe_number"]).limit(25).select("pe_number", "n_years")


# sets and subqueries


@on_table("se01_suggestions_of_four", "part", """SELECT DISTINCT field, value FROM (SELECT 'name' AS field, p_name AS value FROM part UNION ALL SELECT 'brand', p_brand FROM part UNION ALL
SELECT 'type', p_type FROM part UNION ALL SELECT 'size', CAST(p_size AS VARCHAR) FROM part) WHERE contains(lower(value), '2')""")
def _(df):
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value")) for f, c in (("name", "p_name"), ("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"))]))
    return df.select(each).where(contains_any(["value"], ["2"])).distinct()  # one scan for the four branches


@on_tables("se03_union_of_aggregates", "customer supplier", """SELECT 'customer' AS kind, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer UNION ALL
SELECT 'supplier', count(*), round(sum(s_acctbal), 2) FROM supplier""")
def _(customers, suppliers):
    one = lambda kind, df, c: df.agg(F.count("*").alias("n"), F.round(F.sum(c), 2).alias("balance")).select(F.lit(kind).alias("kind"), "n", "balance")
    return one("customer", customers, "c_acctbal").unionByName(one("supplier", suppliers, "s_acctbal"))


@on_facts("se04_set_algebra", """, a AS (SELECT DISTINCT pe_number FROM facts WHERE fiscal_year = '2001' AND quantity > 45), b AS (SELECT DISTINCT pe_number FROM facts
WHERE contains(line_item_title, 'ring'))
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION
SELECT * FROM b) UNION ALL SELECT 'first only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""", ["pe_number", "fiscal_year", "quantity", "line_item_title"])  # fmt: skip
def _(df):
    tests = df.groupBy("pe_number").agg(F.bool_or((F.col("fiscal_year") == "2001") & (F.col("quantity") > 45)).alias("a"), F.bool_or(F.contains("line_item_title", F.lit("ring"))).alias("b"))
    sizes = tests.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") | F.col("b")).alias("either"), F.count_if(F.col("a") & ~F.col("b")).alias("first only"))
    return sizes.unpivot([], ["both", "either", "first only"], "part", "n")


@on_facts("se06_key_union", """, a AS (SELECT account, sum(amount) AS x FROM facts WHERE exhibit_type = 'p1' GROUP BY 1), b AS (SELECT account, sum(amount) AS y FROM facts
WHERE exhibit_type = 'r1' AND account <> 'Brand#3' GROUP BY 1)
SELECT coalesce(a.account, b.account) AS account, CAST(coalesce(x, 0) - coalesce(y, 0) AS DOUBLE) AS apart FROM a FULL JOIN b ON a.account = b.account""", ["account", "exhibit_type", "amount"])  # fmt: skip
def _(df):
    side = lambda name, rows: rows.groupBy("account").agg(F.sum("amount").alias(name))
    both = side("x", df.where("exhibit_type = 'p1'")).join(side("y", df.where("exhibit_type = 'r1' AND account <> 'Brand#3'")), "account", "full_outer")
    return both.select("account", S.money(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))).alias("apart"))


@on_facts("sb01_common_table", """, b AS (SELECT * FROM facts WHERE fiscal_year = '2001') SELECT 'total' AS part, 'all' AS value, count(*) AS n FROM b UNION ALL
SELECT 'exhibit', exhibit_type, count(*) FROM b GROUP BY 2""", ["fiscal_year", "exhibit_type"])  # fmt: skip
def _(df):
    rows = df.where("fiscal_year = '2001'").groupBy("exhibit_type").agg(F.count("*").alias("n"))  # the total follows from the parts
    return rows.rollup("exhibit_type").agg(F.sum("n").alias("n"), F.grouping("exhibit_type").alias("g")).select(F.when(F.col("g") == 1, "total").otherwise("exhibit").alias("part"), F.when(F.col("g") == 1, "all").otherwise(F.col("exhibit_type")).alias("value"), "n")


@on_tables("sb02_scalar_subqueries", "documents labels", "SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM labels) AS n_labels, (SELECT max(n_chars) FROM documents) AS longest")
def _(docs, labels):
    return docs.agg(F.count("*").alias("n_documents"), F.max("n_chars").alias("longest")).join(labels.agg(F.count("*").alias("n_labels")))  # two one-row frames


@on_facts("sb03_top_one_each", """ SELECT pe_number, CAST(first(amount ORDER BY exhibit_type, fiscal_year DESC, order_key, line_item) AS DOUBLE) AS best, first(fiscal_year
ORDER BY exhibit_type, fiscal_year DESC, order_key, line_item) AS best_year, CAST(sum(amount) AS DOUBLE) AS total FROM facts GROUP BY 1""", ["pe_number", "amount", "exhibit_type", "fiscal_year", "order_key", "line_item"])  # fmt: skip
def _(df):
    best = F.min_by(F.struct("amount", "fiscal_year"), F.struct("exhibit_type", -F.col("fiscal_year").cast("int"), "order_key", "line_item"))
    out = df.groupBy("pe_number").agg(best.alias("b"), S.money(F.sum("amount")).alias("total"))
    return out.select("pe_number", S.money(F.col("b.amount")).alias("best"), F.col("b.fiscal_year").alias("best_year"), "total")


@on_tables("sb04_updated_from", "part lineitem", "SELECT p_partkey, coalesce((SELECT max(l_suppkey) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45), -1) AS supplier FROM part")
def _(parts, lines):
    found = lines.where("l_quantity > 45").groupBy("l_partkey").agg(F.max("l_suppkey").alias("s"))
    return parts.join(found, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("s", F.lit(-1)).alias("supplier"))
