"""The budget fact view over the star schema.

One row per line item; dimension tables are small and joined by Catalyst's choice (broadcast below
its threshold, sort-merge with skew handling above), and only the columns a query uses are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


COLUMNS = (
    "order_key fiscal_year organization_name office source_file exhibit_type appropriation_code budget_activity_title account "
    "line_item_title pe_number line_item amount quantity amount_type"
).split()
#: Which tables a column needs besides lineitem. A line has at most one order, customer, nation, region and part; one
#: that lacks them stays, with nulls, so the view's rows do not depend on the columns that are asked for.
NEEDS = {
    "organization_name": {"customer", "nation", "region"},
    "office": {"customer", "nation"},
    "source_file": {"customer", "nation"},
    "appropriation_code": {"customer"},
    "budget_activity_title": {"part"},
    "account": {"part"},
    "line_item_title": {"part"},
}


def _own() -> dict[str, Column]:
    """Columns that lineitem has by itself."""
    return {
        "order_key": F.col("l_orderkey"),
        "fiscal_year": F.year("l_shipdate").cast("string"),
        "exhibit_type": F.when(F.col("l_returnflag") == "A", "p1").when(F.col("l_returnflag") == "N", "r1").otherwise("r2"),
        "pe_number": F.concat(F.lpad(F.col("l_partkey").cast("string"), 7, "0"), F.lit("A")),
        "line_item": F.col("l_linenumber").cast("string"),
        "amount": F.col("l_extendedprice").cast("decimal(18,2)"),
        "quantity": F.col("l_quantity").cast("decimal(18,2)"),
        "amount_type": F.col("l_linestatus"),
    }


def _others(year: Column) -> dict[str, Column]:
    """Columns of the other tables."""
    return {
        "organization_name": F.col("r_name"),
        "office": F.col("n_name"),
        "source_file": F.concat(F.lit("FY"), year, F.lit("/"), "n_name", F.lit(".xlsx")),
        "appropriation_code": F.col("c_mktsegment"),
        "budget_activity_title": F.col("p_type"),
        "account": F.col("p_brand"),
        "line_item_title": F.col("p_name"),
    }


def _joined(spark: SparkSession, sf_dir: str, rows: DataFrame, columns: list[str], order_key: str, part_key: str) -> DataFrame:
    """Rows with the tables behind these columns, by the names of their keys of orders and parts."""
    t = lambda name: read(spark, sf_dir, name)
    needed = set().union(*(NEEDS.get(c, set()) for c in columns))
    if "customer" in needed:
        customers = t("customer")
        if "nation" in needed:
            customers = customers.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        if "region" in needed:
            customers = customers.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        orders = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        rows = rows.join(orders, F.col(order_key) == F.col("o_orderkey"), "left")
    if "part" in needed:
        rows = rows.join(t("part"), F.col(part_key) == F.col("p_partkey"), "left")
    return rows


def facts(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The view, or only some of its columns: then only the tables behind those are joined."""
    columns = columns or COLUMNS
    own = _own()
    every = own | _others(own["fiscal_year"])
    rows = _joined(spark, sf_dir, read(spark, sf_dir, "lineitem"), columns, "l_orderkey", "l_partkey")
    return rows.select(*[every[c].alias(c) for c in columns])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's columns that lineitem has by itself, and the part's key: to be grouped or picked before they meet other tables."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_key"), *[c.alias(name) for name, c in _own().items()])


def described(spark: SparkSession, sf_dir: str, rows: DataFrame, columns: list[str]) -> DataFrame:
    """What was made of lines, with these columns of other tables; it must keep the keys that they rest on (order_key, part_key, and fiscal_year for source_file)."""
    others = _others(F.col("fiscal_year"))
    return _joined(spark, sf_dir, rows, columns, "order_key", "part_key").select(*rows.columns, *[others[c].alias(c) for c in columns])


#: The same view for the SQL check.
FACTS_SQL = """facts AS (
  SELECT l_orderkey AS order_key, CAST(year(l_shipdate) AS VARCHAR) AS fiscal_year, r_name AS organization_name, n_name AS office,
    'FY' || CAST(year(l_shipdate) AS VARCHAR) || '/' || n_name || '.xlsx' AS source_file,
    CASE l_returnflag WHEN 'A' THEN 'p1' WHEN 'N' THEN 'r1' ELSE 'r2' END AS exhibit_type,
    c_mktsegment AS appropriation_code, p_type AS budget_activity_title, p_brand AS account, p_name AS line_item_title,
    lpad(CAST(l_partkey AS VARCHAR), 7, '0') || 'A' AS pe_number, CAST(l_linenumber AS VARCHAR) AS line_item,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, l_linestatus AS amount_type
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey)"""
