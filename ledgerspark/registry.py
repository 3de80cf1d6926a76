"""The registered queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.plans.facts import COLUMNS, FACTS_SQL, described, facts, lines, read

LATEST, PREVIOUS = "2001", "2000"
YEARS = ["1998", "1999", "2000", "2001"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _named(sql: str | None) -> list[str] | None:
    return [c for c in COLUMNS if re.search(rf"\b{c}\b", sql)] if sql else None


def on_facts(name: str, sql: str | None = None, columns: list[str] | None = None):
    """Register a query of the fact view; its SQL continues after `WITH facts AS (...)`.

    columns: those it uses, so that only their tables are joined; by default those that its SQL names. The view has
    the same rows whatever its columns are.
    """
    columns = columns or _named(sql)

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(facts(spark, sf_dir, columns))
        if sql:
            ORACLES[name] = f"WITH {FACTS_SQL}{sql}"
        return f

    return add


def on_table(name: str, table: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(read(spark, sf_dir, table))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def on_tables(name: str, tables: str, sql: str | None = None, columns: list[str] | None = None):
    """Register a query of several tables, passed in this order. `facts` is the fact view with these columns; `lines` has
    only those of a line itself, and `described` adds columns of other tables to what was made of them."""
    columns = columns or _named(sql)
    views = {"facts": lambda spark, sf_dir: facts(spark, sf_dir, columns), "lines": lines, "described": lambda spark, sf_dir: partial(described, spark, sf_dir)}

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[views[t](spark, sf_dir) if t in views else read(spark, sf_dir, t) for t in tables.split()])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = f"WITH {FACTS_SQL}{sql}" if views.keys() & set(tables.split()) else sql
        return f

    return add


def ysum(year: str) -> str:
    return f"sum(CASE WHEN fiscal_year = '{year}' THEN amount END)"
