"""Filters, sorting and pages of fact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.expressions import all_of

#: Exhibits that sum up others.
SUMMARY_EXHIBITS = ["c1", "m1", "o1", "p1", "p1r", "r1", "rf1"]
FILTERED = ["fiscal_year", "organization_name", "exhibit_type", "pe_number", "appropriation_code", "account"]


def where_lines(df: DataFrame, least=None, most=None, ids: list | None = None, id_column: str = "order_key", **lists: list | None) -> DataFrame:
    """Lists per column are ANDed; None or empty lists filter nothing, but an empty id list keeps no row."""
    unknown = set(lists) - set(FILTERED)
    if unknown:
        raise ValueError(f"no filter on {sorted(unknown)}")
    conditions: list[Column] = [F.col(c).isin(v) for c, v in lists.items() if v]
    if least is not None:
        conditions.append(F.col("amount") >= least)
    if most is not None:
        conditions.append(F.col("amount") <= most)
    if ids is not None:
        conditions.append(F.col(id_column).isin(ids) if ids else F.lit(False))
    return df.where(all_of(conditions))


def without_summaries(df: DataFrame) -> DataFrame:
    return df.where(~F.col("exhibit_type").isin(SUMMARY_EXHIBITS))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of rows by a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)
