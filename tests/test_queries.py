"""Every budget query against its SQL on the smallest tables."""

import duckdb
import pytest

from ledgerspark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns, order):
    index = [columns.index(c) for c in order]
    value = lambda v: None if v is None else round(float(v), 3) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(value(r[i]) for i in index) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, sql, name):
    out = QUERIES[name](spark, SF)
    want = sql.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(out.columns)
    order = sorted(columns)
    assert plain(out.collect(), out.columns, order) == plain(want.fetchall(), columns, order)
