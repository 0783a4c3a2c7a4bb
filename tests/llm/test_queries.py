"""Every query of the package on the smallest driver tables: against its DuckDB form, or for rows and columns."""

import os

import pytest

from quarry.llm.queries import oracle_sql, queries
from tools.check_oracles import TABLES, digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
ROWS = {"op10_warc": "pages", "op6_url_rules": "pages"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name != "op8_passages":  # one row per passage, not per document
        assert len(rows) == duck.execute(f"SELECT count(*) FROM {ROWS.get(name, 'documents')}").fetchall()[0][0]
    sql = oracle_sql().get(name)
    if sql is not None:
        cur = duck.execute(sql)
        names, want = [c[0] for c in cur.description], cur.fetchall()
        assert sorted(df.columns) == sorted(names)
        assert digest(df.columns, rows)[0] == digest(names, want)[0]


def test_registered_in_the_entry():
    import __spark_entry__

    assert set(queries()) | {"pipeline"} <= set(__spark_entry__.queries())
