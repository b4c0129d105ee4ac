"""The queries of the problems with SQL against DuckDB on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

from kinfold.llm.queries import QUERIES, SQL

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="the test tables aren't there")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in FOLDER.iterdir():
        con.execute(f"create view {path.name.split('.')[0]} as select * from '{path}'")
    found = QUERIES[name](spark, str(FOLDER))
    columns = sorted(found.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in found.select(*columns).collect()) == Counter(expected)


def test_columns(spark):
    if not FOLDER.exists():
        pytest.skip("the test tables aren't there")
    assert QUERIES["p8_found"](spark, str(FOLDER)).columns == ["doc_id", "item_id"]
    assert QUERIES["p9_found"](spark, str(FOLDER)).columns == ["doc_id"]
