"""Every core query with SQL against DuckDB on the smallest tables, and the entry points."""

import ast
import math
import random
from collections import Counter
from pathlib import Path

import pytest

from kinfold.plans import registry

FOLDER = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not FOLDER.exists(), reason="the test tables aren't there")


def _rows(rows):
    return Counter(tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in FOLDER.iterdir():
        con.execute(f"create view {path.name.split('.')[0]} as select * from '{path}'")
    return con


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, str(FOLDER))
    columns = sorted(found.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = duck.execute(f"select {quoted} from ({registry.oracle_sql()[name]})").fetchall()
    assert _rows(tuple(r) for r in found.select(*columns).collect()) == _rows(expected)


@pytest.mark.parametrize("name", ["moved_together", "removed_together"])
def test_pairs_of_parts_on_odd_orders_equal_sql(spark, tmp_path, name):
    """Orders of one line at different times, so the SQL leaves no tie open: no dates, no parts, parts of seconds at the gap."""
    import duckdb

    rng, con, gap = random.Random(14), duckdb.connect(), 90 * 86400 if name == "moved_together" else 20 * 86400
    times = {k: None if rng.random() < 0.1 else (k // 3 * gap - 40 * gap) * 1_000_000 + rng.choice([0, 400_000, 500_000, 1_500_000, 600_000]) for k in range(240)}
    con.execute("create table orders (o_orderkey bigint, o_custkey bigint, o_orderdate timestamp)")
    con.execute("create table lineitem (l_orderkey bigint, l_suppkey bigint, l_partkey bigint, l_returnflag varchar)")
    con.executemany("insert into orders select ?, ?, make_timestamp(?)", [(k, k % 3, t) for k, t in times.items()])
    con.executemany("insert into lineitem values (?, 1, ?, 'R')", [(k, None if rng.random() < 0.2 else rng.randrange(60)) for k in times])
    for t in ("orders", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    found = registry.queries()[name](spark, str(tmp_path))
    columns = sorted(found.columns)
    expected = _rows(con.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall())
    assert _rows(tuple(r) for r in found.select(*columns).collect()) == expected and expected


def test_all_pairs_of_parts_of_large_sessions(spark, tmp_path):
    """1,400 lines in one session and 600 in each of two, which once were cut to 1,000 and 500. Orders of one line at different times, so the SQL leaves no tie open."""
    import duckdb

    rng, con, day = random.Random(15), duckdb.connect(), 86400
    # (customer, day) of each order: customer 1 has one session, 2 has two at a pause of 91 days
    orders = [(1, d) for d in range(1400)] + [(2, d) for d in range(600)] + [(2, 690 + d) for d in range(600)]
    lines = [(k, rng.randrange(60), rng.randrange(900)) for k in range(len(orders))]
    con.execute("create table orders (o_orderkey bigint, o_custkey bigint, o_orderdate timestamp)")
    con.execute("create table lineitem (l_orderkey bigint, l_suppkey bigint, l_partkey bigint, l_returnflag varchar)")
    con.executemany("insert into orders select ?, ?, make_timestamp(?)", [(k, c, d * day * 1_000_000) for k, (c, d) in enumerate(orders)])
    con.executemany("insert into lineitem values (?, ?, ?, 'N')", lines)
    for t in ("orders", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    items = {}
    for k, supp, part in lines:
        start = 690 * day if orders[k][0] == 2 and orders[k][1] >= 690 else 0
        items.setdefault((str(orders[k][0]), start, str(supp)), set()).add(str(part))
    expected = Counter((*by, a, b) for by, own in items.items() for a in own for b in own if a < b)
    columns = ["custkey", "session_start", "target", "a", "b"]
    found = registry.queries()["moved_together"](spark, str(tmp_path)).select(*columns).collect()
    assert _rows(tuple(r) for r in found) == expected
    assert _rows(con.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()['moved_together']})").fetchall()) == expected


def test_entry_points():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(registry.queries()) <= set(queries)
    assert {"p2_found", "p3_found", "p6_found"} <= set(sql)


def _imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield from (f"{node.module}.{a.name}" for a in node.names)


def test_nothing_outside_llm_imports_it():
    root = Path(__file__).resolve().parents[1] / "kinfold"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not [m for m in _imported(path) if "llm" in m.split(".")], path
