"""The queries over the part chains of all orders: none of lineitem's orders is left out."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__
from wayloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def edges():
    """Brute force over the whole table."""
    lines = duckdb.sql(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM '{SF}/lineitem.parquet'").fetchall()
    lines.sort()
    return {(a[2] + 1, b[2] + 1) for a, b in zip(lines, lines[1:], strict=False) if a[0] == b[0]}


def reach(edges, start):
    near, found = {}, {start}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    todo = [start]
    while todo:
        new = set(near.get(todo.pop(), [])) - found
        found |= new
        todo += new
    return found


def test_no_query_leaves_rows_out():
    assert not [q for q, sql in catalogue.ORACLE.items() if " % 20" in sql or "l_quantity" in sql or "event_type" in sql]


def test_all_orders(spark, edges):
    ids = {x for e in edges for x in e}
    assert {tuple(r) for r in catalogue.QUERIES["q_edges"](spark, SF).select("src", "dst").collect()} == edges
    assert sum(r["n"] for r in __spark_entry__.entry(spark).collect()) == len(ids)


def test_components_of_all_orders(spark, edges):
    ids, back = {x for e in edges for x in e}, {(b, a) for a, b in edges}
    weak = {i: min(reach(edges | back, i)) for i in ids}
    strong = {i: min(reach(edges, i) & reach(back, i)) for i in ids}
    for q, want in (("q_wcc", weak), ("q_scc", strong)):
        assert {r["id"]: r["comp"] for r in catalogue.QUERIES[q](spark, SF).collect()} == want
