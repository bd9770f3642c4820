"""Registered graph queries against their oracle SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from wayloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUICK = "vertices edges counts deg3 classes class_histo neighbourhood sources sinks histo1_in_out histo3 transpose delete_vertices delete_edges add_chain relabel rotate join_merge frontiers_weak wcc scc condensation partition_index forest_preorder linears gkey contract_nodes edge_pairs gen_grid2d gen_wheel forest_postorder linear dense one_vertex membership own_control own_visitor walk_forest read_adj read_dot dot_attributes dot_lines dot_pairs partition_colours read_deps bad_elements repository_add repository_query tree_root cyclic cyclic_tree connected".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, con, name):
    want = con.execute(catalogue.ORACLE[f"q_{name}"])
    columns = sorted(x[0] for x in want.description)
    order = [[x[0] for x in want.description].index(c) for c in columns]
    got = catalogue.QUERIES[f"q_{name}"](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=str)


def test_entry_without_training_data_operators(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry.__doc__
