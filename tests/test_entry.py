"""The driver's contract at the smallest scale: queries agree with their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from postmill.plans import queries as Q

DATA = "/root/testdata/sf0.001"
CHECKED = ["stg_union_canonical", "gold_fct", "quality_flags", "dedup_first_by_fp", "late_run_lookup", "salary_parse_py", "column_profile", "frontier_bfs", "key_union", "page_details", "page_nested", "page_seeds", "dedup_chain", "crawl_scan", "layer_counts", "load_check", "load_failures", "reports_by_run", "ordered_distinct", "id_set_diff", "latest_run_scan", "nested_lists", "committed_runs", "run_changes", "first_writer_stream", "tests_surrogate", "view_counts"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = Q.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    found = con.execute(Q.ORACLES[name])
    columns = [d[0] for d in found.description]
    place = [columns.index(c) for c in df.columns]
    near = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    assert sorted(map(near, rows), key=str) == sorted((near(r[i] for i in place) for r in found.fetchall()), key=str)


def test_contract():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(Q.ORACLES) <= set(Q.QUERIES)


def test_entry(spark, con):
    assert entry_module.entry(spark).count() > 0
