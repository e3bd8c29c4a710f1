import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import rows_of, views

QUICK = [
    "p1_found", "p2_found", "agg_file_summary", "agg_impacted_symbols", "rec_transitive_callers", "set_blast_files", "fo_packages", "top_functions", "lb_risk_file", "sr_find_symbols", "sr_text", "anti_refs", "win_evidence_top3",
    "vw_symbol_history", "agg_cochange_package", "agg_dir_rollup", "fn_count_lines", "flt_minified", "snk_copy_forward", "inc_detect", "agg_counts",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    views(c, sf)
    return c


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "bench.py"))


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_filters_reach_the_scan(spark, sf):
    df = entry.queries()["jn_callers"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(snapshot_id" in plan
    assert "CartesianProduct" not in plan
