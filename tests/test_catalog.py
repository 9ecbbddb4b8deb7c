"""Every registered query equals its DuckDB twin (small scale factor), and the driver contract holds."""

import pytest

import __spark_entry__ as entry_mod
from oracle_compare import compare, duck

NAMES = sorted(entry_mod.catalog.QUERIES)


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry_mod.oracle_sql())
    assert set(NAMES) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, small_dir, con, name):
    r = compare(spark, small_dir, name, con)
    assert r["cols_match"], r
    assert r["values_match"], r


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["rid", "t_epoch_s", "ts14", "id", "distance_ms"]
    assert df.count() > 0


PLAN_CHECKED = sorted(n for n in NAMES if n not in {
    "read_cdx", "read_cdx_auto", "ingest_report", "csv_file_round_trip", "stream_ingest", "batch_ingest", "store_versions",
    "stream_after_batch", "stream_compact_stream",
    "export_json"})


@pytest.mark.parametrize("name", PLAN_CHECKED)
def test_no_pairwise_plans(spark, small_dir, name):
    from capindex.plans.guards import physical_plan
    plan = physical_plan(entry_mod.queries()[name](spark, small_dir), "simple")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name  # no Python UDF on the hot path
