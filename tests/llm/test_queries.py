"""Registered queries against their SQL twins, the entry module's contract, and native plans."""

import pytest

import __spark_entry__ as entry
from capindex.llm.queries import ORACLE, QUERIES
from oracle_compare import duck, rows_of


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    res = duck(small_dir).execute(ORACLE[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, res.fetchall())


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1


@pytest.mark.parametrize("name", ["op1_pii", "op2_quality", "op3_sharding", "op4_decontamination", "op7_chat"])
def test_native_plans_have_no_python(spark, small_dir, name):
    plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian", "BroadcastNestedLoop"))
