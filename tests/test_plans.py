"""Plan regressions: the shapes PLANS.md describes stay that way."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
GOLD = [k for k in E.queries() if k.startswith("run_gold_")]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", GOLD)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_text_jobs_read_only_needed_columns(spark):
    for name, width in (("classify", 2), ("extract_sql", 1), ("map_types", 1)):
        plan = _plan(E.queries()[name](spark, SF))
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
        assert schemas and all(len(s.split(",")) <= width for s in schemas), (name, schemas)
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_fk_check_reads_keys_only(spark):
    plan = _plan(E.queries()["fk_check"](spark, SF))
    for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert len(s.split(",")) == 1, s
    assert "partial_count" in plan
