"""Plan guards: no registered query uses a cross product or a nested-loop
join, and scans read only the columns they need."""

import __spark_entry__ as entry

from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_or_nested_loop_joins(spark):
    bad = {}
    for name, fn in entry.queries().items():
        plan = _plan(fn(spark, SF_SMALL))
        hits = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_scan_prunes_columns(spark):
    plan = _plan(entry.queries()["fold_labels"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan
