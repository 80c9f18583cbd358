"""Work on rows of few bytes is dealt to tasks by the number of rows."""

import pytest

from shelfwise.plans import aggregates, joins, streams
from shelfwise.sources import catalog


@pytest.mark.parametrize("query", [joins.asof_time, joins.byte_to_fragment, joins.keyframe_and_next, aggregates.clock_durations, streams.fragment_index])
def test_tasks_grow_with_the_rows(spark, monkeypatch, query):
    monkeypatch.setattr(catalog, "ROWS", 300, raising=False)
    lib = catalog.Library(spark, "/root/testdata/sf0.001")
    tasks = lib.raw("lineitem").count() // 300 + 1
    plan = query(lib)._jdf.queryExecution().executedPlan().toString()
    assert tasks > 16 and f", {tasks})" in plan and ", 4), ENSURE" not in plan
