"""Plan shape: no cartesian products or row-at-a-time Python in the
registered batch queries, windows always partitioned, pushdown reaches
the scan."""

import pytest

import __spark_entry__ as E
from dbpulse.plans import catalog

from lake_paths import SF_SMOKE

catalog.load_all()
QUERIES = catalog.QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_python(spark, name):
    p = plan(QUERIES[name](spark, SF_SMOKE))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_pareto_single_exchange_after_aggregate(spark):
    p = E.queries()["a6_wait_pareto"](spark, SF_SMOKE)._jdf.queryExecution().executedPlan().toString()
    # one exchange for the fixture's GROUP BY, one for the window partitioning
    assert p.count("Exchange hashpartitioning") == 2
    assert "SinglePartition" not in p


def test_filter_and_columns_pushed_to_scan(spark):
    df = E.queries()["k7_retention"](spark, SF_SMOKE)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in p and "ts" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in p


def test_windows_refuse_empty_keys(spark):
    from dbpulse.operators.delta import counter_usage, with_previous_snapshot_time
    from dbpulse.operators.waits import wait_pareto
    df = spark.createDataFrame([("a", "W", 1, 0, 1)], "instance_id string, wait_type string, "
                               "wait_time_ms bigint, signal_wait_time_ms bigint, waiting_tasks_count bigint")
    for call in (lambda: wait_pareto(df, keys=[]),
                 lambda: with_previous_snapshot_time(df, []),
                 lambda: counter_usage(df, [], ["wait_time_ms"])):
        with pytest.raises(ValueError):
            call()


def _bracket_groups(text: str) -> list[str]:
    groups, depth, start = [], 0, None
    for i, ch in enumerate(text):
        if ch == "[":
            if depth == 0:
                start = i + 1
            depth += 1
        elif ch == "]":
            depth -= 1
            if depth == 0:
                groups.append(text[start:i])
                if not text[i + 1:].startswith(", ["):
                    break
    return groups


def unpartitioned_windows(plan_text: str) -> list[str]:
    """Physical Window lines print ``[exprs], [partition], [order]`` and
    leave out an empty partition list: a window whose second group is an
    ordering (or that has no second group) runs in one task."""
    bad = []
    for ln in plan_text.split("\n"):
        k = ln.find("Window [")
        if k < 0:
            continue
        g = _bracket_groups(ln[k + len("Window "):])
        ordered = len(g) == 2 and all(" ASC NULLS " in x or " DESC NULLS " in x
                                      for x in g[1].split(", ") if x)
        if len(g) == 1 or ordered:
            bad.append(ln.strip()[:160])
    return bad


def test_detector_catches_unpartitioned_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    cases = {"order only": (Window.orderBy("id"), True), "none": (Window.partitionBy(), True),
             "partition": (Window.partitionBy(F.col("id") % 2), False),
             "partition and order": (Window.partitionBy(F.col("id") % 2).orderBy("id"), False)}
    for label, (w, expect_bad) in cases.items():
        df = spark.range(10).withColumn("r", F.max("id").over(w))
        df.write.format("noop").mode("overwrite").save()
        assert bool(unpartitioned_windows(plan(df))) == expect_bad, label


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_unpartitioned_window(spark, name):
    df = QUERIES[name](spark, SF_SMOKE)
    df.write.format("noop").mode("overwrite").save()   # final (AQE) plan
    bad = unpartitioned_windows(plan(df))
    assert not bad, bad


def test_lock_document_sorts_without_a_lambda(spark):
    # array_sort compares elements by an interpreted lambda, and every object had its locks collected twice
    from dbpulse.operators import locks
    from dbpulse.sources.fixtures import fixture
    fx = lambda n: fixture(spark, SF_SMOKE, "fx_catalog_" + n)
    named = locks.name_locks(locks.lock_counts(fixture(spark, SF_SMOKE, "fx_locks")), fx("allocation_units"), fx("partitions"),
                             fx("objects"), fx("indexes"), fx("schemas"), fx("principals"))
    text = locks.lock_document(named)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in text and "sort_array" in text
