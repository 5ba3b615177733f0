import datetime as dt
import os

from pyspark.sql import functions as F

from dbpulse.plans import jobs
from dbpulse.plans.queries_core import report_sources
from dbpulse.sources.fixtures import fixture

from lake_paths import SF_SMOKE


def test_wait_rollup_job_idempotent_with_retention(spark, scratch):
    path = os.path.join(scratch, "waits")
    w = fixture(spark, SF_SMOKE, "fx_waits")
    first = jobs.wait_rollup_job(spark, w, path, dt.datetime(2024, 1, 1, 23, 59)).count()
    again = jobs.wait_rollup_job(spark, w, path, dt.datetime(2024, 1, 1, 23, 59)).count()
    assert first == again > 0
    nxt = jobs.wait_rollup_job(spark, w, path, dt.datetime(2024, 1, 2, 23, 59)).count()
    assert nxt == 2 * first
    late = jobs.wait_rollup_job(spark, w, path, dt.datetime(2024, 2, 15, 23, 59))
    assert late.select(F.min("collection_date")).first()[0] == dt.date(2024, 2, 15)


def test_activity_collection_job(spark, scratch):
    path = os.path.join(scratch, "activity")
    out = jobs.activity_collection_job(spark, report_sources(spark, SF_SMOKE), path,
                                       dt.datetime(1998, 8, 3, 12, 0))
    rows = out.collect()
    assert len(rows) > 0
    assert all(r.session_id is not None and r.status is not None for r in rows)
    assert rows[0].elapsed_text is not None


def test_activity_collection_job_rerun_does_not_duplicate(spark, scratch):
    path = os.path.join(scratch, "activity2")
    src = report_sources(spark, SF_SMOKE)
    t = dt.datetime(1998, 8, 3, 12, 0)
    n1 = jobs.activity_collection_job(spark, src, path, t).count()
    n2 = jobs.activity_collection_job(spark, src, path, t).count()
    assert n1 == n2 > 0


def test_wait_rollup_takes_the_latest_snapshot(spark, scratch):
    rows = [("a", dt.datetime(2024, 1, 1), "W1", 400, 0, 4), ("a", dt.datetime(2024, 1, 2), "W1", 800, 0, 8),
            ("a", dt.datetime(2024, 1, 2), "W2", 200, 0, 2), ("a", dt.datetime(2024, 1, 9), "W1", 9000, 0, 9)]
    w = spark.createDataFrame(rows, "instance_id string, collection_time timestamp_ntz, wait_type string, "
                                    "wait_time_ms bigint, signal_wait_time_ms bigint, waiting_tasks_count bigint")
    out = jobs.wait_rollup_job(spark, w, os.path.join(scratch, "w"), dt.datetime(2024, 1, 2, 23, 59)).collect()
    assert sorted((r.wait_type, float(r.wait_percent)) for r in out) == [("W1", 80.0), ("W2", 20.0)]


def test_activity_job_takes_one_snapshot(spark, scratch):
    from test_keyed import T1, T2, sources
    src = sources(spark, [("a", T1), ("a", T2)])
    at = lambda t: jobs.activity_collection_job(spark, src, os.path.join(scratch, f"a{t.minute}"), t)
    both, first = at(T2), at(T1)
    assert {r[0] for r in both.select("collection_time").distinct().collect()} == {T2}
    assert {r[0] for r in first.select("collection_time").distinct().collect()} == {T1}
    assert both.count() == first.count() > 0
