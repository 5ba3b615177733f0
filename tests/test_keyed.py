"""Multi-key isolation: a run over several (instance, collection time)
snapshots equals the union of single-snapshot runs."""

import datetime as dt

from pyspark.sql import functions as F

from dbpulse.plans import report
from dbpulse.plans.options import ReportOptions
from dbpulse.plans.queries_core import _REPORT_SOURCES
from dbpulse.sources.fixtures import fixture
from dbpulse.sources.snapshots import load_processes

from lake_paths import SF_SMOKE

T1 = dt.datetime(1998, 8, 3, 12, 0)
T2 = dt.datetime(1998, 8, 3, 12, 1)


def keyed(df, inst, t):
    return df.withColumn("instance_id", F.lit(inst)).withColumn("collection_time", F.lit(t).cast("timestamp_ntz"))


def sources(spark, snaps):
    base = {k: fixture(spark, SF_SMOKE, v) for k, v in _REPORT_SOURCES.items()}
    out = {}
    for k, df in base.items():
        parts = [keyed(df, i, t) for i, t in snaps]
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        out[k] = u
    return out


def test_report_keyed_equals_union_of_single_snapshots(spark):
    o = ReportOptions(get_task_info=2, find_block_leaders=True, get_transaction_info=True,
                      get_locks=True, get_outer_command=True, format_output=0,
                      output_column_list="[%]", sort_order="")
    snaps = [("a", T1), ("b", T1), ("a", T2)]
    together = report.activity_report(sources(spark, snaps), o, materialize=False)
    cols = [c for c in together.columns]
    got = sorted((tuple(r) for r in together.select(*cols).collect()), key=repr)
    want = []
    for i, t in snaps:
        one = report.activity_report(sources(spark, [(i, t)]), o, materialize=False)
        want += [tuple(r) for r in one.select(*cols).collect()]
    assert len(got) == len(want) > 0
    assert got == sorted(want, key=repr)
    assert "sql_command" in cols and any(r.sql_command for r in together.select("sql_command").collect())


def test_report_delta_over_two_snapshots(spark):
    o = ReportOptions(get_task_info=1, format_output=0, delta_interval=5,
                      output_column_list="[session_id][request_id][reads][reads_delta][collection_time]")
    df = report.activity_report(sources(spark, [("a", T1), ("a", T2)]), o, materialize=False)
    rows = df.collect()
    first = [r for r in rows if r.collection_time == T1]
    second = [r for r in rows if r.collection_time == T2]
    assert first and all(r.reads_delta is None for r in first)
    # identical counters in both snapshots: every valid delta is zero
    assert any(r.reads_delta == 0 for r in second)
    assert all(r.reads_delta in (0, None) for r in second)


def test_named_loader(spark, scratch):
    p = fixture(spark, SF_SMOKE, "fx_processes")
    keyed(p, "a", T1).write.parquet(f"{scratch}/processes")
    df = load_processes(spark, f"{scratch}/processes")
    assert df.count() == p.count() and "sql_handle" in df.columns


def test_report_latest_snapshot_only(spark):
    o = ReportOptions(get_task_info=1, format_output=0, delta_interval=5, latest_snapshot_only=True,
                      output_column_list="[session_id][reads_delta][collection_time]")
    df = report.activity_report(sources(spark, [("a", T1), ("a", T2), ("b", T1)]), o, materialize=False)
    times = {(r.instance_id, r.collection_time) for r in df.select("instance_id", "collection_time").distinct().collect()}
    assert times == {("a", T2), ("b", T1)}


def test_activity_stream_equals_batch(spark, scratch):
    import os
    from dbpulse.sources import history
    from dbpulse.streaming.activity import collect_activity_stream
    snaps = [("a", T1), ("b", T1), ("a", T2)]
    src = sources(spark, snaps)
    procs = src.pop("processes")
    pdir = os.path.join(scratch, "procs")
    for n, (i, t) in enumerate(snaps):
        (procs.filter((F.col("instance_id") == i) & (F.col("collection_time") == F.lit(t).cast("timestamp_ntz")))
         .coalesce(1).write.parquet(os.path.join(pdir, f"s{n}")))
    stream = (spark.readStream.schema(procs.schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(pdir, "*")))
    out = os.path.join(scratch, "hist")
    o = ReportOptions(get_task_info=1, find_block_leaders=True, format_output=0,
                      output_column_list="[%]", sort_order="")
    q = collect_activity_stream(stream, src, out, os.path.join(scratch, "ckpt"), options=o,
                                retention_days=None, trigger_seconds=None)
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(out).drop("_batch_id")
    batch = report.activity_report({**src, "processes": procs}, o, materialize=False)
    want = history._conform(batch.withColumn("elapsed_text", F.lit(None).cast("string"))
                            .withColumn("collection_date", F.to_date("collection_time")),
                            history.ACTIVITY_HISTORY_SCHEMA)
    cols = [c for c in want.columns if c != "elapsed_text"]
    g = sorted((tuple(r) for r in got.select(*cols).collect()), key=repr)
    w = sorted((tuple(r) for r in want.select(*cols).collect()), key=repr)
    assert len(g) == len(w) > 0 and g == w


def test_activity_stream_sees_files_written_after_the_start(spark, scratch):
    import os
    from dbpulse.sources import history
    from dbpulse.streaming.activity import collect_activity_stream
    snaps = [("a", T1), ("a", T2)]
    src = sources(spark, snaps)
    procs = src.pop("processes")
    src = {n: src[n] for n in ("sessions", "requests", "active_transactions", "database_transactions",
                                "session_transactions")}
    lake = os.path.join(scratch, "lake")

    def write(instance, time):
        """One snapshot, its processes last."""
        for name, df in [*src.items(), ("processes", procs)]:
            one = df.filter((F.col("instance_id") == instance) & (F.col("collection_time") == F.lit(time).cast("timestamp_ntz")))
            one.coalesce(1).write.mode("append").parquet(os.path.join(lake, name))

    def loader(name):
        return lambda s: s.read.schema(src[name].schema).parquet(os.path.join(lake, name))

    write(*snaps[0])
    stream = spark.readStream.schema(procs.schema).parquet(os.path.join(lake, "processes"))
    o = ReportOptions(get_task_info=0, get_transaction_info=True, format_output=0, output_column_list="[%]", sort_order="")
    out = os.path.join(scratch, "hist")
    q = collect_activity_stream(stream, {n: loader(n) for n in src}, out, os.path.join(scratch, "ckpt"), options=o,
                                retention_days=None, trigger_seconds=None)
    q.processAllAvailable()
    write(*snaps[1])
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(out).drop("_batch_id")
    batch = report.activity_report({**src, "processes": procs}, o, materialize=False)
    want = history._conform(batch.withColumn("collection_date", F.to_date("collection_time")),
                            history.ACTIVITY_HISTORY_SCHEMA)
    cols = [c for c in want.columns if c != "elapsed_text"]
    g = sorted((tuple(r) for r in got.select(*cols).collect()), key=repr)
    w = sorted((tuple(r) for r in want.select(*cols).collect()), key=repr)
    assert len(g) == len(w) > 0 and g == w
    late = got.filter(F.col("collection_time") == F.lit(T2).cast("timestamp_ntz"))
    assert late.filter("reads is not null").count() > 0 and late.filter("tran_start_time is not null").count() > 0


def test_sources_of_a_batch_are_pruned(spark, scratch):
    import os
    from dbpulse.sources.snapshots import snapshot_loaders
    from dbpulse.streaming.activity import sources_of_batch
    src = sources(spark, [("a", T1), ("a", T2)])
    load = snapshot_loaders(scratch, ["tasks", "locks"])
    src["tasks"].withColumn("collection_date", F.to_date("collection_time")).write.parquet(os.path.join(scratch, "tasks"))
    batch = src["processes"].filter(F.col("collection_time") == F.lit(T2).cast("timestamp_ntz"))
    got = sources_of_batch(batch, load)
    assert set(got) == {"tasks"}
    assert {r[0] for r in got["tasks"].select("collection_time").distinct().collect()} == {T2}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = got["tasks"].select("session_id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(collection_time" in plan and "LessThanOrEqual(collection_time" in plan
