import pytest
from pyspark.sql import functions as F

from dbpulse.plans import report
from dbpulse.plans.options import ReportOptions
from dbpulse.sources.history import result_schema_ddl

from lake_paths import SF_SMOKE


def test_select_columns_default_and_patterns():
    o = ReportOptions(get_task_info=1, format_output=1)
    cols = report.select_columns(o.output_column_list, o)
    assert cols[:3] == ["dd hh:mm:ss.mss", "session_id", "sql_text"]
    assert "tasks" not in cols and "locks" not in cols       # gated off
    assert cols[-1] == "collection_time" and len(cols) == len(set(cols))
    assert report.select_columns("[session_id][CPU%]", o) == ["session_id", "CPU"]
    assert report.select_columns("[%delta]", ReportOptions(delta_interval=5)) == [
        "reads_delta", "physical_reads_delta", "writes_delta", "tempdb_allocations_delta",
        "tempdb_current_delta", "CPU_delta", "used_memory_delta"]
    with pytest.raises(ValueError):
        report.select_columns("[nothing_like_this]", o)


def test_sort_spec():
    assert report.sort_spec("[start_time] ASC") == [("start_time", True)]
    assert report.sort_spec("[CPU] desc, [session_id]") == [("CPU", False), ("session_id", True)]
    assert report.sort_spec("[reads] desc [reads] asc") == [("reads", False)]
    assert report.sort_spec("[bogus]") == []


def test_result_schema(spark):
    df = spark.range(1).select(F.col("id").alias("session_id"), F.lit("x").alias("status"))
    ddl = result_schema_ddl(df, "dbo.ActivityHistory")
    assert ddl.startswith("CREATE TABLE dbo.ActivityHistory ( `session_id` BIGINT NOT NULL")


def test_activity_report_runs(spark):
    from dbpulse.plans.queries_core import REPORT_OPTIONS, report_sources
    df = report.activity_report(report_sources(spark, SF_SMOKE), REPORT_OPTIONS,
                                as_of=F.lit("1998-08-03 12:00:00").cast("timestamp_ntz"))
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "dd hh:mm:ss.mss" and "blocked_session_count" in df.columns
    counts = [int(r.blocked_session_count.replace(",", "")) for r in rows if r.blocked_session_count]
    assert counts == sorted(counts, reverse=True)


def test_live_plan_preferred_only_while_request_unchanged(spark):
    from dbpulse.operators.statements import with_query_plan
    rows = spark.createDataFrame([(1, 0, 7, 0, 30), (2, 0, 8, 0, 30)],
                                 "session_id bigint, request_id bigint, plan_handle bigint, "
                                 "statement_start_offset bigint, statement_end_offset bigint")
    plans = spark.createDataFrame([(7, 0, 30, "cached7"), (8, 0, 30, "cached8"), (8, 0, -1, "batch8")],
                                  "plan_handle bigint, statement_start_offset bigint, "
                                  "statement_end_offset bigint, query_plan string")
    live = spark.createDataFrame([(1, "live1"), (2, "live2")], "session_id bigint, query_plan string")
    # session 2's request moved on to another statement: its live plan is stale
    reqs = spark.createDataFrame([(1, 0, 7, 0, 30), (2, 0, 8, 60, 90)],
                                 "session_id bigint, request_id bigint, plan_handle bigint, "
                                 "statement_start_offset bigint, statement_end_offset bigint")
    got = {r.session_id: r.query_plan for r in with_query_plan(rows, plans, 1, live, reqs).collect()}
    assert got == {1: "live1", 2: "cached8"}
    got2 = {r.session_id: r.query_plan for r in with_query_plan(rows, plans, 2).collect()}
    assert got2 == {1: None, 2: "batch8"}


def test_options_validation():
    for bad in (dict(show_sleeping_spids=3), dict(get_task_info=5), dict(format_output=9),
                dict(delta_interval=300), dict(filter_type="nope"), dict(get_plans=4)):
        with pytest.raises(ValueError):
            ReportOptions(**bad)


def test_report_schema_ddl_follows_options(spark):
    from dbpulse.plans.queries_core import report_sources
    src = {k: v for k, v in report_sources(spark, SF_SMOKE).items()
           if k in ("processes", "sessions", "requests")}
    o = ReportOptions(format_output=0, get_task_info=1, output_column_list="[session_id][wait_info][reads]")
    ddl = report.report_schema(src, o, "hist")
    assert ddl.startswith("CREATE TABLE hist ( `session_id` BIGINT")
    assert "`wait_info` STRING" in ddl and "`reads` BIGINT" in ddl and "tasks" not in ddl


def test_positions_are_one_order_over_all_partitions(spark):
    import random
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice(["x", "y", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "session_id bigint, reads bigint, host_name string").repartition(7)
    got = report.sort_positions(df, "[reads] desc[host%]", ["session_id"]).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is not None, r[2] or "", r[0]))
    assert [(r.session_id, r.position) for r in sorted(got, key=lambda r: r.position)] == [
        (r[0], n) for n, r in enumerate(want, 1)]
    assert report.sort_positions(df.limit(0), "", ["session_id"]).count() == 0


def test_widths_are_those_of_the_snapshot(spark):
    df = spark.createDataFrame([("a", 5), ("a", 12345), ("b", 7), (None, 10), (None, None)], "k string, reads bigint")
    got = [(str(r.k), r.reads) for r in report.format_counters(df, 1, ["k"]).collect()]
    pad = lambda n, extra: " " * extra + f"{n:,}".rjust(19)
    assert got == sorted([("a", pad(5, 4)), ("a", pad(12345, 0)), ("b", pad(7, 0)), ("None", pad(10, 0)), ("None", None)], key=str) or \
        sorted(got, key=str) == sorted([("a", pad(5, 4)), ("a", pad(12345, 0)), ("b", pad(7, 0)), ("None", pad(10, 0)), ("None", None)], key=str)
    p = report.format_counters(df, 1, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in p


def test_schema_has_types_without_their_sources(spark):
    from dbpulse.plans.queries_core import report_sources
    src = {"processes": report_sources(spark, SF_SMOKE)["processes"]}
    o = ReportOptions(return_schema=True, format_output=0, get_task_info=2, get_transaction_info=True, output_column_list="[%]")
    ddl = report.deliver_report(src, o)
    for want in ("`tran_start_time` TIMESTAMP_NTZ", "`physical_io` BIGINT", "`tempdb_current` BIGINT", "`percent_complete` DOUBLE",
                 "`tasks` BIGINT", "`tran_log_writes` STRING", "`query_plan` STRING"):
        assert want in ddl or want.split("`")[1] == "query_plan", want
    text = report.deliver_report(src, ReportOptions(return_schema=True, output_column_list="[reads][start_time]"))
    assert text == "CREATE TABLE <table_name> ( `reads` STRING, `start_time` TIMESTAMP_NTZ )"


def test_destination_table_gets_the_rows_by_name(spark):
    import uuid

    from dbpulse.plans.queries_core import report_sources
    src = {"processes": report_sources(spark, SF_SMOKE)["processes"]}
    name = f"activity_{uuid.uuid4().hex[:12]}"
    as_of = F.lit("1998-08-03 12:00:00").cast("timestamp_ntz")
    o = ReportOptions(destination_table=f"[{name}]", get_task_info=0, format_output=0, output_column_list="[session_id][status][reads]")
    try:
        assert report.deliver_report(src, o, as_of) is None
        n = spark.table(name).count()
        other = ReportOptions(destination_table=name, get_task_info=0, format_output=0, output_column_list="[status][session_id]")
        report.deliver_report(src, other, as_of)
        assert n > 0 and spark.table(name).count() == 2 * n and spark.table(name).columns == ["session_id", "status", "reads"]
        assert spark.table(name).where("status is null").count() == 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    with pytest.raises(ValueError):
        report.deliver_report(src, ReportOptions(destination_table="a..b"), as_of)


def test_report_names_databases_and_cuts_off_later_transactions(spark):
    import datetime as dt

    from dbpulse.plans.queries_core import report_sources
    src = report_sources(spark, SF_SMOKE)
    src = {k: src[k] for k in ("processes", "sessions", "requests", "active_transactions", "database_transactions",
                               "session_transactions")}
    src["databases"] = spark.createDataFrame([(i, f"base{i}") for i in range(4)], "database_id bigint, name string")
    o = ReportOptions(get_task_info=1, get_transaction_info=True, format_output=0, show_sleeping_spids=2, show_system_spids=True,
                      output_column_list="[session_id][database_name][wait_info][tran_log_writes][tran_start_time]", sort_order="")
    at = lambda t: report.activity_report(src, o, as_of=F.lit(t).cast("timestamp_ntz"), materialize=False).collect()
    late, early = at("2002-01-01"), at("1995-02-01")
    texts = [r.tran_log_writes for r in late if r.tran_log_writes]
    assert texts and all(x.split(":")[0] in {"base0", "base1", "base2", "base3", "(null)"} for t in texts for x in t.split(","))
    assert any("base1: " in t for t in texts) and any("(null): " in t for t in texts)   # database 4 has no name
    assert any(r.wait_info and "PAGEIOLATCH_SH:base" in r.wait_info for r in late)
    begun = {r.transaction_id: r.transaction_begin_time for r in src["active_transactions"].collect()}
    assert 0 < sum(r.tran_log_writes is not None for r in early) < len(texts)
    assert min(begun.values()) <= dt.datetime(1995, 2, 1) < max(begun.values())


def test_report_holds_one_record_of_settings_lock_and_job(spark):
    import json

    from dbpulse.plans.queries_core import report_sources
    src = report_sources(spark, SF_SMOKE)
    src = {k: src[k] for k in ("processes", "sessions", "requests", "tasks", "waiting_tasks", "workers", "threads",
                               "partitions", "objects", "schemas")}
    src["jobs"] = spark.createDataFrame([], "job_hex string, job_name string")
    src["job_steps"] = spark.createDataFrame([], "job_hex string, step_id int, step_name string")
    o = ReportOptions(get_task_info=2, get_additional_info=True, format_output=0, show_sleeping_spids=2, show_system_spids=True,
                      output_column_list="[session_id][additional_info]", sort_order="")
    rows = report.activity_report(src, o, as_of=F.lit("2002-01-01").cast("timestamp_ntz"), materialize=False).collect()
    records = [json.loads(r.additional_info) for r in rows]
    assert rows and all("command_type" in x for x in records)
    assert any("transaction_isolation_level" in x for x in records)
    held = [x["block_info"] for x in records if "block_info" in x]
    assert all(x["lock_type"] == "keylock" and "hobt_id" in x for x in held)


def test_widths_without_keys_make_no_join(spark):
    df = spark.createDataFrame([(1, 5), (2, 1234), (3, None)], "id int, n bigint")
    out = report.with_widths(df, [], {"_w": F.length(F.col("n").cast("string"))})
    assert out.columns == ["id", "n", "_w"] and [r["_w"] for r in out.collect()] == [4, 4, 4]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert report.with_widths(df.limit(0), [], {"_w": F.length("n")}).count() == 0
