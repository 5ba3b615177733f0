"""Queries over several snapshots at once: every fixture carries its keys."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from dbpulse.operators import blocking, filters, info, jobs, locks, sessions
from dbpulse.functions import scalars as S
from dbpulse.plans import jobs as collection_jobs
from dbpulse.plans import report
from dbpulse.plans.catalog import register
from dbpulse.plans.options import ReportOptions
from dbpulse.plans.queries_core import A6_ORACLE
from dbpulse.session import ensure_checkpoint_dir
from dbpulse.sources import history
from dbpulse.sources.fixtures import _FLAGS, _SETTINGS, fixture, fixture_duckdb_sql, with_fixtures

KEYS = ["instance_id", "collection_time"]


# ------------------------------------------------ J15 + U2 + S16 + U3 sources
# Two passes over one OR-joined list: everything and the broker tasks, then
# the blockers of what the sleeping filter kept.
_J15_PASS = """
SELECT p.instance_id, p.collection_time, p.session_id,
       CASE WHEN p.status = 'sleeping' THEN 0 ELSE p.request_id END AS request_id,
       COALESCE(NULLIF(p.blocked, p.session_id), 0) AS blocked,
       MAX(CASE WHEN b.queue_id IS NOT NULL
                THEN 'Service Broker database_id: ' || b.database_id || ' queue_id: ' || b.queue_id
                ELSE RTRIM(p.program_name) END) AS program_name,
       MAX(CASE WHEN b.session_id = p.session_id THEN 'blocker' ELSE RTRIM(p.hostprocess) END) AS hostprocess,
       MAX(LOWER(p.status)) AS status
FROM {list} b JOIN fx_snap_processes p
  ON b.instance_id = p.instance_id AND b.collection_time = p.collection_time
 AND (b.session_id = p.session_id OR (b.session_id = 0 AND {first}))
GROUP BY ALL"""

J15_ORACLE = with_fixtures(f"""
, list1 AS (
  SELECT instance_id, collection_time, session_id, queue_id, database_id FROM fx_snap_broker_tasks
  UNION ALL
  SELECT DISTINCT instance_id, collection_time, 0, NULL, NULL FROM fx_snap_processes),
pass1 AS ({_J15_PASS.format(list='list1', first='TRUE')}),
kept AS (SELECT * FROM pass1 WHERE hostprocess > '' AND status <> 'sleeping'),
list2 AS (
  SELECT instance_id, collection_time, session_id, NULL::BIGINT AS queue_id, NULL::BIGINT AS database_id FROM (
    SELECT instance_id, collection_time, blocked AS session_id FROM kept WHERE blocked <> 0
    EXCEPT
    SELECT instance_id, collection_time, session_id FROM kept)),
pass2 AS ({_J15_PASS.format(list='list2', first='FALSE')})
SELECT 1 AS pass, instance_id, collection_time, session_id, request_id, blocked, program_name,
       hostprocess = 'blocker' AS named FROM kept
UNION ALL
SELECT 2, instance_id, collection_time, session_id, request_id, blocked, program_name, hostprocess = 'blocker' FROM pass2
""", "fx_snap_processes", "fx_snap_broker_tasks")


@register("j15_u2_source_list", J15_ORACLE)
def j15_u2_source_list(spark, sf_dir):
    procs = fixture(spark, sf_dir, "fx_snap_processes")
    first = sessions.join_sources(procs, KEYS, broker_tasks=fixture(spark, sf_dir, "fx_snap_broker_tasks"))
    kept = filters.session_filter(sessions.collapse_processes(first, KEYS), show_sleeping=0)
    wanted = filters.blockers_of(kept, KEYS).join(kept.select(*KEYS, "session_id"), on=[*KEYS, "session_id"], how="left_anti")
    later = sessions.collapse_processes(sessions.join_sources(procs, KEYS, blockers=wanted, first_pass=False), KEYS)
    cols = [*KEYS, "session_id", "request_id", "blocked", "program_name", "named"]
    return (kept.select(F.lit(1).alias("pass"), *cols)
            .unionByName(later.select(F.lit(2).alias("pass"), *cols)))


# ------------------------------------------------ J13 + J1 lock path
J13_ORACLE = with_fixtures("""
, s AS (
  SELECT p.instance_id, p.collection_time, p.session_id,
         CASE WHEN p.status = 'sleeping' THEN 0 ELSE p.request_id END AS request_id,
         CASE WHEN p.status = 'sleeping' THEN p.last_batch
              ELSE COALESCE((
                SELECT CASE WHEN p.hostprocess > '' OR r.total_elapsed_time < 0 THEN r.start_time
                       ELSE date_trunc('second', p.collection_time - to_seconds(r.total_elapsed_time // 1000) + INTERVAL 500 MILLISECOND) END
                FROM fx_snap_requests r
                WHERE r.instance_id = p.instance_id AND r.collection_time = p.collection_time
                  AND r.session_id = p.session_id AND r.request_id = p.request_id
                ORDER BY r.start_time DESC, r.total_elapsed_time DESC LIMIT 1), p.last_batch) END AS start_time
  FROM fx_snap_processes p WHERE p.ecid = 0),
l AS (
  SELECT instance_id, collection_time, session_id, request_id, resource_database_id AS database_id, resource_type,
         CASE resource_type WHEN 'OBJECT' THEN resource_associated_entity_id END AS object_id,
         CASE resource_type WHEN 'OBJECT' THEN NULL ELSE resource_associated_entity_id END AS hobt_id,
         request_mode, request_status, COUNT(*) AS n
  FROM fx_snap_locks GROUP BY ALL)
SELECT l.instance_id, l.collection_time, l.session_id, l.request_id, l.database_id, l.resource_type, l.object_id,
       l.hobt_id, l.request_mode, l.request_status, CAST(n AS BIGINT) AS request_count, s.start_time
FROM l JOIN s USING (instance_id, collection_time, session_id, request_id)
""", "fx_snap_processes", "fx_snap_requests", "fx_snap_locks")


@register("j13_j1_lock_request_start", J13_ORACLE)
def j13_j1_lock_request_start(spark, sf_dir):
    fx = lambda n: fixture(spark, sf_dir, n)
    starts = locks.request_starts(fx("fx_snap_processes"), fx("fx_snap_requests"), KEYS)
    cols = [*KEYS, "session_id", "request_id", "database_id", "resource_type", "object_id", "hobt_id", "request_mode",
            "request_status"]
    counts = (locks.lock_counts(fx("fx_snap_locks"), KEYS).groupBy(*cols)
              .agg(F.sum("request_count").cast("bigint").alias("request_count")))
    return locks.locks_of_sessions(counts, starts, KEYS).select(*cols, "request_count", "start_time")


# ------------------------------------------------ G2 + A8 + J21 with several blockers
G2_SEVERAL_ORACLE = with_fixtures("""
, below AS (
  SELECT DISTINCT instance_id, collection_no, blocked AS top, session_id AS node
  FROM fx_snap_blocking WHERE blocked <> 0 AND blocked <> session_id
  UNION
  SELECT b.instance_id, b.collection_no, b.top, f.session_id
  FROM below b JOIN fx_snap_blocking f
    ON f.instance_id = b.instance_id AND f.collection_no = b.collection_no AND f.blocked = b.node
  WHERE f.session_id <> f.blocked)
SELECT f.instance_id, f.collection_no, f.session_id, COUNT(DISTINCT b.node) AS blocked_session_count
FROM fx_snap_blocking f LEFT JOIN below b
  ON b.instance_id = f.instance_id AND b.collection_no = f.collection_no AND b.top = f.session_id AND b.node <> f.session_id
GROUP BY ALL
""", "fx_snap_blocking", recursive=True)


@register("g2_several_blockers", G2_SEVERAL_ORACLE)
def g2_several_blockers(spark, sf_dir):
    return blocking.block_leaders(fixture(spark, sf_dir, "fx_snap_blocking"), ["instance_id", "collection_no"])


# ------------------------------------------------ P9 over all pairs, P11, C12
_SNAP_TOP = """
, c AS (
  SELECT instance_id, collection_time, session_id, CASE WHEN status = 'sleeping' THEN 0 ELSE request_id END AS request_id,
         COALESCE(NULLIF(blocked, session_id), 0) AS blocked, MAX(login_time) AS login_time, MAX(last_batch) AS last_request_end_time,
         MAX(LOWER(status)) AS status, MAX(cmd) AS cmd, MAX(login_name) AS login_name, MAX(program_name) AS program_name,
         MAX(host_name) AS host_name, MAX(database_id) AS database_id, MAX(memory_usage) AS memory0, MAX(open_tran_count) AS tran0,
         MAX(wait_time) AS wait_time, MAX(CASE WHEN hostprocess > '' THEN 1 ELSE 0 END) = 1 AS is_user_process
  FROM fx_snap_processes GROUP BY ALL),
top AS (
  SELECT *, MAX(memory0) OVER r AS memory_usage, MAX(tran0) OVER r AS open_tran_count FROM c
  WINDOW r AS (PARTITION BY instance_id, collection_time, session_id, request_id)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY instance_id, collection_time, session_id, request_id
                             ORDER BY wait_time DESC NULLS LAST, blocked DESC NULLS LAST) = 1)"""
_ON = "CASE COALESCE(r.{c}, s.{c}) WHEN TRUE THEN 'ON' WHEN FALSE THEN 'OFF' END"
_ISOLATION = ("CASE COALESCE(r.transaction_isolation_level, s.transaction_isolation_level) WHEN 0 THEN 'Unspecified' "
              "WHEN 1 THEN 'ReadUncomitted' WHEN 2 THEN 'ReadCommitted' WHEN 3 THEN 'Repeatable' WHEN 4 THEN 'Serializable' "
              "WHEN 5 THEN 'Snapshot' END")
_RESULT_NAMES = {"logical_reads": "reads", "reads": "physical_reads", "cpu_time": "CPU"}
_P9_COLUMNS = [*[f"COALESCE(r.{c}, s.{c}) AS \"{_RESULT_NAMES.get(c, c)}\"" for c in (*_SETTINGS, "language", "date_format")
                 if c != "transaction_isolation_level"],
               f"{_ISOLATION} AS transaction_isolation_level", *[f"{_ON.format(c=c)} AS {c}" for c in _FLAGS]]

P9_ORACLE = with_fixtures(_SNAP_TOP + f"""
SELECT t.instance_id, t.collection_time, t.session_id, t.request_id, t.status, {", ".join(_P9_COLUMNS)},
       r.sql_handle AS sql_handle, COALESCE(r.statement_start_offset, 0) AS statement_start_offset,
       COALESCE(r.statement_end_offset, -1) AS statement_end_offset, COALESCE(r.command, t.cmd) AS command_type,
       s.host_process_id, r.group_id, r.plan_handle, r.session_id IS NOT NULL AS has_request
FROM top t
LEFT JOIN fx_snap_settings s ON s.instance_id = t.instance_id AND s.collection_time = t.collection_time
  AND s.session_id = t.session_id AND s.login_time = t.login_time
LEFT JOIN fx_snap_running r ON r.instance_id = t.instance_id AND r.collection_time = t.collection_time
  AND r.session_id = t.session_id AND r.request_id = t.request_id AND t.status <> 'sleeping'
  AND ((NOT s.is_user_process AND NOT t.is_user_process)
       OR (r.start_time = s.last_request_start_time AND s.last_request_end_time <= t.last_request_end_time))
""", "fx_snap_processes", "fx_snap_settings", "fx_snap_running")


def _snap_overlay(spark, sf_dir):
    fx = lambda n: fixture(spark, sf_dir, n)
    top = sessions.top_wait_per_request(sessions.collapse_processes(fx("fx_snap_processes"), KEYS), KEYS)
    return sessions.overlay_requests(top, fx("fx_snap_settings"), fx("fx_snap_running"), KEYS)


@register("p9_overlay_all_pairs", P9_ORACLE)
def p9_overlay_all_pairs(spark, sf_dir):
    names = [_RESULT_NAMES.get(c, c) for c in (*_SETTINGS, "language", "date_format")]
    return _snap_overlay(spark, sf_dir).select(
        *KEYS, "session_id", "request_id", "status", *names, *_FLAGS, "sql_handle", "statement_start_offset",
        "statement_end_offset", "command_type", "host_process_id", "group_id", "plan_handle", "has_request")


# ------------------------------------------------ C42 + J18 + J19 additional_info
def _after(marker: str, delimiter: str = " ") -> str:
    return f"NULLIF(split_part(split_part(resource_description, '{marker}', 2), '{delimiter}', 1), '')"


C42_ORACLE = with_fixtures(f"""
, typed AS (
  SELECT DISTINCT instance_id, collection_time, session_id, request_id, split_part(resource_description, ' ', 1) AS lock_type,
         TRY_CAST({_after('dbid=')} AS BIGINT) AS db, resource_description
  FROM fx_snap_lock_waits WHERE blocking_session_id IS NOT NULL AND starts_with(wait_type, 'LCK_')),
rec AS (
  SELECT instance_id, collection_time, session_id, request_id, lock_type, db,
    CASE lock_type WHEN 'objectlock' THEN {_after('objid=')} END AS object_id,
    CASE lock_type WHEN 'filelock' THEN {_after('fileid=')} END AS file_id,
    CASE WHEN lock_type IN ('pagelock', 'extentlock', 'ridlock') THEN {_after('associatedObjectId=')}
         WHEN lock_type IN ('keylock', 'hobtlock', 'allocunitlock') THEN {_after('hobtid=')} END AS hobt_id,
    CASE lock_type WHEN 'applicationlock' THEN {_after('hash=')} END AS applock_hash,
    CASE lock_type WHEN 'metadatalock' THEN {_after('subresource=')} END AS metadata_resource,
    CASE lock_type WHEN 'metadatalock' THEN {_after('classid=', ' dbid=')} END AS metadata_class_id
  FROM typed),
one AS (
  SELECT * FROM rec QUALIFY ROW_NUMBER() OVER (
    PARTITION BY instance_id, collection_time, session_id, request_id
    ORDER BY lock_type DESC, db DESC NULLS LAST, object_id DESC NULLS LAST, file_id DESC NULLS LAST, hobt_id DESC NULLS LAST,
             applock_hash DESC NULLS LAST, metadata_resource DESC NULLS LAST, metadata_class_id DESC NULLS LAST) = 1),
named AS (
  SELECT one.*, o.name AS object_name, s.name AS schema_name
  FROM one
  LEFT JOIN fx_catalog_partitions p ON p.database_id = one.db AND p.hobt_id = TRY_CAST(one.hobt_id AS BIGINT)
  LEFT JOIN fx_catalog_objects o ON o.database_id = one.db AND o.object_id = COALESCE(p.object_id, TRY_CAST(one.object_id AS BIGINT))
  LEFT JOIN fx_catalog_schemas s ON s.database_id = one.db
    AND s.schema_id = COALESCE(o.schema_id, CASE one.metadata_resource WHEN 'SCHEMA'
                               THEN TRY_CAST(split_part(one.metadata_class_id, ' = ', 2) AS BIGINT) END)),
base AS ({P9_ORACLE}),
agent AS (
  SELECT instance_id, collection_time, session_id, request_id,
         regexp_extract(program_name, '^SQLAgent - TSQL JobStep \\(Job 0x([0-9A-F]{{32}})', 1) AS hex,
         TRY_CAST(regexp_extract(program_name, ' : Step ([0-9]+)\\)', 1) AS BIGINT) AS step_id
  FROM fx_snap_programs),
job AS (SELECT j.job_hex, t.step_id, j.job_name, t.step_name FROM fx_jobs j JOIN fx_job_steps t ON t.job_hex = j.job_hex)
SELECT b.instance_id, b.collection_time, b.session_id, b.request_id, b.language, b.quoted_identifier, b.ansi_nulls,
       b.transaction_isolation_level, b.lock_timeout, b.row_count, b.command_type, b.host_process_id, b.group_id,
       '0x' || LOWER(HEX(b.sql_handle)) AS sql_handle, n.lock_type, CAST(n.db AS VARCHAR) AS database_name, n.object_id, n.file_id,
       n.hobt_id, n.applock_hash, n.metadata_resource, n.metadata_class_id, n.schema_name, n.object_name,
       CASE WHEN a.hex <> '' THEN a.step_id END AS step_id, j.job_name, j.step_name
FROM base b LEFT JOIN named n USING (instance_id, collection_time, session_id, request_id)
LEFT JOIN agent a USING (instance_id, collection_time, session_id, request_id)
LEFT JOIN job j ON j.job_hex = a.hex AND j.step_id = a.step_id
""", "fx_snap_lock_waits", "fx_catalog_partitions", "fx_catalog_objects", "fx_catalog_schemas", "fx_snap_programs", "fx_jobs",
   "fx_job_steps")


@register("c42_additional_info", C42_ORACLE)
def c42_additional_info(spark, sf_dir):
    fx = lambda n: fixture(spark, sf_dir, n)
    at = [*KEYS, "session_id", "request_id"]
    record = S.block_info(F.col("wait_type"), F.col("resource_description"), F.col("blocking_session_id"))
    waits = fx("fx_snap_lock_waits").withColumn("block_info", record).groupBy(*at).agg(F.max("block_info").alias("block_info"))
    blocks = info.named_block_info(waits, fx("fx_catalog_partitions"), fx("fx_catalog_objects"), fx("fx_catalog_schemas"),
                                   keys=KEYS, catalog_keys=())
    agent = jobs.agent_job_info(fx("fx_snap_programs"), fx("fx_jobs"), fx("fx_job_steps"))
    out = info.additional_info(_snap_overlay(spark, sf_dir), blocks, agent, KEYS)
    r = "additional_info"
    return out.select(
        *at, *[f"{r}.{c}" for c in ("language", "quoted_identifier", "ansi_nulls", "transaction_isolation_level", "lock_timeout",
                                    "row_count", "command_type", "host_process_id", "group_id", "sql_handle")],
        f"{r}.block_info.*", *[f"{r}.agent_job_info.{c}" for c in ("step_id", "job_name", "step_name")])


# ------------------------------------------------ O1 a place that the oracle sees
O1_ORACLE = with_fixtures(_SNAP_TOP + """
SELECT instance_id, collection_time, session_id, request_id, open_tran_count, login_name, program_name,
       ROW_NUMBER() OVER (ORDER BY open_tran_count DESC NULLS LAST, program_name ASC NULLS FIRST, login_name ASC NULLS FIRST,
                          instance_id, collection_time, session_id, request_id) AS position
FROM top
""", "fx_snap_processes")


@register("o1_sorted_positions", O1_ORACLE)
def o1_sorted_positions(spark, sf_dir):
    top = sessions.top_wait_per_request(sessions.collapse_processes(fixture(spark, sf_dir, "fx_snap_processes"), KEYS), KEYS)
    at = [*KEYS, "session_id", "request_id"]
    rows = top.select(*at, "open_tran_count", "login_name", "program_name")
    return report.sort_positions(rows, "[open_tran_count] desc[program_name][login%] asc[nothing][open%] asc", at)


# ------------------------------------------------ T4 + K1 + T5 wait history over several days
def _shared_path(spark, kind):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


WAIT_DAYS = [dt.datetime(1996, 5, 1, 23, 59), dt.datetime(1997, 12, 10, 23, 59), dt.datetime(1997, 12, 30, 23, 59, 40),
             dt.datetime(1997, 12, 10, 23, 59), dt.datetime(1998, 1, 12, 12)]   # one runs again, late
WAIT_KEPT = [WAIT_DAYS[2], WAIT_DAYS[4]]


def _t4_oracle() -> str:
    """The Pareto head of each server's latest counters at each time that retention keeps."""
    parts = []
    fx = fixture_duckdb_sql("fx_waits")
    for t in WAIT_KEPT:
        latest = (f"SELECT * EXCLUDE (collection_time) FROM ({fixture_duckdb_sql('fx_snap_waits')}) q "
                  f"WHERE collection_time <= TIMESTAMP '{t}' QUALIFY collection_time = MAX(collection_time) OVER (PARTITION BY instance_id)")
        minute = f"date_trunc('minute', TIMESTAMP '{t}' + INTERVAL 30 SECOND)"
        parts.append(f"""
SELECT CAST(instance_id AS VARCHAR) AS instance_id, {minute} AS collection_time, wait_type, wait_time_s, cpu_delay_s,
  signal_wait_time_s, CAST(waiting_tasks AS INTEGER) AS waiting_tasks, wait_percent,
  CAST(avg_wait_time_s AS DECIMAL(16,2)) AS avg_wait_time_s, CAST(avg_cpu_delay_s AS DECIMAL(16,2)) AS avg_cpu_delay_s,
  CAST(avg_signal_wait_time_s AS DECIMAL(16,2)) AS avg_signal_wait_time_s, CAST({minute} AS DATE) AS collection_date
FROM ({A6_ORACLE.replace(fx, latest)}) x""")
    return "\nUNION ALL\n".join(parts)


@register("t4_wait_history", _t4_oracle())
def t4_wait_history(spark, sf_dir):
    path = _shared_path(spark, "wait-history")
    stats = fixture(spark, sf_dir, "fx_snap_waits")
    for t in WAIT_DAYS:
        out = collection_jobs.wait_rollup_job(spark, stats, path, t)
    return out


# ------------------------------------------------ T3 + K2 + T5 activity history over several snapshots
ACTIVITY_TIMES = [dt.datetime(1995, 6, 1), dt.datetime(1998, 2, 1), dt.datetime(1997, 7, 1), dt.datetime(1998, 3, 1)]
ACTIVITY_DAYS = 500     # keeps what was collected since 1996-10-17
T3_ORACLE = with_fixtures(_SNAP_TOP + f"""
, asked AS (SELECT unnest([{", ".join(f"TIMESTAMP '{t}'" for t in ACTIVITY_TIMES)}]) AS as_of),
latest AS (
  SELECT DISTINCT p.instance_id, MAX(p.collection_time) OVER (PARTITION BY a.as_of, p.instance_id) AS collection_time
  FROM asked a JOIN (SELECT DISTINCT instance_id, collection_time FROM fx_snap_processes) p ON p.collection_time <= a.as_of)
SELECT CAST(t.instance_id AS VARCHAR) AS instance_id, t.collection_time, CAST(t.collection_time AS DATE) AS collection_date,
       t.session_id, CASE WHEN t.status = 'sleeping' THEN NULL ELSE t.request_id END AS request_id, t.status, t.login_name,
       t.program_name, t.host_name, CAST(t.database_id AS VARCHAR) AS database_name, t.open_tran_count, t.memory_usage AS used_memory,
       t.last_request_end_time AS start_time, t.login_time
FROM top t JOIN latest USING (instance_id, collection_time)
WHERE t.is_user_process AND (t.status <> 'sleeping' OR t.open_tran_count > 0)
  AND t.collection_time >= TIMESTAMP '{ACTIVITY_TIMES[-1]}' - INTERVAL {ACTIVITY_DAYS} DAY
""", "fx_snap_processes")


@register("t3_activity_history", T3_ORACLE)
def t3_activity_history(spark, sf_dir):
    path = _shared_path(spark, "activity-history")
    sources = {"processes": fixture(spark, sf_dir, "fx_snap_processes")}
    o = ReportOptions(get_task_info=0, format_output=0, output_column_list="[%]")
    for t in ACTIVITY_TIMES:    # the third asks for a snapshot between, the last finds the second's again
        out = collection_jobs.activity_collection_job(spark, sources, path, t, o, retention_days=ACTIVITY_DAYS)
    return out.select("instance_id", "collection_time", "collection_date", "session_id", "request_id", "status", "login_name",
                      "program_name", "host_name", "database_name", "open_tran_count", "used_memory", "start_time", "login_time")


# ------------------------------------------------ C4 + C3 + C6 page latches with database names
C4_ORACLE = with_fixtures("""
, parts AS (SELECT *, string_split(wait_resource, ':') AS at FROM fx_snap_page_waits)
SELECT p.instance_id, p.collection_time, p.session_id, p.wait_type, p.wait_resource,
       '(' || p.wait_time || 'ms)' || p.wait_type || CASE
         WHEN starts_with(p.wait_type, 'PAGE') THEN ':' || COALESCE(d.name, '(null)') || ':' || p.at[2] || '(' || (
           SELECT CASE WHEN n = 1 OR n % 8088 = 0 THEN 'PFS' WHEN n = 2 OR n % 511232 = 0 THEN 'GAM'
                       WHEN n = 3 OR (n - 1) % 511232 = 0 THEN 'SGAM' WHEN n = 6 OR (n - 6) % 511232 = 0 THEN 'DCM'
                       WHEN n = 7 OR (n - 7) % 511232 = 0 THEN 'BCM' ELSE '*' END
           FROM (SELECT CAST(p.at[3] AS INTEGER) AS n)) || ')'
         WHEN p.wait_type = 'LATCH_EX' THEN ' [' || p.wait_resource || ']' ELSE '' END AS wait_info
FROM parts p LEFT JOIN fx_snap_databases d
  ON d.instance_id = p.instance_id AND d.collection_time = p.collection_time AND CAST(d.database_id AS VARCHAR) = p.at[1]
""", "fx_snap_page_waits", "fx_snap_databases")


@register("c4_named_page_waits", C4_ORACLE)
def c4_named_page_waits(spark, sf_dir):
    waits = fixture(spark, sf_dir, "fx_snap_page_waits")
    return sessions.with_wait_info(waits, databases=fixture(spark, sf_dir, "fx_snap_databases"), keys=KEYS).select(
        *KEYS, "session_id", "wait_type", "wait_resource", "wait_info")
