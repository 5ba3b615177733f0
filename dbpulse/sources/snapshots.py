"""Fixed schemas and readers of the diagnostic snapshot sources.

Every source row carries the snapshot keys ``instance_id`` and
``collection_time`` in front of the columns the operators read. Readers use
the explicit schema (no inference, no footer scan for schema merging), so
column pruning and filter pushdown reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dbpulse.sources import history

L, I, S, TS, B, F32, BIN = (T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType(),
                            T.BooleanType(), T.FloatType(), T.BinaryType())
KEYS = [T.StructField("instance_id", S, False), T.StructField("collection_time", TS, False)]


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(KEYS + [T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    # S1 cumulative wait counters
    "wait_stats": _schema(("wait_type", S), ("wait_time_ms", L), ("signal_wait_time_ms", L),
                          ("waiting_tasks_count", L)),
    # S2 process rows, one per session x request x thread (ecid)
    "processes": _schema(("session_id", L), ("request_id", L), ("ecid", I), ("login_time", TS),
                         ("last_batch", TS), ("status", S), ("cmd", S), ("stmt_start", L),
                         ("stmt_end", L), ("sql_handle", BIN), ("host_name", S), ("login_name", S),
                         ("program_name", S), ("database_id", L), ("memory_usage", L),
                         ("open_tran_count", L), ("wait_type", S), ("wait_resource", S),
                         ("wait_time", L), ("blocked", L), ("hostprocess", S)),
    # S3 sessions
    "sessions": _schema(("session_id", L), ("login_time", TS), ("last_request_start_time", TS),
                        ("last_request_end_time", TS), ("is_user_process", B), ("host_process_id", L),
                        ("logical_reads", L), ("reads", L), ("writes", L), ("cpu_time", L),
                        ("row_count", L), ("transaction_isolation_level", L), ("text_size", L),
                        ("language", S), ("date_format", S), ("date_first", L), ("lock_timeout", L),
                        ("deadlock_priority", L), ("quoted_identifier", B), ("arithabort", B),
                        ("ansi_null_dflt_on", B), ("ansi_defaults", B), ("ansi_warnings", B),
                        ("ansi_padding", B), ("ansi_nulls", B), ("concat_null_yields_null", B)),
    # S4 requests
    "requests": _schema(("session_id", L), ("request_id", L), ("start_time", TS), ("command", S),
                        ("sql_handle", BIN), ("plan_handle", BIN), ("statement_start_offset", L),
                        ("statement_end_offset", L), ("logical_reads", L), ("reads", L), ("writes", L),
                        ("cpu_time", L), ("granted_query_memory", L), ("transaction_id", L),
                        ("total_elapsed_time", L), ("percent_complete", F32), ("row_count", L),
                        ("transaction_isolation_level", L)),
    # S5 tasks
    "tasks": _schema(("session_id", L), ("request_id", L), ("task_address", BIN),
                     ("worker_address", BIN), ("task_state", S), ("pending_io_count", L),
                     ("context_switches_count", L)),
    # S6 workers (with the server clock, S8) and threads
    "workers": _schema(("worker_address", BIN), ("thread_address", BIN), ("state", S),
                       ("wait_resumed_ms_ticks", L), ("task_bound_ms_ticks", L), ("ms_ticks", L)),
    "threads": _schema(("thread_address", BIN), ("usermode_time", L), ("kernel_time", L)),
    # S7 waiting tasks
    "waiting_tasks": _schema(("session_id", L), ("waiting_task_address", BIN), ("wait_type", S),
                             ("wait_duration_ms", L), ("resource_description", S),
                             ("blocking_session_id", L)),
    # S9 locks
    "locks": _schema(("session_id", L), ("request_id", L), ("resource_database_id", L),
                     ("resource_type", S), ("resource_subtype", S), ("resource_description", S),
                     ("resource_associated_entity_id", L), ("request_mode", S), ("request_status", S)),
    # S10 transactions
    "active_transactions": _schema(("transaction_id", L), ("transaction_begin_time", TS)),
    "database_transactions": _schema(("transaction_id", L), ("database_id", L),
                                     ("log_record_count", L), ("log_bytes_used", L),
                                     ("database_transaction_begin_time", TS)),
    "session_transactions": _schema(("transaction_id", L), ("session_id", L)),
    # S11 temp-space counters (NULL request = session level)
    "space_usage": _schema(("session_id", L), ("request_id", L), ("user_alloc", L),
                           ("internal_alloc", L), ("user_dealloc", L), ("internal_dealloc", L)),
    # S12 cached query statistics
    "query_stats": _schema(("sql_handle", BIN), ("plan_handle", BIN), ("statement_start_offset", L),
                           ("statement_end_offset", L), ("execution_count", L),
                           ("total_elapsed_time", L)),
    # S13 / S14 text and plan by handle
    "sql_text": _schema(("sql_handle", BIN), ("text", S)),
    "query_plans": _schema(("plan_handle", BIN), ("statement_start_offset", L),
                           ("statement_end_offset", L), ("query_plan", S)),
    # S15 outer command buffer
    "input_buffer": _schema(("session_id", L), ("event_info", S)),
    # S16 broker-activated tasks
    "broker_tasks": _schema(("session_id", L), ("database_id", L), ("queue_id", L)),
    # S17 catalog (per database)
    "allocation_units": _schema(("database_id", L), ("allocation_unit_id", L), ("type", L),
                                ("container_id", L)),
    "partitions": _schema(("database_id", L), ("hobt_id", L), ("partition_id", L), ("object_id", L),
                          ("index_id", L)),
    "objects": _schema(("database_id", L), ("object_id", L), ("name", S), ("schema_id", L)),
    "indexes": _schema(("database_id", L), ("object_id", L), ("index_id", L), ("name", S)),
    "schemas": _schema(("database_id", L), ("schema_id", L), ("name", S)),
    "principals": _schema(("database_id", L), ("principal_id", L), ("name", S)),
    "databases": _schema(("database_id", L), ("name", S)),
    # S18 agent jobs
    "jobs": _schema(("job_hex", S), ("job_name", S)),
    "job_steps": _schema(("job_hex", S), ("step_id", I), ("step_name", S)),
}


def load_source(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Read one snapshot source with its fixed schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def load_sources(spark: SparkSession, root: str, names=None) -> dict[str, DataFrame]:
    """Read ``<root>/<name>`` for each source that exists under ``root``."""
    import os
    out = {}
    for n in names or SCHEMAS:
        p = os.path.join(root, n)
        if "://" in root or os.path.exists(p):
            out[n] = load_source(spark, n, p)
    return out


def snapshot_loaders(root: str, names=None) -> dict[str, Callable[[SparkSession], DataFrame | None]]:
    """For each source a function that reads ``<root>/<name>`` anew, None
    while there is no such folder (``processes`` is left out unless named)."""
    def loader(name: str):
        path = f"{root.rstrip('/')}/{name}"

        def load(spark: SparkSession) -> DataFrame | None:
            fs, folder, _ = history._fs(spark, path)
            return load_source(spark, name, path) if fs.exists(folder) else None
        return load
    return {n: loader(n) for n in names or [n for n in SCHEMAS if n != "processes"]}


def _make_loader(name: str):
    def loader(spark: SparkSession, path: str) -> DataFrame:
        return load_source(spark, name, path)
    loader.__name__ = f"load_{name}"
    loader.__doc__ = f"Read the ``{name}`` snapshot source with its fixed schema."
    return loader


for _n in SCHEMAS:
    globals()[f"load_{_n}"] = _make_loader(_n)
del _n
