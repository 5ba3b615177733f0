"""Wait-statistics operators: the Pareto head of cumulative wait counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dbpulse.functions.numeric import round_div

# The benign wait types left out of the roll-up (73 names,
# in the order the roll-up lists them).
BENIGN_WAIT_TYPES = (
    "BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR", "BROKER_TASK_STOP", "BROKER_TO_FLUSH",
    "BROKER_TRANSMITTER", "CHECKPOINT_QUEUE", "CHKPT", "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT",
    "CLR_SEMAPHORE", "CXCONSUMER", "DBMIRROR_DBM_EVENT", "DBMIRROR_EVENTS_QUEUE",
    "DBMIRROR_WORKER_QUEUE", "DBMIRRORING_CMD", "DIRTY_PAGE_POLL", "DISPATCHER_QUEUE_SEMAPHORE",
    "EXECSYNC", "FSAGENT", "FT_IFTS_SCHEDULER_IDLE_WAIT", "FT_IFTSHC_MUTEX", "HADR_CLUSAPI_CALL",
    "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "HADR_LOGCAPTURE_WAIT", "HADR_NOTIFICATION_DEQUEUE",
    "HADR_TIMER_TASK", "HADR_WORK_QUEUE", "KSOURCE_WAKEUP", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE",
    "MEMORY_ALLOCATION_EXT", "ONDEMAND_TASK_QUEUE", "PARALLEL_REDO_DRAIN_WORKER",
    "PARALLEL_REDO_LOG_CACHE", "PARALLEL_REDO_TRAN_LIST", "PARALLEL_REDO_WORKER_SYNC",
    "PARALLEL_REDO_WORKER_WAIT_WORK", "PREEMPTIVE_XE_GETTARGETSTATE",
    "PWAIT_ALL_COMPONENTS_INITIALIZED", "PWAIT_DIRECTLOGCONSUMER_GETNEXT",
    "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP", "QDS_ASYNC_QUEUE",
    "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP", "QDS_SHUTDOWN_QUEUE",
    "REDO_THREAD_PENDING_WORK", "REQUEST_FOR_DEADLOCK_SEARCH", "RESOURCE_QUEUE",
    "SERVER_IDLE_CHECK", "SLEEP_BPOOL_FLUSH", "SLEEP_DBSTARTUP", "SLEEP_DCOMSTARTUP",
    "SLEEP_MASTERDBREADY", "SLEEP_MASTERMDREADY", "SLEEP_MASTERUPGRADED", "SLEEP_MSDBSTARTUP",
    "SLEEP_SYSTEMTASK", "SLEEP_TASK", "SLEEP_TEMPDBSTARTUP", "SNI_HTTP_ACCEPT",
    "SP_SERVER_DIAGNOSTICS_SLEEP", "SQLTRACE_BUFFER_FLUSH", "SQLTRACE_INCREMENTAL_FLUSH_SLEEP",
    "SQLTRACE_WAIT_ENTRIES", "WAIT_FOR_RESULTS", "WAITFOR", "WAITFOR_TASKSHUTDOWN",
    "WAIT_XTP_RECOVERY", "WAIT_XTP_HOST_WAIT", "WAIT_XTP_OFFLINE_CKPT_NEW_LOG",
    "WAIT_XTP_CKPT_CLOSE", "XE_DISPATCHER_JOIN", "XE_DISPATCHER_WAIT", "XE_TIMER_EVENT",
)

PARETO_THRESHOLD_PCT = 95


def exclude_benign_waits(waits: DataFrame) -> DataFrame:
    """Drop benign wait types and types that never had a waiting task.

    ``isin`` over a fixed literal list compiles to an ``InSet`` predicate in
    the scan's stage; no join or broadcast is needed for 73 constants.
    """
    return waits.filter(~F.col("wait_type").isin(*BENIGN_WAIT_TYPES)
                        & (F.col("waiting_tasks_count") > 0))


def wait_pareto(waits: DataFrame, keys: Sequence[str] = ("instance_id",),
                threshold_pct: int = PARETO_THRESHOLD_PCT,
                collection_time: Column | None = None) -> DataFrame:
    """Wait types that together make up ``threshold_pct`` % of wait time.

    Per key group, types are ranked by wait time (ties by name) and kept
    while the cumulative share of the types ranked *before* them is still
    below the threshold, so the type that crosses the line is included.

    Plan: one exchange on ``keys`` and one sort serve the total (W1), the
    rank (W2) and the exclusive running sum (W14) — a window instead of the
    O(n^2) self-join on rank. The share test runs in integers
    (``100 * preceding < threshold * total``), so it is exact; a group whose
    total is zero yields no rows.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("wait_pareto needs at least one key (e.g. instance_id): "
                         "a window without a partition key runs in one task")
    w = exclude_benign_waits(waits)
    ordered = Window.partitionBy(*keys).orderBy(F.col("wait_time_ms").desc(), F.col("wait_type").asc())
    # the total uses the same partitioning and order with a whole-partition
    # frame, so all three functions run in one Window operator over one sort
    everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    w = (w.withColumn("_total_ms", F.sum("wait_time_ms").over(everything))
          .withColumn("wait_rank", F.row_number().over(ordered))
          .withColumn("_before_ms", F.coalesce(F.sum("wait_time_ms").over(before), F.lit(0)))
          .filter((F.col("_total_ms") > 0)
                  & (F.col("_before_ms") * 100 < F.col("_total_ms") * threshold_pct)))
    ms, sig, n = F.col("wait_time_ms"), F.col("signal_wait_time_ms"), F.col("waiting_tasks_count")
    cpu = ms - sig
    out = [*[F.col(k) for k in keys]]
    if collection_time is not None:
        out.append(collection_time.alias("collection_time"))
    out += [
        F.col("wait_rank"),
        F.col("wait_type"),
        round_div(ms, F.lit(1000), 2).alias("wait_time_s"),
        round_div(cpu, F.lit(1000), 2).alias("cpu_delay_s"),
        round_div(sig, F.lit(1000), 2).alias("signal_wait_time_s"),
        n.alias("waiting_tasks"),
        round_div(ms * 100, F.col("_total_ms"), 2, precision=5).alias("wait_percent"),
        round_div(ms, n * 1000, 4).alias("avg_wait_time_s"),
        round_div(cpu, n * 1000, 4).alias("avg_cpu_delay_s"),
        round_div(sig, n * 1000, 4).alias("avg_signal_wait_time_s"),
    ]
    return w.select(*out)
