"""Task-level wait summary per request (A3, A7, A10, W7, W8, J5, J6, J11,
J12, C4, C5, C42).

The tasks of the collected requests are read once; from there two small
results are made and met at the end: the totals of each request, and its waits.
A wait is a row (request, kind, duration, lock record), whether a task waits
for the processor or for a resource, so both kinds are rolled up alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dbpulse.functions import scalars as S
from dbpulse.functions.numeric import idiv
from dbpulse.operators.sessions import with_wait_database


def timed_tasks(tasks: DataFrame, sessions: DataFrame, workers: DataFrame | None = None,
                threads: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """J11 + J5: the tasks of collected requests that do not sleep, each with its
    thread's processor time and how long it has been ready to run.

    ``ms_ticks`` is the server clock of the snapshot (that of the first
    collection when a delta is taken): a worker bound after it has no thread
    time, and counts only while it is runnable.
    """
    keys = list(keys)
    request = [*keys, "session_id", "request_id"]
    awake = sessions.where(F.col("status") != "sleeping").select(*request).distinct()
    own = tasks.join(awake, on=request, how="left_semi")
    nothing = F.lit(None).cast("bigint")
    if workers is None:
        return own.withColumns({"cpu": nothing, "ready_ms": nothing})
    bound_before = F.col("ms_ticks") >= F.col("task_bound_ms_ticks")
    seen = workers.where((F.col("state") == "RUNNABLE") | bound_before)
    cpu = nothing
    if threads is not None:
        used = threads.select(*keys, "thread_address", (F.col("usermode_time") + F.col("kernel_time")).alias("_used"))
        seen = seen.join(used, on=[*keys, "thread_address"], how="left")
        cpu = F.when(bound_before, F.col("_used"))
    clock = seen.select(*keys, "worker_address", cpu.alias("cpu"),
                        (F.col("ms_ticks") - F.col("wait_resumed_ms_ticks")).alias("_since"))
    ready = F.when((F.col("task_state") == "RUNNABLE") & (F.col("_since") > 0), F.col("_since"))
    return own.join(clock, on=[*keys, "worker_address"], how="left").withColumn("ready_ms", ready).drop("_since")


def request_totals(timed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What a request's tasks add up to, by one grouping (the detail rows that
    the totals would be repeated on are not needed any more)."""
    whole = lambda c: F.sum(F.col(c).cast("bigint"))
    return timed.groupBy(*keys, "session_id", "request_id").agg(
        whole("pending_io_count").alias("physical_io"), whole("context_switches_count").alias("context_switches"),
        whole("cpu").alias("thread_cpu_snapshot"), F.count(F.lit(1)).alias("tasks"))


def resource_waits(waiting: DataFrame, sessions: DataFrame, keys: Sequence[str] = (),
                   databases: DataFrame | None = None) -> DataFrame:
    """J12 + C4 + C42 + A7: (keys, task_address, kind, ms, lock), a row for each kind
    of wait of a task, with its longest duration and lock record.

    The blocker of a waiting task counts only if it is its session's; sessions
    are first reduced to one row (MAX of blockers), so the join multiplies
    nothing. OLEDB waits are left out on both sides. With ``databases`` page
    latches show their database by name.
    """
    keys = list(keys)
    blockers = (sessions.where(~F.col("wait_type").eqNullSafe(F.lit("OLEDB")))
                .groupBy(*keys, "session_id").agg(F.max("blocked").alias("_blocked")))
    wt, text = F.col("wait_type"), F.col("resource_description")
    blocker = F.when(F.col("blocking_session_id") == F.col("_blocked"), F.col("_blocked"))
    waiting = with_wait_database(waiting, databases, "wait_type", "resource_description", keys)
    db_name = F.col("_wait_database") if databases is not None else None
    return (waiting.where(wt != "OLEDB").join(blockers, on=[*keys, "session_id"], how="inner")
            .groupBy(*keys, F.col("waiting_task_address").alias("task_address"),
                     F.concat(wt, S.wait_suffix(wt, text, db_name, with_oledb=False)).alias("kind"))
            .agg(F.max("wait_duration_ms").alias("ms"), F.max(S.block_info(wt, text, blocker)).alias("lock")))


def request_waits(timed: DataFrame, stalls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, session_id, request_id, kind, ms, lock): a ready task waits for the
    processor, any other for what its waiting rows of some duration say."""
    keys = list(keys)
    request = [*keys, "session_id", "request_id"]
    held = (timed.where(F.col("ready_ms").isNull()).select(*request, "task_address")
            .join(stalls.where(F.col("ms") > 0), on=[*keys, "task_address"], how="inner"))
    kind = dict(stalls.dtypes)["lock"]
    ready = timed.where(F.col("ready_ms").isNotNull()).select(
        *request, F.lit("RUNNABLE").alias("kind"), F.col("ready_ms").alias("ms"), F.lit(None).cast(kind).alias("lock"))
    return ready.unionByName(held.select(*request, "kind", "ms", "lock"))


def task_wait_summary(tasks: DataFrame, waiting: DataFrame, sessions: DataFrame,
                      workers: DataFrame | None = None, threads: DataFrame | None = None,
                      keys: Sequence[str] = (), databases: DataFrame | None = None) -> DataFrame:
    """A3 + W8 + C5 + A10: per request the task totals, the wait text and a lock.

    Waits are rolled up per (request, kind): how many, least, truncating
    integer average, most. The texts of a request's kinds are joined with
    ``", "``, those with a lock first, then by falling number, then by kind;
    ``block_info`` is the lock of the first. The list of a request is bounded
    by its different kinds of wait.
    """
    keys = list(keys)
    request = [*keys, "session_id", "request_id"]
    timed = timed_tasks(tasks, sessions, workers, threads, keys)
    waits = request_waits(timed, resource_waits(waiting, sessions, keys, databases), keys)
    n, ms = F.count(F.lit(1)), F.col("ms")
    kinds = waits.groupBy(*request, "kind").agg(
        n.alias("n"), F.min(ms).alias("least"), idiv(F.sum(ms), n).alias("mean"), F.max(ms).alias("most"),
        F.max("lock").alias("lock"))
    line = F.struct(F.col("lock").isNull().alias("later"), (-F.col("n")).alias("fewer"), "kind",
                    S.wait_text(F.col("n"), F.col("least"), F.col("mean"), F.col("most"), F.col("kind")).alias("text"), "lock")
    lines = kinds.groupBy(*request).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    texts = lines.select(*request, F.array_join(F.transform("lines", lambda x: x["text"]), ", ").alias("wait_info"),
                         F.col("lines")[0]["lock"].alias("block_info"))
    return request_totals(timed, keys).join(texts, on=request, how="left")
