"""Process rows -> one row per request (A1, W4, P15-P17, W3) and the
session/request overlay (J2, J3, P9, C25)."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dbpulse.functions import scalars as S


def named_sources(keys: Sequence[str] = (), blockers: DataFrame | None = None,
                  broker_tasks: DataFrame | None = None) -> DataFrame | None:
    """The sessions that are asked for by name, as one relation (keys,
    session_id, queue_id, queue_database_id): ``blockers`` found by an earlier
    pass (no queue), and on the first pass the broker-activated tasks (S16).
    None if there are neither."""
    keys = list(keys)
    parts = []
    if blockers is not None:
        parts.append(blockers.select(*keys, "session_id", F.lit(None).cast("bigint").alias("queue_id"),
                                     F.lit(None).cast("bigint").alias("queue_database_id")).distinct())
    if broker_tasks is not None:
        parts.append(broker_tasks.select(*keys, "session_id", F.col("queue_id").cast("bigint").alias("queue_id"),
                                         F.col("database_id").cast("bigint").alias("queue_database_id")))
    return functools.reduce(DataFrame.unionByName, parts) if parts else None


def join_sources(processes: DataFrame, keys: Sequence[str] = (), blockers: DataFrame | None = None,
                 broker_tasks: DataFrame | None = None, first_pass: bool = True) -> DataFrame:
    """J15 + U2: processes joined to the list of sources on ``source = session
    or (source = 0 and first pass)``.

    The alternatives are two branches that share no pair: the wildcard row
    (source 0, first pass only) meets every process without a join, and the
    named sources meet theirs by an equi-join; so no nested loop is planned,
    and one session with most of the rows is an ordinary skewed join key. A
    process that both branches give has two rows, as the list names it twice;
    :func:`collapse_processes` folds them. Adds ``queue_id``,
    ``queue_database_id`` and ``named`` (asked for by name, so past the filter
    on system sessions).
    """
    keys = list(keys)
    named = named_sources(keys, None if first_pass else blockers, broker_tasks if first_pass else None)
    branches = []
    if first_pass:
        branches.append(processes.withColumns({
            "queue_id": F.lit(None).cast("bigint"), "queue_database_id": F.lit(None).cast("bigint"),
            "named": F.lit(False)}))
    if named is not None:
        # 0 stands for the wildcard, which the other branch is
        named = named.where(F.col("session_id") != 0) if first_pass else named
        branches.append(processes.join(named, on=[*keys, "session_id"], how="inner").withColumn("named", F.lit(True)))
    if not branches:
        raise ValueError("a later pass needs the blockers it looks for")
    return functools.reduce(DataFrame.unionByName, branches)


def collapse_processes(processes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A1 + W4 + P16/P17: collapse thread rows (one per ``ecid``).

    Rows are grouped per (session, request, wait type, wait resource,
    blocker); a sleeping session's request becomes 0 and a self-block
    becomes 0. Attributes take their MAX within the group, and the login,
    handle, memory and open-transaction values are then spread to every row
    of the request (W4) — the P6 sleeping filter must see the spread value.
    Both steps partition on (keys, session, request): one exchange.

    Rows of :func:`join_sources` may carry a queue: its label ``Service Broker
    database_id: D queue_id: Q`` takes part in the MAX of the program names
    (with a space where the reference has a line break and indentation), and
    ``named`` tells whether some row was asked for by name.
    """
    keys = list(keys)
    p = processes
    req = F.when(F.col("status") == "sleeping", F.lit(0)).otherwise(F.col("request_id")).cast("bigint")
    blk = F.coalesce(F.nullif(F.col("blocked"), F.col("session_id")), F.lit(0))
    has_handle = "sql_handle" in p.columns
    has_source = "queue_id" in p.columns
    program = F.rtrim("program_name")
    if has_source:
        label = F.concat(F.lit("Service Broker database_id: "), F.col("queue_database_id").cast("string"),
                         F.lit(" queue_id: "), F.col("queue_id").cast("string"))
        program = F.when(F.col("queue_id").isNotNull(), label).otherwise(program)
    grouped = (p.withColumn("request_id", req)
                .withColumn("blocked", blk)
                .withColumn("wait_type", F.rtrim("wait_type"))
                .withColumn("wait_resource", F.rtrim("wait_resource"))
                .groupBy(*keys, "session_id", "request_id", "wait_type", "wait_resource", "blocked")
                .agg(F.max("login_time").alias("login_time"),
                     F.max("last_batch").alias("last_request_end_time"),
                     F.max(F.rtrim("status")).alias("status"),
                     F.max(F.rtrim("cmd")).alias("cmd"),
                     F.max("stmt_start").alias("stmt_start"),
                     F.max("stmt_end").alias("stmt_end"),
                     *([F.max(F.nullif(F.col("sql_handle"), F.lit(bytearray(b"\x00"))))
                        .alias("sql_handle")] if has_handle else []),
                     F.max(F.rtrim("host_name")).alias("host_name"),
                     F.max(F.rtrim("login_name")).alias("login_name"),
                     F.max(program).alias("program_name"),
                     *([F.max("named").alias("named")] if has_source else []),
                     F.max("database_id").alias("database_id"),
                     F.max("memory_usage").alias("memory_usage"),
                     F.max("open_tran_count").alias("open_tran_count"),
                     F.max("wait_time").alias("wait_time"),
                     F.max(F.when(F.col("hostprocess") > "", 1).otherwise(0)).cast("boolean")
                      .alias("is_user_process")))
    per_request = Window.partitionBy(*keys, "session_id", "request_id")
    spread = grouped
    for c in ["login_name", "memory_usage", "open_tran_count"] + (["sql_handle"] if has_handle else []):
        spread = spread.withColumn(c, F.max(c).over(per_request))
    cx = F.col("wait_type") == "CXPACKET"
    waiting = (F.col("wait_time") > 0) & ~cx
    create_index = F.col("cmd") == "CREATE INDEX"
    return spread.select(
        *[c for c in spread.columns if c not in ("status", "wait_type", "wait_resource", "wait_time",
                                                 "stmt_start", "stmt_end")],
        F.lower("status").alias("status"),
        F.when(create_index, F.lit(0)).otherwise(F.col("stmt_start")).alias("statement_start_offset"),
        F.when(create_index, F.lit(-1)).otherwise(
            F.coalesce(F.nullif(F.col("stmt_end"), F.lit(0)), F.lit(-1))).alias("statement_end_offset"),
        F.when(waiting, F.col("wait_type")).alias("wait_type"),
        F.when(waiting, F.col("wait_resource")).alias("wait_resource"),
        F.col("wait_type").alias("_raw_wait_type"), F.col("wait_resource").alias("_raw_wait_resource"),
        F.when(cx, F.lit(0)).otherwise(F.col("wait_time")).alias("wait_time"))


def top_wait_per_request(collapsed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """W3 + P15: keep one row per request — lock waits first, then the
    longest wait, then the highest blocker (type and resource break ties) —
    and keep the resource text only for page latch, exchange, latch and
    OLEDB waits."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "session_id", "request_id").orderBy(
        F.when(F.col("wait_type").startswith("LCK_"), 1).otherwise(99),
        F.col("wait_time").desc_nulls_last(), F.col("blocked").desc_nulls_last(),
        F.col("wait_type").asc_nulls_first(), F.col("wait_resource").asc_nulls_first(),
        F.col("_raw_wait_type").asc_nulls_first(), F.col("_raw_wait_resource").asc_nulls_first())
    wt = F.col("wait_type")
    keep_resource = (wt.rlike("^PAGE.*LATCH.") | (wt == "CXPACKET") | wt.startswith("LATCH_") | (wt == "OLEDB"))
    return (collapsed.withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") == 1).drop("_r", "_raw_wait_type", "_raw_wait_resource")
            .withColumn("wait_resource", F.when(keep_resource, F.col("wait_resource"))))


def with_wait_database(df: DataFrame, databases: DataFrame | None, wait_type: str, resource: str,
                       keys: Sequence[str] = (), name: str = "_wait_database") -> DataFrame:
    """C4: adds the name of the database that a page latch's resource
    (``database:file:page``) lies in, looked up per snapshot; NULL for other
    waits and unknown databases. One left join with the small dimension."""
    if databases is None:
        return df
    keys = list(keys)
    in_db = F.when(F.col(wait_type).rlike("^PAGE.*LATCH."), F.substring_index(resource, ":", 1).try_cast("bigint"))
    dbs = databases.select(*keys, F.col("database_id").cast("bigint").alias("_in_db"), F.col("name").alias(name))
    return df.withColumn("_in_db", in_db).join(dbs, on=[*keys, "_in_db"], how="left").drop("_in_db")


def with_wait_info(df: DataFrame, database_name=None, databases: DataFrame | None = None,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Single-wait text for the request's top wait; with ``databases`` a page
    latch shows its database by name (``(null)`` if unknown)."""
    if databases is not None:
        df, database_name = with_wait_database(df, databases, "wait_type", "wait_resource", keys), F.col("_wait_database")
    return df.withColumn("wait_info", F.when(
        F.col("wait_type").isNotNull(),
        S.single_wait_text(F.col("wait_time"), F.col("wait_type"),
                           F.coalesce(F.col("wait_resource"), F.lit("")), database_name))).drop("_wait_database")


def session_numbers(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Dense session number within each snapshot."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("session_id") if keys else None
    if w is None:
        raise ValueError("session_numbers needs snapshot keys; a global dense_rank is one task")
    return df.withColumn("session_number", F.dense_rank().over(w))


# Attributes carried by both a session and its request; the request's
# value wins when the request row exists.
OVERLAY_ATTRIBUTES = (
    ("logical_reads", "reads"), ("reads", "physical_reads"), ("writes", "writes"),
    ("cpu_time", "CPU"), ("text_size", "text_size"), ("language", "language"),
    ("date_format", "date_format"), ("date_first", "date_first"),
    ("quoted_identifier", "quoted_identifier"), ("arithabort", "arithabort"),
    ("ansi_null_dflt_on", "ansi_null_dflt_on"), ("ansi_defaults", "ansi_defaults"),
    ("ansi_warnings", "ansi_warnings"), ("ansi_padding", "ansi_padding"),
    ("ansi_nulls", "ansi_nulls"), ("concat_null_yields_null", "concat_null_yields_null"),
    ("transaction_isolation_level", "transaction_isolation_level"),
    ("lock_timeout", "lock_timeout"), ("deadlock_priority", "deadlock_priority"),
    ("row_count", "row_count"),
)
# The same of the statement that runs: (request's, process row's, result's).
STATEMENT_ATTRIBUTES = (("sql_handle", "sql_handle", "sql_handle"),
                        ("statement_start_offset", "statement_start_offset", "statement_start_offset"),
                        ("statement_end_offset", "statement_end_offset", "statement_end_offset"),
                        ("command", "cmd", "command_type"))
ON_OFF_ATTRIBUTES = ("quoted_identifier", "arithabort", "ansi_null_dflt_on", "ansi_defaults",
                     "ansi_warnings", "ansi_padding", "ansi_nulls", "concat_null_yields_null")


def overlay_requests(procs: DataFrame, sessions: DataFrame, requests: DataFrame,
                     keys: Sequence[str] = (), as_of=None) -> DataFrame:
    """J2 + J3 + P9 + P11 + C21 + C25 + C33: attach session and request
    attributes to the collapsed process rows.

    J2 is a left join to the session on (session, login time). J3 is a left
    join to the request on (session, request) with a residual: the row is
    not sleeping, and either both sides are system sessions or the request
    started at the session's last request start and the session's last end
    is not after the row's. The equi-keys keep both joins hash/sort-merge
    joins with the residual evaluated on the matched pairs.
    """
    keys = list(keys)
    p, s, r = procs.alias("p"), sessions.alias("s"), requests.alias("r")
    j2 = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys] + [
        F.col("p.session_id") == F.col("s.session_id"), F.col("p.login_time") == F.col("s.login_time")]
    residual = ((~F.col("s.is_user_process") & ~F.col("p.is_user_process"))
                | ((F.col("r.start_time") == F.col("s.last_request_start_time"))
                   & (F.col("s.last_request_end_time") <= F.col("p.last_request_end_time"))))
    j3 = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in keys] + [
        F.col("p.session_id") == F.col("r.session_id"),
        F.col("p.request_id") == F.col("r.request_id"),
        F.col("p.status") != "sleeping", F.coalesce(residual, F.lit(False))]
    joined = p.join(s, on=j2, how="left").join(r, on=j3, how="left")
    out = [*[F.col(f"p.{k}") for k in keys], F.col("p.session_id"), F.col("p.request_id"),
           F.col("p.status")]
    for src, name in OVERLAY_ATTRIBUTES:
        in_r, in_s = src in requests.columns, src in sessions.columns
        if not (in_r or in_s):
            continue
        c = (F.coalesce(F.col(f"r.{src}"), F.col(f"s.{src}")) if in_r and in_s
             else F.col(f"r.{src}") if in_r else F.col(f"s.{src}"))
        if src == "transaction_isolation_level":
            c = S.isolation_level_text(c)
        elif src in ON_OFF_ATTRIBUTES:
            c = S.on_off(c)
        out.append(c.alias(name))
    # the statement a request runs, else what its process row last ran
    for src, own, name in STATEMENT_ATTRIBUTES:
        in_r, in_p = src in requests.columns, own in procs.columns
        if in_r or in_p:
            c = (F.coalesce(F.col(f"r.{src}"), F.col(f"p.{own}")) if in_r and in_p
                 else F.col(f"r.{src}") if in_r else F.col(f"p.{own}"))
            out.append(c.alias(name))
    mem = F.col("p.memory_usage")
    if "granted_query_memory" in requests.columns:
        mem = mem + F.coalesce(F.col("r.granted_query_memory"), F.lit(0))
    out.append(mem.alias("used_memory"))
    if "host_process_id" in sessions.columns:
        out.append(F.col("s.host_process_id").alias("host_process_id"))
    for c in ("transaction_id", "plan_handle", "percent_complete", "group_id"):
        if c in requests.columns:
            col = F.col(f"r.{c}")
            if c == "percent_complete":
                col = F.nullif(col, F.lit(0))
            out.append(col.alias(c))
    epoch_1900 = F.lit("1900-01-01 00:00:00").cast("timestamp_ntz")
    fallback = F.nullif(F.coalesce(F.col("r.start_time").cast("timestamp_ntz"),
                                   F.col("p.last_request_end_time").cast("timestamp_ntz")), epoch_1900)
    chain = [fallback, F.col("p.login_time").cast("timestamp_ntz")]
    if as_of is not None and "total_elapsed_time" in requests.columns:
        sys_start = F.when(~F.col("s.is_user_process") & (F.col("r.total_elapsed_time") >= 0),
                           S.round_to_second(as_of - F.make_dt_interval(
                               secs=S.idiv(F.col("r.total_elapsed_time"), F.lit(1000)))))
        chain.insert(0, sys_start.cast("timestamp_ntz"))
    out.append(F.coalesce(*chain).alias("start_time"))
    out.append(F.col("p.login_time").cast("timestamp_ntz").alias("login_time"))
    out.append(F.col("s.last_request_start_time").cast("timestamp_ntz").alias("last_request_start_time"))
    out.append(F.col("r.session_id").isNotNull().alias("has_request"))
    return joined.select(*out)
