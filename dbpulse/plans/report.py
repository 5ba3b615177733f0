"""Activity report assembly: column list (P1), sort (O1), formatting (C7,
C8, W12), result DDL (K5) and the end-to-end plan.

Column and sort resolution work on column *names* (metadata, 44 entries) on
the driver; every row-level step is a lazy DataFrame stage.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dbpulse.functions import scalars as S
from dbpulse.operators import (blocking, delta, filters, info, jobs, locks, sessions, statements, tasks,
                               tempspace, trans)
from dbpulse.plans.options import ReportOptions
from dbpulse.session import cut_lineage, table_scope
from dbpulse.sources.history import append_to_table, check_table_name, result_schema_ddl


# The report's columns in default order, each with the
# feature gate that enables it.
def _columns(o: ReportOptions) -> list[tuple[str, bool]]:
    fmt, ti, delta_on = o.format_output in (1, 2), o.get_task_info, o.delta_interval > 0
    waits_on = ti > 0 or o.find_block_leaders
    return [
        ("session_id", True), ("dd hh:mm:ss.mss", fmt), ("dd hh:mm:ss.mss (avg)", fmt and o.get_avg_time),
        ("avg_elapsed_time", o.format_output == 0 and o.get_avg_time), ("physical_io", ti == 2),
        ("reads", True), ("physical_reads", True), ("writes", True), ("tempdb_allocations", True),
        ("tempdb_current", True), ("CPU", True), ("context_switches", ti == 2), ("used_memory", True),
        ("physical_io_delta", delta_on and ti == 2), ("reads_delta", delta_on),
        ("physical_reads_delta", delta_on), ("writes_delta", delta_on),
        ("tempdb_allocations_delta", delta_on), ("tempdb_current_delta", delta_on),
        ("CPU_delta", delta_on), ("context_switches_delta", delta_on and ti == 2),
        ("used_memory_delta", delta_on), ("tasks", ti == 2), ("status", True), ("wait_info", waits_on),
        ("locks", o.get_locks), ("tran_start_time", o.get_transaction_info),
        ("tran_log_writes", o.get_transaction_info), ("open_tran_count", True),
        ("sql_command", o.get_outer_command), ("sql_text", True), ("query_plan", o.get_plans >= 1),
        ("blocking_session_id", waits_on), ("blocked_session_count", o.find_block_leaders),
        ("percent_complete", True), ("host_name", True), ("login_name", True), ("database_name", True),
        ("program_name", True), ("additional_info", o.get_additional_info), ("start_time", True),
        ("login_time", True), ("request_id", True), ("collection_time", True),
    ]


# The columns a report can be sorted by.
SORTABLE_COLUMNS = (
    "session_id", "physical_io", "reads", "physical_reads", "writes", "tempdb_allocations",
    "tempdb_current", "CPU", "context_switches", "used_memory", "physical_io_delta", "reads_delta",
    "physical_reads_delta", "writes_delta", "tempdb_allocations_delta", "tempdb_current_delta",
    "CPU_delta", "context_switches_delta", "used_memory_delta", "tasks", "tran_start_time",
    "open_tran_count", "blocking_session_id", "blocked_session_count", "percent_complete",
    "host_name", "login_name", "database_name", "start_time", "login_time", "program_name",
)


def like_to_regex(pattern: str) -> re.Pattern:
    """SQL LIKE (``%``, ``_``, ``[set]``) as a case-insensitive regex."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif ch == "[":
            j = pattern.find("]", i + 1)
            if j == -1:
                out.append(re.escape(ch))
            else:
                body = pattern[i + 1:j]
                out.append("[^" + body[1:] + "]" if body.startswith("^") else "[" + body + "]")
                i = j
        else:
            out.append(re.escape(ch))
        i += 1
    return re.compile("^" + "".join(out) + "$", re.IGNORECASE | re.DOTALL)


def _tokens(text: str) -> list[tuple[int, str, str]]:
    """``[pattern]`` tokens with their position and the text after them."""
    toks = []
    for m in re.finditer(r"\[([^\]]*)\]", text):
        nxt = text.find("[", m.end())
        toks.append((m.start(), m.group(1), text[m.end(): nxt if nxt != -1 else len(text)]))
    return toks


def select_columns(column_list: str, options: ReportOptions) -> list[str]:
    """Resolve a ``[pat][pat]...`` list against the enabled columns.

    Each token LIKE-matches column names; a name appears once, at its first
    matching token, and names matched by one token keep the default order.
    No match at all is an error.
    """
    enabled = [(i, n) for i, (n, on) in enumerate(_columns(options)) if on]
    picked: dict[str, tuple[int, int]] = {}
    for pos, pat, _ in _tokens(column_list):
        rx = like_to_regex(pat)
        for default_order, name in enabled:
            if rx.match(name) and name not in picked:
                picked[name] = (pos, default_order)
    if not picked:
        raise ValueError("no valid column matches found in the column list")
    return [n for n, _ in sorted(picked.items(), key=lambda kv: kv[1])]


def sort_spec(sort_order: str) -> list[tuple[str, bool]]:
    """O1: ``[col] asc [col2] desc ...`` -> [(column, ascending)]. The first
    mention of a column wins; unknown names are ignored; the direction is
    ``desc`` only when the text after the bracket says so."""
    out: dict[str, tuple[int, bool]] = {}
    for pos, pat, after in _tokens(sort_order):
        rx = like_to_regex(pat)
        asc = True
        low = after.lower()
        if "asc" in low:
            asc = True
        elif "desc" in low:
            asc = False
        for name in SORTABLE_COLUMNS:
            if rx.match(name) and name not in out:
                out[name] = (pos, asc)
    return [(n, a) for n, (p, a) in sorted(out.items(), key=lambda kv: kv[1][0])]


def sort_by(df: DataFrame, sort_order: str) -> DataFrame:
    """O1: apply a sort text; asc puts NULLs first, desc last (as the
    reference's engine does). Unmatched text leaves the order alone."""
    spec = [(n, a) for n, a in sort_spec(sort_order) if n in df.columns]
    if not spec:
        return df
    return df.orderBy(*[F.col(n).asc_nulls_first() if a else F.col(n).desc_nulls_last() for n, a in spec])


def sort_positions(df: DataFrame, sort_order: str, tie_breakers: list[str], name: str = "position") -> DataFrame:
    """O1 with an order that outlives the DataFrame: adds each row's place (from
    1) in the order of a sort text, ties by ``tie_breakers``.

    Rows are range-partitioned by the order and sorted within their partitions
    (what a global sort does), written once, and numbered by their place in
    the partition plus the sizes of the partitions before it: one small row a
    partition crosses to the window that adds these up, no row of the data.
    """
    spec = [(n, a) for n, a in sort_spec(sort_order) if n in df.columns]
    order = [F.col(n).asc_nulls_first() if a else F.col(n).desc_nulls_last() for n, a in spec]
    order += [F.col(n).asc_nulls_first() for n in tie_breakers]
    in_task = F.monotonically_increasing_id()
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_part", F.shiftright(in_task, 33)).withColumn("_row", in_task.bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_all", F.col("_part") * 0)
    # one group: a row for each partition, however many rows they hold
    before = Window.partitionBy("_all").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (placed.join(starts, on="_part").withColumn(name, F.col("_before") + F.col("_row") + 1)
            .drop("_part", "_row", "_before"))


COUNTER_COLUMNS = ("physical_io", "reads", "physical_reads", "writes", "tempdb_allocations",
                   "tempdb_current", "CPU", "context_switches", "used_memory", "physical_io_delta",
                   "reads_delta", "physical_reads_delta", "writes_delta", "tempdb_allocations_delta",
                   "tempdb_current_delta", "CPU_delta", "context_switches_delta",
                   "used_memory_delta", "tasks", "open_tran_count", "percent_complete",
                   "blocked_session_count")


def with_widths(df: DataFrame, keys: list[str], widths: Mapping[str, Column]) -> DataFrame:
    """The widest text of each column in its snapshot, added to every row.

    One plain aggregation gives a row a snapshot (combined map-side), joined
    back on the keys; the wide rows are neither shuffled nor sorted for it.
    Rows without snapshot keys are one snapshot, whose row is a scalar subquery.
    """
    most = [F.max(c).alias(n) for n, c in widths.items()]
    if not keys:
        return (df.withColumn("_widest", df.agg(*most).select(F.struct(*widths)).scalar())
                .withColumns({n: F.col(f"_widest.{n}") for n in widths}).drop("_widest"))
    there = df.groupBy(*keys).agg(*most).toDF(*[f"_w_{k}" for k in keys], *widths)
    same = [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys]
    return df.join(there, on=same, how="left").drop(*[f"_w_{k}" for k in keys])


def format_counters(df: DataFrame, format_output: int, keys: list[str]) -> DataFrame:
    """C8 + W12: counters as text. Format 2: thousands separators, right
    aligned in 19. Format 1 also pads every value to the widest value of
    its snapshot; rows without snapshot keys are one snapshot."""
    if format_output == 0:
        return df
    counters = [c for c in COUNTER_COLUMNS if c in df.columns]
    digits = {c: F.length(F.col(c).cast("bigint").cast("string")) for c in counters}
    out = with_widths(df, keys, {f"_width_{c}": digits[c] for c in counters}) if format_output == 1 else df
    texts = {}
    for c in counters:
        text = S.count_text(F.col(c).cast("decimal(38,0)")) if c != "percent_complete" \
            else S.right_aligned(F.format_number(F.col(c), 2))
        if format_output == 1:
            text = F.concat(F.repeat(F.lit(" "), F.col(f"_width_{c}") - digits[c]), text)
        texts[c] = F.when(F.col(c).isNotNull(), text)
    return out.withColumns(texts).drop(*[f"_width_{c}" for c in counters])


def format_elapsed(df: DataFrame, keys: list[str], elapsed_col: str = "elapsed_ms",
                   avg_col: str | None = "avg_elapsed_time") -> DataFrame:
    """C7 + W12: ``dd hh:mm:ss.mss`` with days padded to the widest value
    of the snapshot (at least 2); the average column uses width 2."""
    wide = with_widths(df, keys, {"_days": S.day_width(F.col(elapsed_col))})
    out = wide.withColumn("dd hh:mm:ss.mss", S.elapsed_text(F.col(elapsed_col), F.col("_days"))).drop("_days")
    if avg_col and avg_col in df.columns:
        out = out.withColumn("dd hh:mm:ss.mss (avg)", S.elapsed_text(F.col(avg_col), 2))
    return out


# The types of report columns that no source may fill; all others
# are text. Counters become text in formats 1 and 2.
_TIMES = ("tran_start_time", "start_time", "login_time", "collection_time")
_IDS = ("session_id", "request_id", "blocking_session_id", "avg_elapsed_time")


def column_type(name: str, options: ReportOptions) -> str:
    """K5: the type of a report column, whether or not its source is there."""
    if name in _TIMES:
        return "timestamp_ntz"
    if name in _IDS:
        return "bigint"
    if name in COUNTER_COLUMNS and options.format_output == 0:
        return "double" if name == "percent_complete" else "bigint"
    return "string"


def activity_report(sources: Mapping[str, DataFrame], options: ReportOptions,
                    as_of: Column | None = None, materialize: bool = True) -> DataFrame:
    """The activity report.

    ``sources`` names snapshot DataFrames: ``processes`` (required),
    ``sessions``, ``requests``, ``tasks``, ``waiting_tasks``, ``workers``,
    ``threads``, ``space_usage``, ``active_transactions``,
    ``database_transactions``, ``session_transactions``, ``locks`` and the
    catalog tables, ``sql_text``, ``query_plans``, ``live_plans``,
    ``query_stats``, ``input_buffer``, ``broker_tasks``, ``databases``,
    ``jobs``, ``job_steps``.
    Missing sources leave their columns NULL. ``options.keys`` that are not
    present in ``processes`` are ignored (single-snapshot input). With
    ``materialize`` the per-request rows are checkpointed once (an eager
    step); otherwise the whole report stays one lazy plan.
    """
    o = options
    procs = sources["processes"]
    keys = [k for k in o.keys if k in procs.columns]
    as_of = as_of if as_of is not None else (
        F.col("collection_time").cast("timestamp_ntz") if "collection_time" in procs.columns
        else F.current_timestamp().cast("timestamp_ntz"))
    if "broker_tasks" in sources:
        procs = sessions.join_sources(procs, keys, broker_tasks=sources["broker_tasks"])
    collapsed = sessions.collapse_processes(procs, keys)
    all_top = sessions.top_wait_per_request(collapsed, keys)
    if "databases" in sources:  # before the filters: one of them is on the name
        dbs = sources["databases"].select(*keys, "database_id", F.col("name").alias("database_name"))
        all_top = all_top.join(dbs, on=[*keys, "database_id"], how="left")
    else:
        all_top = all_top.withColumn("database_name", F.col("database_id").cast("string"))
    if materialize and (o.get_task_info > 0 or o.find_block_leaders):
        # read by the closure's edge table, its seeds and its final join
        all_top = cut_lineage(all_top)
    # P2-P6 on the per-request rows (the filtered attributes are the same on
    # every thread row of a request, so filtering before or after W3 keeps
    # the same rows), then G1/P8: the blockers of the kept sessions, and
    # their blockers in turn, are added with all their rows, past the filters.
    seeds = filters.session_filter(
        all_top, include=(o.filter_type, o.filter), exclude=(o.not_filter_type, o.not_filter),
        own_session_id=o.own_session_id, show_own=o.show_own_spid, show_system=o.show_system_spids,
        show_sleeping=o.show_sleeping_spids, keys=keys)
    if o.get_task_info > 0 or o.find_block_leaders:
        top = blocking.blocker_closure(all_top, seeds, keys).drop("closure_round")
    else:
        top = seeds
    databases = sources.get("databases")
    top = sessions.with_wait_info(top, databases=databases, keys=keys)
    if materialize:
        # One row per request, read by every later branch (overlay, tasks,
        # temp space, transactions, locks, block leaders): write it once to
        # the reliable checkpoint folder instead of recomputing it per branch.
        top = cut_lineage(top)
    rows, blocks = top, None
    if "sessions" in sources and "requests" in sources:
        ov_as_of = (F.col("p.collection_time").cast("timestamp_ntz") if "collection_time" in keys
                    else as_of)
        ov = sessions.overlay_requests(top, sources["sessions"], sources["requests"], keys, ov_as_of)
        ov = ov.drop("status", "login_time")
        at = [*keys, "session_id", "request_id"]
        rows = top.drop(*[c for c in ov.columns if c not in at]).join(ov, on=at, how="left")
    else:
        rows = (top.withColumn("start_time", F.col("last_request_end_time").cast("timestamp_ntz"))
                .withColumn("used_memory", F.col("memory_usage")))
    if "space_usage" in sources:
        tu, su = tempspace.split_space_usage(sources["space_usage"])
        rows = tempspace.attach_temp_space(rows, tempspace.temp_space_summary(tu, su, top, keys), keys)
    if o.get_task_info > 0 and "tasks" in sources and "waiting_tasks" in sources:
        tw = tasks.task_wait_summary(sources["tasks"], sources["waiting_tasks"], top,
                                     sources.get("workers"), sources.get("threads"), keys, databases)
        tw = tw.withColumnRenamed("wait_info", "_task_wait_info")
        blocks = tw.select(*keys, "session_id", "request_id", "block_info") if o.get_task_info == 2 else None
        tw = tw.drop("block_info")
        rows = rows.join(tw, on=[*keys, "session_id", "request_id"], how="left")
        if o.get_task_info == 2:
            rows = rows.withColumn("wait_info", F.coalesce("_task_wait_info", "wait_info"))
        rows = rows.drop("_task_wait_info")
    if o.get_transaction_info and all(k in sources for k in (
            "active_transactions", "database_transactions", "session_transactions")) \
            and "transaction_id" in rows.columns:
        tx = trans.transaction_summary(sources["active_transactions"], sources["database_transactions"],
                                       sources["session_transactions"], rows, keys,
                                       last_collection_start=as_of, database_names=databases)
        rows = rows.join(tx, on=[*keys, "session_id", "request_id"], how="left")
    if "sql_text" in sources and "sql_handle" in rows.columns:
        rows = statements.with_statement_text(rows, sources["sql_text"], keys, o.get_full_inner_text)
    if (o.get_outer_command and "input_buffer" in sources and "sessions" in sources
            and "requests" in sources):
        rows = statements.with_outer_command(rows, sources["input_buffer"], sources["requests"],
                                             sources["sessions"], keys)
    if o.get_plans >= 1 and "query_plans" in sources and "plan_handle" in rows.columns:
        rows = statements.with_query_plan(rows, sources["query_plans"], o.get_plans,
                                          sources.get("live_plans"), sources.get("requests"), keys)
    if o.get_avg_time and "query_stats" in sources and "plan_handle" in rows.columns:
        rows = statements.with_avg_elapsed(rows, sources["query_stats"], keys)
    if o.find_block_leaders:
        leaders = blocking.block_leaders(top, keys)
        rows = rows.join(leaders, on=[*keys, "session_id"], how="left")
    if o.get_locks and "locks" in sources:
        counts = locks.lock_counts(sources["locks"], keys)
        counts = counts.join(top.select(*keys, "session_id", "request_id"),
                             on=[*keys, "session_id", "request_id"], how="left_semi")
        cat = [sources.get(n) for n in ("allocation_units", "partitions", "objects", "indexes",
                                         "schemas", "principals")]
        named = locks.name_locks(counts, *cat, keys) if all(c is not None for c in cat) else (
            counts.withColumn("object_name", F.lit(None).cast("string"))
            .withColumn("index_name", F.lit(None).cast("string"))
            .withColumn("schema_name", F.lit(None).cast("string"))
            .withColumn("principal_name", F.lit(None).cast("string")))
        doc = locks.lock_document(named, keys).withColumn("locks", F.to_json("databases")).drop("databases")
        rows = rows.join(doc, on=[*keys, "session_id", "request_id"], how="left")
    if o.get_additional_info:
        agent = None
        if "jobs" in sources and "job_steps" in sources:
            agent = jobs.agent_job_info(rows.select(*keys, "session_id", "request_id", "program_name"),
                                        sources["jobs"], sources["job_steps"], keys)
        if blocks is not None:
            blocks = info.named_block_info(blocks, *[sources.get(n) for n in ("partitions", "objects", "schemas", "databases")],
                                           keys=keys)
        record = info.additional_info(rows, blocks, agent, keys).withColumn("additional_info", F.to_json("additional_info"))
        rows = rows.join(record, on=[*keys, "session_id", "request_id"], how="left")
    if o.delta_interval > 0 and "collection_time" in keys:
        ik = [k for k in keys if k != "collection_time"]
        guard = "last_request_start_time" if "last_request_start_time" in rows.columns else None
        rows = delta.snapshot_delta(rows, ik, time_col="collection_time",
                                    cpu=("CPU", "thread_cpu_snapshot"), guard_col=guard)
        if o.latest_snapshot_only:
            latest = rows.groupBy(*ik).agg(F.max("collection_time").alias("collection_time"))
            rows = rows.join(latest, on=[*ik, "collection_time"], how="left_semi")
    rows = (rows.withColumn("blocking_session_id", F.nullif(F.col("blocked"), F.lit(0)))
            .withColumn("elapsed_ms", S.elapsed_ms(F.col("start_time"), as_of))
            .withColumn("request_id", F.when(F.col("status") == "sleeping", F.lit(None).cast("bigint"))
                        .otherwise(F.col("request_id")))
            .withColumn("login_time", F.col("login_time").cast("timestamp_ntz"))
            .withColumn("collection_time", as_of))
    if materialize and o.format_output == 1:
        rows = cut_lineage(rows)   # read by the widths and by the texts
    if o.format_output in (1, 2):
        rows = format_elapsed(rows, keys)
    rows = format_counters(rows, o.format_output, keys)
    wanted = select_columns(o.output_column_list, o)
    out_cols = [*[k for k in keys if k != "collection_time"]]
    for c in wanted:
        out_cols.append(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast(column_type(c, o)).alias(c))
    out = rows.select(*out_cols)
    return sort_by(out, o.sort_order)


def report_schema(sources: Mapping[str, DataFrame], options: ReportOptions,
                  table_name: str = "<table_name>") -> str:
    """K5: the DDL of the report for these options; only the plan is analysed."""
    return result_schema_ddl(activity_report(sources, options, materialize=False), table_name)


def deliver_report(sources: Mapping[str, DataFrame], options: ReportOptions,
                   as_of: Column | None = None) -> DataFrame | str | None:
    """The report as its options ask for it: ``return_schema`` gives the DDL of
    the result (K5) and collects nothing, ``destination_table`` appends the
    rows to that table by column name (K2) and returns nothing, else the
    report's rows are returned."""
    if options.return_schema:
        return report_schema(sources, options)
    if not options.destination_table:
        return activity_report(sources, options, as_of)
    check_table_name(options.destination_table)   # before any work is done
    with table_scope():
        append_to_table(activity_report(sources, options, as_of), options.destination_table)
    return None
