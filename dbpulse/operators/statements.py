"""Statement text, plan and average time per request (J8, A14, J23, C9,
U4, P17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dbpulse.functions import scalars as S
from dbpulse.functions.numeric import idiv

STAT_KEYS = ("sql_handle", "plan_handle", "statement_start_offset", "statement_end_offset")


def with_avg_elapsed(requests: DataFrame, query_stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """J8 + A14: average elapsed ms per execution from cached statistics
    (total microseconds div executions div 1000, truncating), joined on the
    two handles and both statement offsets. Requests without statistics get
    NULL."""
    keys = list(keys)
    qs = query_stats.select(*keys, *STAT_KEYS,
                            F.when(F.col("execution_count") > 0,
                                   idiv(idiv(F.col("total_elapsed_time"), F.col("execution_count")),
                                        F.lit(1000))).alias("avg_elapsed_time"))
    return requests.join(qs, on=[*keys, *STAT_KEYS], how="left")


def with_statement_text(requests: DataFrame, sql_text: DataFrame, keys: Sequence[str] = (),
                        full_text: bool = False) -> DataFrame:
    """J23 + U4 + C9 + C2 + P17: the running statement's text.

    A left join on the handle replaces the reference's row-at-a-time
    lookups; a missing handle gives NULL text (the fallback row). The text
    is cut to the statement unless ``full_text``; when the whole text is
    used the offsets are reset to (0, -1)."""
    keys = list(keys)
    t = sql_text.select(*keys, "sql_handle", F.col("text").alias("_batch_text"))
    j = requests.join(t, on=[*keys, "sql_handle"], how="left")
    start, end, text = F.col("statement_start_offset"), F.col("statement_end_offset"), F.col("_batch_text")
    half_start = idiv(start, F.lit(2))
    whole = ((F.length(F.rtrim(text)) < idiv(end, F.lit(2)) + 1)
             | F.coalesce(F.when(half_start >= 1, F.substr(text, half_start, F.lit(2)))
                          .rlike("^[a-zA-Z0-9]{2}$"), F.lit(False)))
    stmt = text if full_text else S.statement_slice(text, start, end)
    return (j.withColumn("sql_text", S.scrub_control(stmt))
            .withColumn("statement_start_offset", F.when(text.isNotNull() & whole, F.lit(0)).otherwise(start))
            .withColumn("statement_end_offset", F.when(text.isNotNull() & whole, F.lit(-1)).otherwise(end))
            .drop("_batch_text"))


def with_outer_command(rows: DataFrame, input_buffer: DataFrame, requests: DataFrame,
                       sessions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A9 + S15 + J20: the outer command (the client's batch text) of each
    session, shown on the session's latest-starting row.

    The buffer is valid only when that row's request still exists with the
    same start time (and the start is the session's last request start),
    or, for a request-less row, the session's last request start is
    unchanged. Existence checks are left joins on the request and session
    keys with a flag, not correlated lookups.
    """
    keys = list(keys)
    per_session = Window.partitionBy(*keys, "session_id")
    r = rows.withColumn("_latest", F.max("start_time").over(per_session))
    req = (requests.select(*keys, "session_id", "request_id", F.col("start_time").alias("_rq_start"))
           .distinct().withColumn("_rq", F.lit(True)))
    ses = (sessions.select(*keys, "session_id",
                           F.col("last_request_start_time").alias("_s_last")).distinct())
    j = (r.join(ses, on=[*keys, "session_id"], how="left")
          .join(req, on=[*keys, "session_id", "request_id"], how="left"))
    start = F.col("start_time")
    valid = ((start == F.col("_latest"))
             & (((start == F.col("_s_last")) & F.coalesce(F.col("_rq") & (F.col("_rq_start") == start),
                                                           F.lit(False)))
                | ((F.col("request_id") == 0) & F.col("_s_last").isNotNull()
                   & F.col("_s_last").eqNullSafe(F.col("last_request_start_time")))))
    buf = input_buffer.select(*keys, "session_id", F.col("event_info").alias("_event_info"))
    return (j.join(buf, on=[*keys, "session_id"], how="left")
            .withColumn("sql_command", F.when(valid, S.scrub_control(F.col("_event_info"))))
            .drop("_latest", "_rq_start", "_rq", "_s_last", "_event_info"))


def with_query_plan(rows: DataFrame, plans: DataFrame, get_plans: int = 1,
                    live_plans: DataFrame | None = None, requests: DataFrame | None = None,
                    keys: Sequence[str] = ()) -> DataFrame:
    """The query plan of each request.

    ``get_plans=1`` looks up the statement's plan by (handle, start, end);
    ``get_plans=2`` the whole batch's plan by (handle, 0, -1). A live plan
    (``live_plans``: keys, session_id, query_plan) is preferred when the
    request still runs the same handle and statement offsets.
    """
    keys = list(keys)
    if get_plans not in (1, 2):
        raise ValueError("get_plans must be 1 or 2")
    start = F.col("statement_start_offset") if get_plans == 1 else F.lit(0)
    end = F.col("statement_end_offset") if get_plans == 1 else F.lit(-1)
    r = rows.withColumn("_ps", start.cast("bigint")).withColumn("_pe", end.cast("bigint"))
    cached = plans.select(*keys, "plan_handle", F.col("statement_start_offset").cast("bigint").alias("_ps"),
                          F.col("statement_end_offset").cast("bigint").alias("_pe"),
                          F.col("query_plan").alias("_cached_plan"))
    out = r.join(cached, on=[*keys, "plan_handle", "_ps", "_pe"], how="left")
    plan = F.col("_cached_plan")
    if live_plans is not None and requests is not None:
        still = (requests.select(*keys, "session_id", "request_id", "plan_handle",
                                 "statement_start_offset", "statement_end_offset")
                 .distinct().withColumn("_still", F.lit(True)))
        live = live_plans.select(*keys, "session_id", F.col("query_plan").alias("_live_plan"))
        out = (out.join(still, on=[*keys, "session_id", "request_id", "plan_handle",
                                   "statement_start_offset", "statement_end_offset"], how="left")
               .join(live, on=[*keys, "session_id"], how="left"))
        plan = F.coalesce(F.when(F.col("_still"), F.col("_live_plan")), plan)
    return out.withColumn("query_plan", plan).drop("_ps", "_pe", "_cached_plan", "_still", "_live_plan")
