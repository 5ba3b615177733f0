"""Temp-space usage per request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dbpulse.functions import scalars as S


def temp_space_summary(task_usage: DataFrame, session_usage: DataFrame, sessions: DataFrame,
                       keys: Sequence[str] = ()) -> DataFrame:
    """U1 + J11 + A4: page counts per (keys, session, request or -1).

    Task counters carry a request id; session counters do not and are
    filed under request -1, which is where sleeping rows look them up (J7).
    Only sessions present in ``sessions`` are kept (left-semi join), and the
    union is reduced by a partial + final aggregate.
    """
    keys = list(keys)

    def pages(df, request):
        allocs, current = S.temp_pages(F.col("user_alloc"), F.col("internal_alloc"),
                                       F.col("user_dealloc"), F.col("internal_dealloc"))
        return df.select(*keys, "session_id", request.alias("request_id"),
                         allocs.alias("tempdb_allocations"), current.alias("tempdb_current"))

    live = sessions.select(*keys, "session_id").distinct()
    u = pages(task_usage, F.col("request_id").cast("bigint")).unionByName(
        pages(session_usage, F.lit(None).cast("bigint")))
    u = u.join(live, on=[*keys, "session_id"], how="left_semi")
    return (u.groupBy(*keys, "session_id", F.coalesce(F.col("request_id"), F.lit(-1)).alias("request_id"))
            .agg(F.sum("tempdb_allocations").alias("tempdb_allocations"),
                 F.sum("tempdb_current").alias("tempdb_current")))


def attach_temp_space(activity: DataFrame, summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """J7 + C32: left join on (session, request or -1 when sleeping); a
    negative current count is shown as 0 and missing counts as 0."""
    keys = list(keys)
    a = activity.alias("a")
    t = summary.alias("t")
    lookup = F.when(F.col("a.status") == "sleeping", F.lit(-1)).otherwise(F.col("a.request_id"))
    cond = [F.col(f"a.{k}") == F.col(f"t.{k}") for k in keys] + [
        F.col("a.session_id") == F.col("t.session_id"), F.col("t.request_id") == lookup]
    return (a.join(t, cond, "left")
            .select("a.*",
                    F.coalesce(F.col("t.tempdb_allocations"), F.lit(0)).alias("tempdb_allocations"),
                    F.coalesce(F.greatest(F.col("t.tempdb_current"), F.lit(0)), F.lit(0))
                    .alias("tempdb_current")))


def split_space_usage(usage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One counter table with NULL request ids for session rows -> (task, session)."""
    return usage.filter(F.col("request_id").isNotNull()), usage.filter(F.col("request_id").isNull())
