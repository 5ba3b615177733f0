"""Snapshot deltas (T1, W10, W11) and counter usage per interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_METRICS = ("physical_io", "reads", "physical_reads", "writes", "tempdb_allocations",
                   "tempdb_current", "context_switches", "used_memory")
# Metrics whose delta may legitimately be negative.
SIGNED_METRICS = ("tempdb_current",)


def with_previous_snapshot_time(df: DataFrame, instance_keys: Sequence[str] = ("instance_id",),
                                time_col: str = "collection_time") -> DataFrame:
    """Add ``prev_collection_time``: the instance's previous snapshot time.

    The snapshot list (one row per instance and time) is small next to the
    session rows; it is windowed per instance and joined back on
    (instance, time), which AQE broadcasts when it is small enough.
    """
    ik = list(instance_keys)
    if not ik:
        raise ValueError("with_previous_snapshot_time needs the instance key(s)")
    snaps = df.select(*ik, time_col).distinct()
    w = Window.partitionBy(*ik).orderBy(time_col)
    snaps = snaps.withColumn("prev_collection_time", F.lag(time_col).over(w))
    return df.join(snaps, on=[*ik, time_col], how="left")


def snapshot_delta(df: DataFrame, instance_keys: Sequence[str] = ("instance_id",),
                   entity: Sequence[str] = ("session_id", "request_id"),
                   time_col: str = "collection_time", metrics: Sequence[str] = DEFAULT_METRICS,
                   cpu: tuple[str, str] | None = ("CPU", "thread_CPU_snapshot"),
                   guard_col: str | None = "last_request_start_time") -> DataFrame:
    """Per entity, each metric minus its value at the previous snapshot.

    A delta is given only when the entity was also present in the
    instance's previous snapshot and ``guard_col`` (the request start) did
    not change; a negative delta is NULL except for signed metrics. For
    CPU, the thread-level delta is used when it exceeds the request-level
    delta and is positive, else the request delta when it is not negative.
    Generalises the reference's two-snapshot form to n snapshots.

    Each row is equi-joined with the same entity's row in its instance's
    previous snapshot, on (instance, entity, time). The join key includes
    the snapshot time, so an entity present in every snapshot of a long
    history is not a hot key (a ``lag`` window over the entity would put
    its whole history in one task); the small snapshot list supplies the
    previous time.
    """
    ik, ek = list(instance_keys), list(entity)
    if "prev_collection_time" not in df.columns:
        df = with_previous_snapshot_time(df, ik, time_col)
    ms = [m for m in metrics if m in df.columns]
    cpu_cols = [c for c in (cpu or ()) if c in df.columns] if cpu and cpu[0] in df.columns else []
    carried = list(dict.fromkeys(ms + cpu_cols + ([guard_col] if guard_col else [])))
    prev = df.select(*ik, *ek, F.col(time_col).alias("prev_collection_time"),
                     F.lit(True).alias("_found"),
                     *[F.col(c).alias(f"_prev_{c}") for c in carried])
    j = df.join(prev, on=[*ik, *ek, "prev_collection_time"], how="left")
    valid = F.coalesce(F.col("_found"), F.lit(False))
    if guard_col:
        valid = valid & F.col(guard_col).eqNullSafe(F.col(f"_prev_{guard_col}"))
    out = j.withColumn("_valid", valid)
    for m in ms:
        d = F.col(m) - F.col(f"_prev_{m}")
        keep = F.col("_valid") if m in SIGNED_METRICS else (F.col("_valid") & (d >= 0))
        out = out.withColumn(f"{m}_delta", F.when(keep, d))
    if cpu_cols:
        c, t = cpu
        cd = F.col(c) - F.col(f"_prev_{c}")
        td = (F.col(t) - F.col(f"_prev_{t}")) if t in cpu_cols else F.lit(None).cast("bigint")
        out = out.withColumn(f"{c}_delta", F.when(
            F.col("_valid"), F.when((td > cd) & (td > 0), td).when(cd >= 0, cd)))
    return out.drop("_valid", "_found", *[f"_prev_{c}" for c in carried])


def counter_usage(df: DataFrame, counter_keys: Sequence[str], value_cols: Sequence[str],
                  time_col: str = "collection_time") -> DataFrame:
    """Usage of cumulative counters between consecutive readings of the
    same counter (e.g. wait time per wait type and server). A counter that
    fell was reset (server restart) and gives NULL; the first reading has no
    interval. Adds ``interval_ms`` and ``<value>_used``."""
    if not counter_keys:
        raise ValueError("counter_usage needs the counter's key columns")
    w = Window.partitionBy(*counter_keys).orderBy(time_col)
    prev_t = F.lag(time_col).over(w)
    out = df.withColumn("interval_ms", F.when(prev_t.isNotNull(),
                                               F.timestamp_diff("MILLISECOND", prev_t, F.col(time_col))))
    for v in value_cols:
        d = F.col(v) - F.lag(v).over(w)
        out = out.withColumn(f"{v}_used", F.when(d >= 0, d))
    return out
