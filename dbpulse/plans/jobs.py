"""The scheduled collection jobs as batch Spark jobs.

Each job writes its collections into leaf folders of their own in a Parquet
history (a rerun of a collection overwrites its leaf and touches nothing
else) and then applies the retention of its history.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dbpulse.functions import scalars as S
from dbpulse.operators.waits import wait_pareto
from dbpulse.plans.options import ReportOptions
from dbpulse.plans.report import activity_report
from dbpulse.session import table_scope
from dbpulse.sources import history

WAIT_RETENTION_DAYS = 30
ACTIVITY_RETENTION_DAYS = 30
JOB_HISTORY_RETENTION_DAYS = 60


def latest_snapshot(rows: DataFrame, keys, as_of: dt.datetime) -> DataFrame:
    """The rows of each key's latest snapshot at or before ``as_of``; rows
    without a ``collection_time`` are one snapshot already."""
    if "collection_time" not in rows.columns:
        return rows
    keys = [k for k in keys if k in rows.columns and k != "collection_time"]
    past = rows.where(F.col("collection_time").cast("timestamp_ntz") <= F.lit(as_of).cast("timestamp_ntz"))
    if not keys:
        past, keys = past.withColumn("_all", F.lit(0)), ["_all"]
    last = past.groupBy(*keys).agg(F.max("collection_time").alias("collection_time"))
    return past.join(last, on=[*keys, "collection_time"], how="left_semi").drop("_all")


def wait_rollup_job(spark: SparkSession, wait_stats: DataFrame, history_path: str,
                    as_of: dt.datetime, keys=("instance_id",),
                    retention_days: int = WAIT_RETENTION_DAYS) -> DataFrame:
    """T4 + K1 + T5: the daily wait roll-up of every server's counters,
    stamped with the minute of ``as_of``, appended, then old days purged.
    Counters are cumulative, so only each server's latest snapshot counts."""
    pareto = wait_pareto(latest_snapshot(wait_stats, keys, as_of), keys=list(keys))
    rows = history.wait_history_rows(pareto, F.lit(as_of).cast("timestamp_ntz"))
    rows = history._conform(rows, history.WAIT_HISTORY_SCHEMA)
    history.append_collection(spark, rows, history_path)
    history.purge_partitions(spark, history_path, as_of, retention_days)
    return history.read_history(spark, history_path, history.WAIT_HISTORY_SCHEMA)


def activity_collection_job(spark: SparkSession, sources: Mapping[str, DataFrame], history_path: str,
                            as_of: dt.datetime, options: ReportOptions | None = None,
                            retention_days: int = ACTIVITY_RETENTION_DAYS) -> DataFrame:
    """T3 + K2 + T5: one collection of the activity report (transaction
    info, outer command and plans on, as the scheduled job asks) appended
    by column name, then rows older than ``retention_days`` purged.

    Sources that hold several snapshots give their servers' latest one at or
    before ``as_of``, and its rows keep their own collection time; sources
    without one are stamped with ``as_of``."""
    o = options or ReportOptions(get_transaction_info=True, get_outer_command=True, get_plans=1,
                                 format_output=0, output_column_list="[%]")
    as_of_c = F.lit(as_of).cast("timestamp_ntz")
    stamped = "collection_time" in sources["processes"].columns
    if stamped:
        own = [k for k in o.keys if k in sources["processes"].columns and k != "collection_time"]
        chosen = sources["processes"].where(F.col("collection_time").cast("timestamp_ntz") <= as_of_c)
        if o.delta_interval > 0:  # the snapshots before are the deltas' base
            o = dataclasses.replace(o, latest_snapshot_only=True)
        else:
            chosen = latest_snapshot(chosen, own, as_of)
        chosen = chosen.select(*own, "collection_time").distinct()
        of_chosen = lambda df: df.join(chosen, on=[*own, "collection_time"], how="left_semi")
        sources = {n: of_chosen(df) if {*own, "collection_time"} <= set(df.columns) else df
                   for n, df in sources.items()}
    with table_scope():
        rep = activity_report(sources, dataclasses.replace(o, sort_order=""), as_of=None if stamped else as_of_c)
        rep = (rep.withColumn("elapsed_text", S.elapsed_text(S.elapsed_ms(F.col("start_time"), F.col("collection_time"))))
               .withColumn("collection_date", F.to_date(F.col("collection_time"))))
        if "instance_id" not in rep.columns:
            rep = rep.withColumn("instance_id", F.lit(None).cast("string"))
        history.append_collection(spark, history._conform(rep, history.ACTIVITY_HISTORY_SCHEMA), history_path)
    history.purge_partitions(spark, history_path, as_of, retention_days)
    return history.read_history(spark, history_path, history.ACTIVITY_HISTORY_SCHEMA)
