"""The nested record of a request (C42, J18, C10, C12, P11): its settings, the
lock it waits for with names, and the agent job it belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dbpulse.functions import scalars as S
from dbpulse.operators import locks
from dbpulse.operators.sessions import ON_OFF_ATTRIBUTES

SETTINGS = ("text_size", "language", "date_format", "date_first", *ON_OFF_ATTRIBUTES, "transaction_isolation_level",
            "lock_timeout", "deadlock_priority", "row_count", "command_type")
HANDLES = ("sql_handle", "plan_handle")
PROCESS = ("host_process_id", "group_id")


def named_block_info(waits: DataFrame, partitions: DataFrame | None = None, objects: DataFrame | None = None,
                     schemas: DataFrame | None = None, databases: DataFrame | None = None,
                     keys: Sequence[str] = (), catalog_keys: Sequence[str] | None = None) -> DataFrame:
    """(keys, session_id, request_id, block_info): the lock record (C42) of the
    requests that have one, with database, schema and object names (J18, C2)
    where the catalog tells them."""
    keys = list(keys)
    at = [*keys, "session_id", "request_id"]
    b = waits.where(F.col("block_info").isNotNull()).select(*at, "block_info")
    if databases is not None:
        scope = list(keys if catalog_keys is None else catalog_keys)
        dbs = databases.select(*scope, F.col("database_id").alias("_db"), F.col("name").alias("_db_name"))
        same = [F.col(f"b.{k}") == F.col(f"d.{k}") for k in scope] + [F.col("b.block_info.database_id") == F.col("d._db")]
        b = b.alias("b").join(dbs.alias("d"), on=same, how="left").select(*[F.col(f"b.{c}") for c in b.columns], "_db_name")
    else:
        b = b.withColumn("_db_name", F.col("block_info.database_id").cast("string"))
    if partitions is not None and objects is not None and schemas is not None:
        names = locks.blocked_object_names(b, partitions, objects, schemas, keys, catalog_keys)
        b = b.join(names.select(*at, "schema_name", "object_name"), on=at, how="left")
    else:
        b = b.withColumns({c: F.lit(None).cast("string") for c in ("schema_name", "object_name")})
    info = "block_info"
    return b.select(*at, F.struct(
        F.col(f"{info}.lock_type"), S.scrub_control(F.col("_db_name")).alias("database_name"),
        *[F.col(f"{info}.{c}") for c in ("object_id", "file_id", "hobt_id", "applock_hash", "metadata_resource",
                                         "metadata_class_id")],
        S.scrub_control(F.col("schema_name")).alias("schema_name"),
        S.scrub_control(F.col("object_name")).alias("object_name")).alias("block_info"))


def _handle(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return S.handle_hex(F.col(c)) if kind in ("binary", "bigint", "int") else F.col(c)


def additional_info(rows: DataFrame, block_info: DataFrame | None = None, agent: DataFrame | None = None,
                    keys: Sequence[str] = ()) -> DataFrame:
    """(keys, session_id, request_id, additional_info): one typed record of a
    request. ``rows`` holds the overlaid settings (those present become
    fields), ``block_info`` the result of :func:`named_block_info`, ``agent``
    that of ``jobs.agent_job_info``. Both are joined left, one row a request."""
    keys = list(keys)
    at = [*keys, "session_id", "request_id"]
    fields = [F.col(c) for c in SETTINGS if c in rows.columns]
    fields += [_handle(rows, c).alias(c) for c in HANDLES if c in rows.columns]
    out = rows
    if agent is not None:
        job = F.struct("job_id", "step_id", S.scrub_control(F.col("job_name")).alias("job_name"),
                       S.scrub_control(F.col("step_name")).alias("step_name"))
        out = out.join(agent.select(*at, F.when(F.col("job_id").isNotNull(), job).alias("agent_job_info")), on=at, how="left")
        fields.append(F.col("agent_job_info"))
    if block_info is not None:
        out = out.join(block_info.select(*at, "block_info"), on=at, how="left")
        fields.append(F.col("block_info"))
    fields += [F.col(c) for c in PROCESS if c in rows.columns]
    if not fields:
        return out.select(*at, F.lit(None).cast("struct<row_count:bigint>").alias("additional_info"))
    return out.select(*at, F.struct(*fields).alias("additional_info"))
