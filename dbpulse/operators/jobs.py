"""Agent job names for job-step sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dbpulse.functions import scalars as S


def agent_job_info(sessions: DataFrame, jobs: DataFrame, steps: DataFrame,
                   keys: Sequence[str] = ()) -> DataFrame:
    """C10 + C11 + J19: parse the job id and step from a job step's program
    name, render the id as a GUID, and attach job and step names.

    Jobs and steps are inner-joined on (job, step) first — a small
    dimension per server — and then left-joined to the sessions, so a
    session whose job is unknown keeps NULL names. Sessions that are not
    job steps get NULL throughout.
    """
    keys = list(keys)
    s = sessions.withColumn("job_hex", S.agent_job_hex(F.col("program_name"))) \
                .withColumn("step_id", S.agent_step_id(F.col("program_name")))
    names = (jobs.select(*keys, F.upper("job_hex").alias("job_hex"), "job_name")
             .join(steps.select(*keys, F.upper("job_hex").alias("job_hex"), "step_id", "step_name"),
                   on=[*keys, "job_hex"], how="inner"))
    return (s.withColumn("job_hex", F.upper("job_hex"))
            .join(names, on=[*keys, "job_hex", "step_id"], how="left")
            .withColumn("job_id", S.hex_to_guid(F.col("job_hex"))))
