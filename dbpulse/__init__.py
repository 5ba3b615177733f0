"""dbpulse: database-server telemetry analytics on Spark.

Every operator takes DataFrames of diagnostic snapshots keyed by
``(instance_id, collection_time)`` (or any key list the caller names) and
returns a DataFrame. Nothing is collected to the driver; the only eager
points are the rounds of the iterative graph walks, which cut lineage with
``DataFrame.checkpoint`` into the session's ``spark.checkpoint.dir``.
"""

__version__ = "0.1.0"
