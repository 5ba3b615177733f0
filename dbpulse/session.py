"""Session construction and lineage cutting."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults chosen for a cluster: AQE re-plans joins and coalesces small
# shuffle partitions at run time, skew join splits hot keys, and the UI
# stays off (no server is opened by our jobs).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # state with timers (T2) needs this store; it also keeps state off the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "dbpulse", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in CLUSTER_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The folder comes from the running context or from
    ``spark.checkpoint.dir``. Only a local-mode session (tests) with neither
    set gets a fresh scratch folder; on a cluster a missing setting is an
    error, because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir is not set; iterative operators "
                           "need a shared checkpoint folder on a cluster")
    path = tempfile.mkdtemp(prefix="dbpulse-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and return a DataFrame that reads it back.

    Same guarantees as ``DataFrame.checkpoint`` (a lost executor re-reads
    the table, lineage is cut), but the plan runs once: ``checkpoint`` on an
    unpersisted frame computes it twice (one job to count, one to write).
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/dbpulse-tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._table_path = path
    for made in _SCOPES:
        made.append(out)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut_lineage`, once no plan reads it any more."""
    path = getattr(df, "_table_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_SCOPES: list[list[DataFrame]] = []


@contextlib.contextmanager
def table_scope():
    """Delete at its end all tables that :func:`cut_lineage` makes inside.

    For jobs whose result is written elsewhere before the scope ends; a
    DataFrame that reads such a table must not be used after it.
    """
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for df in made:
            drop_table(df)
