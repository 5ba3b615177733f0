"""History tables: schemas (K6), appends (K1, K2), first-row-wins dedup
(K4), result DDL (K5) and retention (K7)."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dbpulse.functions import scalars as S

# K6: the wait roll-up history row (the identity column is not needed on
# Parquet; a row number within the write batch can stand in for it).
WAIT_HISTORY_SCHEMA = T.StructType([
    T.StructField("instance_id", T.StringType(), True),
    T.StructField("collection_time", T.TimestampNTZType(), True),
    T.StructField("wait_type", T.StringType(), True),
    T.StructField("wait_time_s", T.DecimalType(16, 2), True),
    T.StructField("cpu_delay_s", T.DecimalType(16, 2), True),
    T.StructField("signal_wait_time_s", T.DecimalType(16, 2), True),
    T.StructField("waiting_tasks", T.IntegerType(), True),
    T.StructField("wait_percent", T.DecimalType(5, 2), True),
    T.StructField("avg_wait_time_s", T.DecimalType(16, 2), True),
    T.StructField("avg_cpu_delay_s", T.DecimalType(16, 2), True),
    T.StructField("avg_signal_wait_time_s", T.DecimalType(16, 2), True),
    T.StructField("collection_date", T.DateType(), True),
])

# K6: the activity history row. Counters stay numeric (formatting is a
# presentation step), names are written by name, not by position.
ACTIVITY_HISTORY_SCHEMA = T.StructType([
    T.StructField("instance_id", T.StringType(), True),
    T.StructField("elapsed_text", T.StringType(), True),
    T.StructField("session_id", T.LongType(), False),
    T.StructField("sql_text", T.StringType(), True),
    T.StructField("sql_command", T.StringType(), True),
    T.StructField("login_name", T.StringType(), False),
    T.StructField("wait_info", T.StringType(), True),
    T.StructField("tran_log_writes", T.StringType(), True),
    T.StructField("CPU", T.LongType(), True),
    T.StructField("tempdb_allocations", T.LongType(), True),
    T.StructField("tempdb_current", T.LongType(), True),
    T.StructField("blocking_session_id", T.LongType(), True),
    T.StructField("reads", T.LongType(), True),
    T.StructField("writes", T.LongType(), True),
    T.StructField("physical_reads", T.LongType(), True),
    T.StructField("query_plan", T.StringType(), True),
    T.StructField("used_memory", T.LongType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("tran_start_time", T.TimestampNTZType(), True),
    T.StructField("open_tran_count", T.LongType(), True),
    T.StructField("percent_complete", T.FloatType(), True),
    T.StructField("host_name", T.StringType(), True),
    T.StructField("database_name", T.StringType(), True),
    T.StructField("program_name", T.StringType(), True),
    T.StructField("start_time", T.TimestampNTZType(), False),
    T.StructField("login_time", T.TimestampNTZType(), True),
    T.StructField("request_id", T.LongType(), True),
    T.StructField("collection_time", T.TimestampNTZType(), False),
    T.StructField("collection_date", T.DateType(), True),
])


def wait_history_rows(pareto: DataFrame, collection_time: Column) -> DataFrame:
    """K1 row shape: the stored time has minute precision (rounded, C22) and
    the averages, computed at 4 decimals, are stored at 2 — they round twice
    (0.00496 -> 0.0050 -> 0.01)."""
    t = S.round_to_minute(collection_time.cast("timestamp_ntz"))
    return pareto.select(
        F.col("instance_id").cast("string").alias("instance_id"), t.alias("collection_time"),
        "wait_type", "wait_time_s", "cpu_delay_s", "signal_wait_time_s",
        F.col("waiting_tasks").cast("int").alias("waiting_tasks"), "wait_percent",
        F.col("avg_wait_time_s").cast("decimal(16,2)").alias("avg_wait_time_s"),
        F.col("avg_cpu_delay_s").cast("decimal(16,2)").alias("avg_cpu_delay_s"),
        F.col("avg_signal_wait_time_s").cast("decimal(16,2)").alias("avg_signal_wait_time_s"),
        F.to_date(t).alias("collection_date"))


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def overwrite_date_partitions(df: DataFrame, path: str, schema: T.StructType | None = None,
                              partition_col: str = "collection_date") -> None:
    """Replace exactly the date partitions present in ``df`` (dynamic
    partition overwrite), writing columns by name. Other dates are kept.
    Use ``append_collection`` to add rows to a date that already has some."""
    out = _conform(df, schema) if schema is not None else df
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_col).parquet(path))


LEAF = "collection"
LEAF_TIME = "yyyyMMdd'T'HHmmss.SSSSSS"


def leaf_name(key_cols: Sequence[str], schema: T.StructType, salt: str = "") -> Column:
    """The name of a collection's folder: its time first, then the other keys
    (``=`` and the value, ``-`` for NULL), then ``salt``."""
    kinds = {f.name: f.dataType for f in schema.fields}
    timed = [k for k in key_cols if isinstance(kinds[k], (T.TimestampType, T.TimestampNTZType))]
    parts = [F.coalesce(F.date_format(k, LEAF_TIME), F.lit("-")) for k in timed]
    parts += [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in key_cols if k not in timed]
    return F.concat_ws("~", *parts, *([F.lit(salt)] if salt else []))


def write_leaves(rows: DataFrame, path: str, key_cols: Sequence[str] = ("instance_id", "collection_time"),
                 partition_col: str = "collection_date", salt: str = "") -> None:
    """Write each collection of ``rows`` into a leaf folder of its own under its
    date, replacing exactly these leaves; one pass over ``rows``, nothing read."""
    keys = [k for k in key_cols if k in rows.columns]
    out = rows.withColumn(LEAF, leaf_name(keys, rows.schema, salt))
    (out.repartition(partition_col, LEAF).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_col, LEAF).parquet(path))
    rows.sparkSession.catalog.refreshByPath(path)


def read_history(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of a history, without the name of the leaf they lie in. With its
    ``schema`` a history that holds nothing yet is an empty table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).drop(LEAF)


def append_collection(spark: SparkSession, rows: DataFrame, path: str,
                      key_cols: Sequence[str] = ("instance_id", "collection_time"),
                      partition_col: str = "collection_date") -> None:
    """Idempotent append of one or more collections.

    A collection is identified by ``key_cols`` (server and time) and is the
    only content of its leaf folder ``collection_date=.../collection=...``.
    Re-running a collection (a retried job or micro-batch) overwrites its leaf
    instead of duplicating rows; other collections of the same day, other
    times or other servers, are neither read nor written, so collectors that
    run at once lose nothing of one another.
    """
    write_leaves(rows, path, key_cols, partition_col)


_PART = r'(?:\[[^\]]+\]|"[^"]+"|[A-Za-z_#@][\w@$#]*)'
_NAME = re.compile(rf"^{_PART}(?:\.{_PART}){{0,2}}$")


def check_table_name(name: str) -> str:
    """K2: a one-, two- or three-part table name; anything else is an error."""
    if not name or not _NAME.match(name.strip()):
        raise ValueError(f"destination table name is not a 1-3 part name: {name!r}")
    return ".".join(p.strip('[]"') for p in re.findall(_PART, name.strip()))


def append_to_table(df: DataFrame, name: str) -> None:
    """K2: append to a catalog table by column name."""
    target = check_table_name(name)
    spark = df.sparkSession
    if spark.catalog.tableExists(target):
        cols = spark.table(target).columns
        df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in cols]) \
          .write.insertInto(target)
    else:
        df.write.saveAsTable(target)


def first_row_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """K4: insert-ignore-duplicates: keep the first row per key under an
    explicit order (not an arbitrary ``dropDuplicates`` survivor)."""
    if not key:
        raise ValueError("first_row_wins needs a key")
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k4", F.row_number().over(w)).filter(F.col("_k4") == 1).drop("_k4")


def result_schema_ddl(df: DataFrame, table_name: str = "<table_name>") -> str:
    """K5: ``CREATE TABLE <name> ( col type [NOT NULL], ... )`` from a plan's
    schema; no data is read."""
    cols = [f"`{f.name}` {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}"
            for f in df.schema.fields]
    return f"CREATE TABLE {table_name} ( " + ", ".join(cols) + " )"


def apply_retention(df: DataFrame, time_col: str, as_of: Column, days: int) -> DataFrame:
    """K7: keep rows newer than ``as_of - days``. A delete on ``< bound``
    leaves NULL times in place, so they are kept here too."""
    bound = S.days_before(as_of, days)
    return df.filter((F.col(time_col) >= bound) | F.col(time_col).isNull())


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p, jvm


def purge_partitions(spark: SparkSession, path: str, as_of: dt.datetime, days: int,
                     time_col: str = "collection_time",
                     partition_col: str = "collection_date") -> None:
    """K7 on a date-partitioned Parquet history.

    Whole date partitions older than the bound are removed from the file
    system (metadata only, no data read), and of the one boundary date the
    leaves of collections before it, whose names tell their time. Only a
    boundary date without leaves is read (with partition pruning), filtered,
    staged next to the history and put back with dynamic partition overwrite.
    """
    bound = as_of - dt.timedelta(days=days)
    fs, root, jvm = _fs(spark, path)
    if not fs.exists(root):
        return
    prefix = f"{partition_col}="
    boundary_present = False
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if not (st.isDirectory() and name.startswith(prefix)):
            continue
        try:
            day = dt.date.fromisoformat(name[len(prefix):])
        except ValueError:
            continue
        if day < bound.date():
            fs.delete(st.getPath(), True)
            spark.catalog.refreshByPath(path)
        elif day == bound.date():
            boundary_present = True
    if not boundary_present:
        return
    first = bound.strftime("%Y%m%dT%H%M%S.%f")
    leaves = [st.getPath() for st in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{prefix}{bound.date()}"))
              if st.isDirectory() and st.getPath().getName().startswith(f"{LEAF}=")]
    if leaves:
        for leaf in leaves:
            time = leaf.getName()[len(LEAF) + 1:].split("~")[0]
            if time != "-" and time < first:
                fs.delete(leaf, True)
        spark.catalog.refreshByPath(path)
        return
    bound_c = F.lit(bound).cast("timestamp_ntz")
    part = (spark.read.parquet(path)
            .filter(F.col(partition_col) == F.lit(bound.date()))
            .filter((F.col(time_col) >= bound_c) | F.col(time_col).isNull()))
    staging = f"{path.rstrip('/')}/_staging_{uuid.uuid4().hex}"
    part.write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    if staged.isEmpty():
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{prefix}{bound.date()}"), True)
    else:
        overwrite_date_partitions(staged, path, partition_col=partition_col)
    fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
    spark.catalog.refreshByPath(path)
