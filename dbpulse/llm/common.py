"""Shared helpers: column picking, tables in the shared folder, bounded samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dbpulse.session import ensure_checkpoint_dir


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the columns ``names``, by their exact spelling.

    Extra columns, also such that differ from a wanted one by case only,
    cannot make a reference ambiguous: columns are renamed by position first.
    """
    own = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(own))])
    return flat.select(*[F.col(f"c{own.index(n)}").alias(n) for n in names])


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with columns ``c0, c1, ...`` and the column of each own name
    (the first one where a name repeats)."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    by_name: dict[str, Column] = {}
    for i, n in enumerate(df.columns):
        by_name.setdefault(n, F.col(f"c{i}"))
    return flat, by_name


def restored(flat: DataFrame, names: list[str]) -> DataFrame:
    """Undo :func:`positional`: only ``c0..cn``, under their old names."""
    return flat.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared checkpoint folder that the session names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan runs once and its lineage ends in files that every executor
    sees, so a lost executor costs a re-read and no recomputation.
    """
    path = shared_path(df.sparkSession, "cut")
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Delete the files of a table made by :func:`cut` that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has fewer), by a hash of ``key``.

    The same rows for the same table whatever its partitioning. Used only to
    bound what a classifier is fitted on.
    """
    total = df.count()
    if total <= rows:
        return df
    cells = 1 << 30
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(cells)) < int(cells * rows / total))


def exclusive_prefix(totals: DataFrame, key: str, idx: str, value: str, out: str,
                     size: int, radix: int = 256) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the same key's smaller ``idx``.

    ``totals`` has at most one row for each (key, idx), idx in [0, size). A
    radix tree keeps every window at ``radix`` rows or fewer, so one key with
    most of the rows is still summed by many tasks.
    """
    before = F.coalesce(F.sum(value).over(
        Window.partitionBy(key, "__up").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if size <= radix:
        return totals.withColumn("__up", F.lit(0)).withColumn(out, before).drop("__up")
    k, u, base = f"{key}_", f"{idx}_", f"{out}_"
    local = totals.withColumn("__up", F.floor(F.col(idx) / F.lit(radix))).withColumn(out, before)
    sums = local.groupBy(F.col(key).alias(k), F.col("__up").alias(u)).agg(F.sum(value).alias("__sum"))
    upper = exclusive_prefix(sums, k, u, "__sum", base, -(-size // radix), radix).drop("__sum")
    return (local.join(upper, F.col(key).eqNullSafe(F.col(k)) & (F.col("__up") == F.col(u)), "left")
            .withColumn(out, F.col(out) + F.coalesce(base, F.lit(0))).drop("__up", k, u, base))
