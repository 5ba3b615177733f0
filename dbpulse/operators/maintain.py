"""User-level table maintenance derived from the scheduled jobs: column
profiles (M1), compaction bands (M2), integrity counts (M3) and the line
tokenizer of the help printer (M4)."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dbpulse.functions import scalars as S
from dbpulse.session import cut_lineage

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)
_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _distinct_key(f: T.StructField):
    """A string that is equal exactly when the values are equal (``-0.0``
    and ``0.0`` compare equal, so they share a key; nested values are written
    as JSON, which keeps ``["a, b"]`` and ``["a", "b"]`` apart)."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v"))))
    if isinstance(f.dataType, T.BinaryType):
        return F.hex(c)
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)
    return c.cast("string")


def column_profile(df: DataFrame, table_name: str, exact_distinct: bool = False) -> DataFrame:
    """M1: one row per column — rows, NULLs, distinct values, min and max.

    Pass 1 computes rows, NULLs, min and max of every column in one
    aggregation. Distinct counts: exact mode unpivots (column, value) pairs
    and counts distinct pairs per column — a single shuffle of values
    already de-duplicated map-side, instead of one input expansion per
    column; approximate mode uses HyperLogLog++ in pass 1.
    """
    fields = list(df.schema.fields)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs += [F.sum(F.when(c.isNull(), 1).otherwise(0)).alias(f"n{i}"),
                 F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        if not exact_distinct:
            aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
    one = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        num = isinstance(f.dataType, _NUMERIC)
        tim = isinstance(f.dataType, _TIME)
        txt = not (num or tim)
        rows.append(F.struct(
            F.lit(f.name).alias("column_name"),
            F.col(f"n{i}").cast("bigint").alias("null_count"),
            (F.col(f"d{i}").cast("bigint") if not exact_distinct else F.lit(None).cast("bigint"))
            .alias("distinct_count"),
            (F.col(f"lo{i}").cast("double") if num else F.lit(None).cast("double")).alias("min_num"),
            (F.col(f"hi{i}").cast("double") if num else F.lit(None).cast("double")).alias("max_num"),
            (F.col(f"lo{i}").cast("timestamp_ntz") if tim else F.lit(None).cast("timestamp_ntz")).alias("min_time"),
            (F.col(f"hi{i}").cast("timestamp_ntz") if tim else F.lit(None).cast("timestamp_ntz")).alias("max_time"),
            (F.col(f"lo{i}").cast("string") if txt else F.lit(None).cast("string")).alias("min_text"),
            (F.col(f"hi{i}").cast("string") if txt else F.lit(None).cast("string")).alias("max_text")))
    prof = (one.select(F.lit(table_name).alias("table_name"), F.col("_rows").alias("row_count"),
                       F.explode(F.array(*rows)).alias("p"))
            .select("table_name", "row_count", "p.*"))
    if not exact_distinct:
        return prof
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), _distinct_key(f).alias("v")) for f in fields]))
        .alias("kv")).select("kv.column_name", "kv.v").filter(F.col("v").isNotNull())
    distinct = (pairs.distinct().groupBy("column_name")
                .agg(F.count(F.lit(1)).alias("_d")))
    return (prof.join(distinct, on="column_name", how="left")
            .withColumn("distinct_count", F.coalesce(F.col("_d"), F.lit(0)).cast("bigint"))
            .select("table_name", "row_count", "column_name", "null_count", "distinct_count",
                    "min_num", "max_num", "min_time", "max_time", "min_text", "max_text"))


def profile_sketches(df: DataFrame, table_name: str, part: Column | None = None) -> DataFrame:
    """M1, mergeable: one row per part and column of ``df`` that later ones can be added
    to: rows, NULLs, least and greatest value, and a HyperLogLog sketch of the
    distinct values. One pass, one aggregation by ``part`` (a day, a partition;
    one part if not given), so a part that is profiled again takes its old rows' place.
    """
    fields = list(df.schema.fields)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"k{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
                 F.hll_sketch_agg(_distinct_key(f)).alias(f"s{i}")]
    rows = []
    for i, f in enumerate(fields):
        num, tim = isinstance(f.dataType, _NUMERIC), isinstance(f.dataType, _TIME)
        as_ = lambda on, c, kind: (F.col(c) if on else F.lit(None)).cast(kind)
        rows.append(F.struct(
            F.lit(f.name).alias("column_name"), (F.col("_rows") - F.col(f"k{i}")).alias("null_count"),
            F.col(f"s{i}").alias("sketch"),
            *[as_(on, f"{side}{i}", kind).alias(f"{name}_{what}") for what, on, kind in (
                ("num", num, "double"), ("time", tim, "timestamp_ntz"), ("text", not (num or tim), "string"))
              for name, side in (("min", "lo"), ("max", "hi"))]))
    parts = df.groupBy((F.lit("") if part is None else part).alias("_part")).agg(*aggs)
    return (parts.select(F.lit(table_name).alias("table_name"), F.col("_part").alias("part"),
                         F.col("_rows").alias("row_count"), F.explode(F.array(*rows)).alias("p"))
            .select("table_name", "part", "row_count", "p.*"))


def merge_profiles(sketches: DataFrame, by: Sequence[str] = ("table_name", "column_name")) -> DataFrame:
    """M1: the profile of all parts together, from their sketches alone. The
    sketch of a union is the union of the sketches, so parts profiled one at a
    time give what one pass over everything gives. ``distinct_count`` is the
    sketch's estimate (within some percent; merged sketches round otherwise)."""
    least = lambda c: F.min(c).alias(c)
    most = lambda c: F.max(c).alias(c)
    merged = sketches.groupBy(*by).agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.hll_union_agg("sketch").alias("sketch"), *[least(f"min_{k}") for k in ("num", "time", "text")],
        *[most(f"max_{k}") for k in ("num", "time", "text")])
    return merged.withColumn("distinct_count", F.hll_sketch_estimate("sketch")).drop("sketch")


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """M1: every table's exact column profile in one row set."""
    parts = [column_profile(df, name, exact_distinct=True) for name, df in tables.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def integrity_counts(checks: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """M3: union of (check, table, violations) rows; build the inputs with
    ``duplicate_keys``, ``null_keys`` and ``orphan_keys``."""
    parts = [df.select(F.lit(check).alias("check_name"), F.lit(table).alias("table_name"),
                       F.col("violations").cast("bigint"))
             for check, table, df in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once (count of such keys)."""
    return (df.groupBy(*key).count().filter(F.col("count") > 1)
            .agg(F.count(F.lit(1)).alias("violations")))


def null_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    cond = F.lit(False)
    for k in key:
        cond = cond | F.col(k).isNull()
    return df.agg(F.sum(F.when(cond, 1).otherwise(0)).alias("violations")) \
             .select(F.coalesce("violations", F.lit(0)).alias("violations"))


def orphan_keys(child: DataFrame, child_key: Sequence[str], parent: DataFrame,
                parent_key: Sequence[str]) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent.

    Child rows are first counted per key (partial aggregation map-side), so
    a hot key that holds a third of all rows crosses the shuffle as one
    row; the per-key counts are then anti-joined with the parent's
    distinct keys and summed.
    """
    p = parent.select(*[F.col(pk).alias(ck) for pk, ck in zip(parent_key, child_key)]).distinct()
    per_key = child.select(*child_key).dropna().groupBy(*child_key).agg(F.count(F.lit(1)).alias("_n"))
    return (per_key.join(p, on=list(child_key), how="left_anti")
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations")))


def file_fragmentation(spark: SparkSession, path: str, partition_cols: Sequence[str],
                       target_file_bytes: int = 128 * 1024 * 1024) -> DataFrame:
    """M2 measure: per partition, file count and the share (%) of files
    below half the target size. Reads only file metadata columns."""
    df = spark.read.parquet(path)
    files = (df.select(*partition_cols, F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_size").alias("size")).distinct())
    small = F.when(F.col("size") < target_file_bytes // 2, 1).otherwise(0)
    return (files.groupBy(*partition_cols)
            .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
                 (F.sum(small) * 100.0 / F.count(F.lit(1))).alias("small_file_pct")))


def compaction_band(pct: float, low: float = 5, high: float = 30) -> str:
    """M2 bands: below ``low`` nothing, up to ``high`` a light rewrite
    (coalesce), above it a full rewrite (repartition)."""
    if pct < low:
        return "none"
    return "coalesce" if pct <= high else "repartition"


def text_blocks(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                scrub: bool = True) -> DataFrame:
    """M4 + C2: each text's blocks of consecutive non-blank lines, a row each:
    (id, block_no, lines), lines an array of (line_no, line).

    All of it happens inside the task that read the text, without an exchange
    and in time linear in the text: its lines are numbered (a blank one
    becomes ``-``, which no numbered line is), joined again and split at the
    blank ones, so the place of a part is its block number.
    """
    t = S.scrub_control(F.col(text_col)) if scrub else F.col(text_col)
    numbered = F.transform(F.split(t, "\n"), lambda x, i: F.when(F.trim(x) == "", F.lit("-")).otherwise(
        F.concat((i + 1).cast("string"), F.lit("\t"), F.trim(x))))
    blocks = texts.select(F.col(id_col), F.posexplode(F.split(F.array_join(numbered, "\n"), "(?md)^-$"))
                          .alias("_block", "_text"))
    lines = F.transform(F.filter(F.split("_text", "\n"), lambda x: x != ""), lambda x: F.struct(
        F.substring_index(x, "\t", 1).cast("int").alias("line_no"), F.substr(x, F.instr(x, "\t") + 1).alias("line")))
    return (blocks.select(id_col, (F.col("_block") + 1).cast("bigint").alias("block_no"), lines.alias("lines"))
            .where(F.size("lines") > 0))


def text_lines(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               scrub: bool = True) -> DataFrame:
    """M4 + W15: the lines of :func:`text_blocks`, numbered within their block,
    each with its block's first line (the header) copied to it."""
    blocks = text_blocks(texts, id_col, text_col, scrub)
    return (blocks.select(id_col, "block_no", F.col("lines")[0]["line"].alias("header"),
                          F.posexplode("lines").alias("_place", "_l"))
            .select(id_col, "_l.line_no", "_l.line", "block_no", (F.col("_place") + 1).alias("line_in_block"), "header"))


def compact_partitions(spark: SparkSession, path: str, partition_cols: Sequence[str],
                       target_file_bytes: int = 128 * 1024 * 1024, low: float = 5,
                       high: float = 30) -> DataFrame:
    """M2 rewrite in two bands, by the share of small files of a partition.

    Below ``low`` a partition is left alone. Up to ``high`` ("light") its files
    are merged without a shuffle: input splits are coalesced to as many tasks
    as the band's partitions need files, and sorted by partition so that a task
    writes few. Above it ("full") its rows are dealt anew over ``ceil(bytes /
    target)`` files by a deterministic hash, so a retried task writes the same
    files. Each band is one Spark write with dynamic partition overwrite, which
    replaces the partitions it holds when the job commits and no others;
    readers see the old files until then. Returns the stats.
    """
    stats = file_fragmentation(spark, path, partition_cols, target_file_bytes)
    band = (F.when(F.col("small_file_pct") < low, "none")
            .when(F.col("small_file_pct") <= high, "light").otherwise("full"))
    # written once before any file moves: a lazy frame would list files that the writes below replace
    stats = cut_lineage(stats.withColumn("band", band).withColumn(
        "target_files", F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(target_file_bytes)))))
    cols = list(partition_cols)
    for name in ("light", "full"):
        todo = stats.where(F.col("band") == name)
        files = todo.agg(F.sum("target_files")).first()[0]
        if not files:
            continue
        data = spark.read.parquet(path)
        marks = todo.select(*[F.col(c).alias(f"_p_{c}") for c in cols], "target_files")
        same = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in cols]
        chosen = data.join(marks, on=same, how="inner")
        if name == "light":
            chosen = chosen.coalesce(int(files))
        else:
            chosen = chosen.repartition(*cols, F.pmod(F.hash(*data.columns), F.col("target_files")))
        (chosen.select(*data.columns).sortWithinPartitions(*cols).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(*cols).parquet(path))
        spark.catalog.refreshByPath(path)
    return stats


def block_pivot(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per block of :func:`text_blocks`, its two kinds of line
    (header, first detail) side by side, and its line count."""
    return blocks.select(id_col, "block_no", F.get("lines", F.lit(0))["line"].alias("header"),
                         F.get("lines", F.lit(1))["line"].alias("first_detail"),
                         F.size("lines").cast("bigint").alias("lines"))
