"""Exact duplicates: group by a 128-bit content hash, compare bytes, keep the smallest id.

Two texts are equal when identical after every run of blank characters
(space, tab to carriage return) became one space. The comparison groups by
(hash, text): Spark pre-aggregates on the map side, so a text that a third of
all rows share reaches the shuffle once per map task, and equality of the
grouping key is equality of bytes. Rows get their answer through a join on
the hash alone, against the groups that say something (two rows or more);
only hashes that really hold several texts are joined by text as well.

Defined cases: a null text counts as empty; empty texts equal one another; a
null doc_id never wins against another id, and a group without any id keeps
all its rows' null; rows that repeat a doc_id and a text are one document
(all say the same, the filter keeps one of them); an empty table gives an
empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dbpulse.llm.common import cut, pick, positional, restored

BLANKS = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def content_hash(norm: Column) -> Column:
    """128 bits, as 16 bytes."""
    return F.unhex(F.md5(norm))


def text_groups(ids_hashes_texts: DataFrame) -> DataFrame:
    """(h, variants, keep_id, group_size) of every hash that has two rows or more.

    ``variants`` counts the different texts behind the hash; with more than
    one, ``keep_id`` and ``group_size`` mean nothing and the texts decide.
    """
    by_text = ids_hashes_texts.groupBy("h", "norm").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return (by_text.groupBy("h").agg(F.count(F.lit(1)).alias("variants"), F.min("keep_id").alias("keep_id"),
                                     F.sum("group_size").alias("group_size"))
            .where("group_size > 1"))


def exact_groups(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    base = (pick(docs, "doc_id", "text").select("doc_id", normalised(F.col("text")).alias("norm"))
            .withColumn("h", hash_of(F.col("norm"))))
    groups = cut(text_groups(base))
    rows = base.withColumn("text_sha256", F.sha2("norm", 256))
    plain = groups.where("variants = 1").drop("variants")
    clashing = groups.where("variants > 1").select("h")
    if clashing.isEmpty():
        joined = rows.drop("norm").join(plain, "h", "left")
    else:
        texts = (base.join(clashing, "h", "left_semi").groupBy("h", "norm")
                 .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
        joined = (rows.join(clashing, "h", "left_anti").drop("norm").join(plain, "h", "left")
                  .unionByName(rows.join(texts, ["h", "norm"]).drop("norm")))
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``docs``, all columns, without the rows that repeat another row's text."""
    flat, own = positional(docs)
    flat = flat.withColumn("__norm", normalised(own["text"])).withColumn("h", hash_of(F.col("__norm")))
    slim = flat.select(own["doc_id"].alias("doc_id"), "h", F.col("__norm").alias("norm"))
    groups = cut(text_groups(slim))
    if groups.where("variants > 1").isEmpty():
        keys, named = ["h"], groups.select(F.col("h").alias("__h"), "keep_id")
        same = F.col("h") == F.col("__h")
    else:  # the hash clashes: the text belongs to the key
        keys = ["h", "__norm"]
        named = slim.groupBy(F.col("h").alias("__h"), F.col("norm").alias("__n")).agg(F.min("doc_id").alias("keep_id"))
        same = (F.col("h") == F.col("__h")) & (F.col("__norm") == F.col("__n"))
    kept = (flat.join(named, same, "left")
            .where(F.col("__h").isNull() | own["doc_id"].eqNullSafe(F.col("keep_id"))))
    repeats = (slim.join(groups, "h").where(F.col("doc_id").eqNullSafe(F.col("keep_id")) | (F.col("variants") > 1))
               .groupBy("h", "norm", "doc_id").count().where("count > 1"))
    if not repeats.isEmpty():  # the same row, twice or more
        kept = kept.withColumn("__id", own["doc_id"]).dropDuplicates([*keys, "__id"])
    return restored(kept, docs.columns)


