"""Mixing sources to target weights, by blocks of fixed length.

A source's documents lie one after the other in a stream of words; the stream
is packed into blocks of ``block_words`` words (the last may be shorter). The
mix is drawn in output shards of ``shard_slots`` slots: every slot draws its
source with the sources' probabilities (a multinomial draw, stratified over
the slots of a shard so that its counts stay near their means), a source's
slots are numbered over all shards, and slot number n takes block
``perm(n mod blocks)``, where ``perm`` is a pseudorandom permutation of the
source's block indices, another one in each pass. Blocks are joined by index.
A source's words taken differ from its target by a few blocks, and no block
is taken more than ``cap`` times.

Everything hangs on ids and texts, never on partitions, so reruns agree. The
stream positions are prefix sums over small buckets (common.exclusive_prefix),
so a source with most of the rows is no single task.

Defined cases: null or blank texts have size 0 and are never taken; a null
source is a source of its own, the last; sources without words have target 0;
rows that repeat one another are separate rows (each is counted and placed);
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dbpulse.llm.common import cut, exclusive_prefix, pick, positional

WORDS = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
BUCKET_ROWS = 256   # rows that one prefix-sum window has about
CELLS = 1024        # cells of [0, 1) by which a draw finds its source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """(sid, source, source_size, target) from one row per (source, source_size).

    ``sid`` numbers the sources by code point, null last. Sources stop at
    ``cap`` times their size; the rest of ``share`` times all sizes is shared
    by weight. A source stops before another if its cap is smaller against
    its weight, so one pass in that order finds where the stopping ends.
    """
    n = len(weights)
    named = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weighed = named.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                 (F.col("sid") % n + 1).cast("int")))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("w"), "sid")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("source_size").cast("double")
    left = (weighed
            .withColumn("total", F.sum(size).over(whole) * share)
            .withColumn("rest", F.col("total") - F.coalesce(F.sum(size * cap).over(earlier), F.lit(0.0)))
            .withColumn("rest_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))))
    stops = size * cap * F.col("rest_w") <= F.col("w") * F.col("rest")
    open_rest = F.max(F.when(~stops, F.col("rest"))).over(whole)  # the first open source has the most left
    open_w = F.max(F.when(~stops, F.col("rest_w"))).over(whole)
    return left.select(
        F.col("sid").cast("long").alias("sid"), "source", "source_size",
        F.when(stops, size * cap).otherwise(F.col("w") * open_rest / open_w).alias("target"))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(n: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each n's place in a pseudorandom permutation of [0, size), chosen by key.

    A four-round Feistel network over the next power of four, walked until it
    falls below ``size`` (cycle walking keeps it a permutation).
    """
    n, size, key = (np.asarray(x).astype(np.uint64) for x in (n, size, key))
    bits = np.ceil(np.log2(np.maximum(size.astype(np.float64), 2)) / 2).astype(np.uint64)
    bits = np.where((np.uint64(1) << (bits * np.uint64(2))) < size, bits + np.uint64(1), bits)
    mask = (np.uint64(1) << bits) - np.uint64(1)

    def once(x, i):
        lo, hi = x & mask[i], x >> bits[i]
        for r in range(4):
            f = _mix64(lo + key[i] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019 * (r + 1) % 2**64))
            lo, hi = hi ^ (f & mask[i]), lo
        return (hi << bits[i]) | lo

    out = n.copy()
    todo = np.arange(len(n))
    with np.errstate(over="ignore"):
        while len(todo):
            out[todo] = once(out[todo], todo)
            todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def block_of(number: pd.Series, blocks: pd.Series, sid: pd.Series, seed: pd.Series) -> pd.Series:
    """The block that a source's slot ``number`` takes."""
    passes = number // blocks
    key = (sid * 1000003 + passes) * 31 + seed
    return pd.Series(permuted((number % blocks).to_numpy(), blocks.to_numpy(), key.to_numpy()))


def slot_counts(spark, sources: DataFrame, shard_slots: int, seed: int) -> tuple[DataFrame, int]:
    """(shard, sid, n): how many of a shard's slots drew each source; number of shards.

    ``sources`` has sid, blocks and target per source word; a source's slots
    are its blocks times target / size. A draw u in [0, 1) belongs to the
    source whose interval holds it, found through a grid of CELLS cells.
    """
    wanted = sources.withColumn("share", F.col("blocks") * F.col("target") / F.col("source_size"))
    total = wanted.agg(F.sum("share")).first()[0] or 0.0
    slots = round(total)
    if not slots:
        return spark.createDataFrame([], "shard long, sid long, n long"), 0
    running = Window.orderBy("sid")
    spans = wanted.select(
        "sid", (F.coalesce(F.sum("share").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
                / total).alias("lo"),
        F.when(F.lead("sid").over(running).isNull(), F.lit(2.0))
        .otherwise(F.sum("share").over(running.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("hi"))
    cells = spans.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    shards = -(-slots // shard_slots)
    uniform = F.pmod(F.xxhash64("slot", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    width = F.least(F.lit(shard_slots), F.lit(slots) - F.col("shard") * shard_slots)
    draws = (spark.range(slots, numPartitions=max(1, min(slots // 100_000, 10_000))).withColumnRenamed("id", "slot")
             .withColumn("shard", F.floor(F.col("slot") / shard_slots))
             .withColumn("u", (F.col("slot") - F.col("shard") * shard_slots + uniform) / width)
             .withColumn("cell", F.least(F.floor(F.col("u") * CELLS), F.lit(CELLS - 1))))
    counts = (draws.join(cells, "cell").where("u >= lo AND u < hi")
              .groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n")))
    return counts, shards


def mixed_blocks(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, block_words=BLOCK_WORDS,
                 shard_slots=SHARD_SLOTS, seed=7) -> DataFrame:
    """One row per row of ``docs`` and block that it reaches into.

    doc_id, place, size, source_size, target, and of the block: ``block`` (its
    index; null for rows without words), ``skip`` and ``words`` (the row's
    words before the block's and those in it), ``times`` (how often the mix
    takes the block). ``start`` is the row's place in its source's stream.
    """
    spark = docs.sparkSession
    rows = cut(pick(docs, "doc_id", "source", "text").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("place")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = cut(source_targets(sizes, weights, share, cap).withColumn(
        "blocks", F.ceil(F.col("source_size") / block_words)))
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))

    by = sources.withColumnRenamed("source", "s")
    named = rows.join(by, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    named = named.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "place", F.lit(seed)), F.lit(buckets)))
    totals = named.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    offsets = (exclusive_prefix(totals, "sid", "bucket", "n", "offset", buckets)
               .select(F.col("sid").alias("s"), F.col("bucket").alias("b"), "offset"))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "place", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (named.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(offsets, (F.col("sid") == F.col("s")) & (F.col("bucket") == F.col("b")))
              .withColumn("start", F.col("offset") + F.col("before")))
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = pieces.select("doc_id", "place", "source", "sid", "size", "source_size", "target", "start", "block",
                           (low - F.col("start")).alias("skip"), (high - low).alias("words"))

    counts, shards = slot_counts(spark, sources.where("source_size > 0"), shard_slots, seed)
    if shards:
        numbered = exclusive_prefix(counts, "sid", "shard", "n", "base", shards)
        slots = (numbered.join(sources.select(F.col("sid").alias("s"), "blocks"), F.col("sid") == F.col("s"))
                 .withColumn("number", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)))
                 .where(F.col("number") < F.col("blocks") * cap)
                 .select(F.col("sid").alias("s"), block_of("number", "blocks", "sid", F.lit(seed)).alias("index")))
        times = slots.groupBy("s", "index").agg(F.count(F.lit(1)).alias("times"))
    else:
        times = spark.createDataFrame([], "s long, index long, times long")
    return (pieces.join(times, (F.col("sid") == F.col("s")) & (F.col("block") == F.col("index")), "left")
            .drop("s", "index").withColumn("times", F.coalesce("times", F.lit(0))))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    pieces = mixed_blocks(docs, **options)
    return (pieces.groupBy("doc_id", "sid", "start", "size", "place", "source_size", "target",
                           F.when(F.col("size") == 0, F.monotonically_increasing_id()).alias("blank"))
            .agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, all columns of ``docs``: the words taken, in order.

    A document's blocks that are taken twice or more give further rows, one
    for each time, with the words taken that often; a document of which
    nothing is taken goes. Rows taken whole keep their text as it is. Where
    ``n_chars`` is a column, it counts the new text.
    """
    keys = ["doc_id", "source", "place"]
    decided = cut(mixed_blocks(docs, **options).where("times > 0")
                  .groupBy(*keys, "start", "size")
                  .agg(F.sort_array(F.collect_list(F.struct("skip", "words", "times"))).alias("parts"),
                       F.max("times").alias("most")))
    names = docs.columns
    flat, own = positional(docs)
    text = own["text"]
    rows = flat.select("*", own["doc_id"].alias("__id"), own["source"].alias("__source"),
                       F.xxhash64(text).alias("__place"))
    same = (F.col("__id").eqNullSafe(F.col("doc_id")) & F.col("__source").eqNullSafe(F.col("source"))
            & (F.col("__place") == F.col("place")))
    if not decided.groupBy(*keys).count().where("count > 1").isEmpty():  # repeated rows: match them by number
        decided = decided.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy("start")))
        rows = rows.withColumn("__copy", F.row_number().over(
            Window.partitionBy("__id", "__source", "__place").orderBy(F.lit(0))))
        same = same & (F.col("copy") == F.col("__copy"))
    passes = rows.join(decided, same).withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("most").cast("int"))))
    taken = F.filter("parts", lambda x: x["times"] >= F.col("__pass"))
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), 0)
    some = F.array_join(F.flatten(F.transform(
        taken, lambda x: F.slice(words, (x["skip"] + 1).cast("int"), x["words"].cast("int")))), "")
    whole = F.aggregate(taken, F.lit(0).cast("long"), lambda a, x: a + x["words"]) == F.col("size")
    mixed = passes.withColumn("__text", F.when(whole, text).otherwise(some))
    changed = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return mixed.select(*[changed[n].alias(f"c{i}") if n in changed and names.index(n) == i else F.col(f"c{i}")
                          for i, n in enumerate(names)]).toDF(*names)
