"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct runs of ``k`` words (A-Z as a-z), each as
a 64-bit hash; two documents link when 100 * |A n B| >= ``percent`` * |A u B|.
Equal sets are one node of the join. The steps:

1. Tokens get one order for all documents: rare before frequent (a bounded
   table of the most frequent tokens says which these are), then by hash. Any
   order is right; this one keeps shared passages out of the prefixes. Sets
   that link must share a token of their prefixes, the first
   n - ceil(percent * n / 100) + 1 tokens of a set of n.
2. Every node is compared with the one other node that is smallest among those
   sharing the most prefix tokens; the pairs that link make the first
   components. The nodes that point to one other in this way, whether they can
   link with it or not, and are of about one size are a group of similar
   documents, cut into chunks of at most CHUNK_NODES nodes and CHUNK_TOKENS
   tokens.
3. The token-group matrix: a chunk's token union is that of its nodes'
   prefixes. Chunk meets chunk, and is opened only if the prefix tokens that
   both unions hold reach the fewest that any of their pairs needs, and not all
   nodes that hold these tokens are in one component already.
4. An opened chunk meets the nodes of the chunks that ask for it, a bounded
   part of them at a time, in one task: whole sets are compared, and of the
   links those are kept that join what was not joined before.

Step 3 covers all pairs of nodes in different components, those inside a chunk
as well, so no link that would join two components is lost; pairs inside a
component need no test.
Whole sets travel only for nodes in a comparison: a Bloom filter of fixed size
picks them in another pass over the texts. Hashes of 64 bits stand for
shingles and sets.

Defined cases: null text, or text without a word: empty set, n_shingles 0,
linked with nothing; fewer than ``k`` words: the whole sequence is the one
shingle; rows that repeat a doc_id are nodes by their texts; a null doc_id is
never a component's smallest id unless it has no other; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dbpulse.llm.common import cut, drop_cut, pick, positional, restored
from dbpulse.llm.components import components
from dbpulse.llm.textkit import Words, mix64, shingles, slices, utf8

FREQUENT = 1 << 17       # entries of the table of frequent tokens
COUNT_WINDOW = 2_000_000  # tokens that are counted together before rare ones go
CHUNK_NODES = 400        # nodes of a chunk, about
CHUNK_TOKENS = 1 << 20   # ... and tokens of their sets
SIZE_STEP = 1.1          # sets of one group differ in size by this factor at most
QUERY_PART = 512         # nodes that meet a chunk in one task, about
BLOOM_BITS = 26
_SET_A, _SET_B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _sets(part: pa.RecordBatch, column: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, token) sorted and distinct, size and node of each row."""
    data, offsets = utf8(part.column(column))
    row, token = shingles(Words(data, offsets), k)
    n = np.bincount(row, minlength=part.num_rows)
    first = np.concatenate([[0], np.cumsum(n)])
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(token ^ _SET_A))])
    node = mix64(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))
    return row, token, n, node.view(np.int64)


def frequent_tokens(texts: DataFrame, k: int, entries: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(tokens ascending, counts) of at most ``entries`` tokens that many documents have."""
    def run(batches):
        held, size = [], 0

        def counted():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

        for part in slices(batches, "text"):
            _, token, _, _ = _sets(part, 0, k)
            held.append(token)
            size += len(token)
            if size >= COUNT_WINDOW:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    counts = texts.select("text").mapInArrow(run, "token long, n long")
    top = (counts.groupBy("token").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "token").limit(entries).toArrow())  # bounded: FREQUENT rows
    token = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], top.column("n").to_numpy()[order]


def signatures(texts: DataFrame, k: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, place (a hash of the text), n, node and the prefix (the first
    tokens in the common order) of every row, its tokens outside the table of
    frequent ones as ``rare``, the others as ``often``."""
    common, often = frequent
    shared = texts.sparkSession.sparkContext.broadcast((common, often))

    def run(batches):
        common, often = shared.value
        for part in slices(batches, "text"):
            row, token, n, node = _sets(part, 1, k)
            level = np.zeros(len(token), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, token), len(common) - 1)
                level = np.where(common[at] == token, often[at], 0)
            order = np.lexsort((token, level, row))
            place = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            length = n - (percent * n + 99) // 100 + 1
            inside = place < length[row]
            prefix, own = token[order][inside].view(np.int64), row[inside]
            known = level[order][inside] > 0

            def lists(chosen):
                ends = np.cumsum(np.bincount(own[chosen], minlength=len(n)))
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(prefix[chosen]))

            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(n.astype(np.int64)), pa.array(node),
                 lists(~known), lists(known)], names=["doc_id", "place", "n", "node", "rare", "often"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", F.xxhash64("text")).mapInArrow(
        run, f"doc_id {id_type}, place long, n long, node long, rare array<long>, often array<long>")


def _positions(id_hash: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (mix64(id_hash.view(np.uint64) ^ mix64(node.view(np.uint64))) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)


def whole_sets(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, n, tokens) of the ``wanted`` (node, rep) rows, and of a few more.

    The filter has 2^BLOOM_BITS bits whatever the size of ``wanted``; rows that
    pass it by chance only cost space.
    """
    spark = texts.sparkSession

    def place(batches):
        for b in batches:
            at = _positions(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bit"])

    words = (wanted.select(F.xxhash64("rep"), "node").mapInArrow(place, "word long, bit long")
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())  # bounded: 2^(BLOOM_BITS - 6) rows
    bloom = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    bloom[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bloom)

    def run(batches):
        bloom = shared.value
        for part in slices(batches, "text"):
            row, token, n, node = _sets(part, 1, k)
            at = _positions(part.column(0).to_numpy(), node)
            pick_row = ((bloom[at >> 6] >> (at & 63)) & 1).astype(bool) & (n > 0)
            sizes = n[pick_row]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[pick_row]), pa.array(sizes.astype(np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array(token[pick_row[row]].view(np.int64)))],
                names=["node", "n", "tokens"])

    sets = cut(texts.select(F.xxhash64("doc_id").alias("id_hash"), "text")
               .mapInArrow(run, "node long, n long, tokens array<long>"))
    if sets.groupBy("node").count().where("count > 1").isEmpty():
        return sets
    return sets.dropDuplicates(["node"])


def _ceil(percent_of: Column, percent: int) -> Column:
    return F.floor((percent_of * percent + 99) / 100)


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Prefix tokens that sets of sizes a and b must share at least to link."""
    overlap = F.ceil((a + b) * percent / F.lit(100 + percent) - 1e-9)
    behind = F.greatest(_ceil(a, percent), _ceil(b, percent)) - 1
    return overlap - behind


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets link."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    return (pairs.join(left, "a").join(right, "b")
            .where(common * 100 >= (F.col("na") + F.col("nb") - common) * percent).select("a", "b"))


def _unpacked(chunks: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(node, root, tokens) of the packed rows of chunks."""
    rows = chunks.column("rows").combine_chunks().flatten()
    node, root, tokens = (pc.struct_field(rows, c) for c in ("node", "root", "tokens"))
    return node.to_numpy(), root.to_numpy(), tokens


def open_chunk(queries: pa.Table, members: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) of the nodes of some chunks with those of one, as many as join components.

    Both hold packed chunks (:func:`packed_chunks`); rows of one root are
    joined already. Of all links found a spanning part is returned.
    """
    out = []
    if queries.num_rows and members.num_rows:
        b, root, lists = _unpacked(members)
        a, own_root, asked = _unpacked(queries)
        token = lists.flatten().to_numpy()
        order = np.argsort(token, kind="stable")
        token = token[order]
        n = lists.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(n)), n)[order]
        roots, label = np.unique(np.concatenate([root, own_root]), return_inverse=True)
        own_label, label = label[len(b):], label[:len(b)]   # of queries and members; merged as links are found
        merged = np.arange(len(roots))
        ends = np.concatenate([[0], np.cumsum(asked.value_lengths().to_numpy())])
        flat = asked.flatten().to_numpy()
        for i in range(len(a)):
            mine = merged[own_label[i]]
            if (merged[label] == mine).all():
                continue
            own = flat[ends[i]:ends[i + 1]]
            low, high = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
            found = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(found.sum())
            common = np.bincount(owner[at], minlength=len(b))
            links = np.flatnonzero((common * 100 >= (len(own) + n - common) * percent) & (merged[label] != mine))
            if len(links):
                others, first = np.unique(merged[label[links]], return_index=True)
                out += [(int(a[i]), int(b[j])) for j in links[first]]
                merged[np.isin(merged, others)] = mine
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def packed_chunks(member: DataFrame, sets: DataFrame) -> DataFrame:
    """(chunk, size, rows): a chunk's nodes with their roots and whole sets, one
    row a chunk; CHUNK_NODES and CHUNK_TOKENS bound it."""
    return (member.join(sets.select("node", "tokens"), "node").groupBy("chunk")
            .agg(F.count(F.lit(1)).alias("size"), F.collect_list(F.struct("node", "root", "tokens")).alias("rows")))


def shared_tokens(signed: DataFrame) -> DataFrame:
    """(token, node, low) of the prefix tokens that several nodes have; low is the smallest of these.

    A token outside the table of frequent ones is in at most one document of
    each counting window (or is rarer than all that the table holds), so its
    rows fit a window by token, in one shuffle. Frequent tokens are
    aggregated before the shuffle and joined back, where a hot one is split.
    """
    by_token = Window.partitionBy("token")
    rare = (signed.select(F.explode("rare").alias("token"), "node")
            .withColumn("low", F.min("node").over(by_token)).withColumn("high", F.max("node").over(by_token))
            .where("low <> high").select("token", "node", "low").distinct())
    often = signed.select(F.explode("often").alias("token"), "node")
    several = (often.groupBy(F.col("token").alias("t")).agg(F.min("node").alias("low"), F.max("node").alias("high"))
               .where("low <> high").drop("high"))
    hot = often.join(several, F.col("token") == F.col("t")).select("token", "node", "low").distinct()
    return rare.unionByName(hot)


def similar_sets(texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, nodes, roots): doc_id/n/node of every row, node/rep/n of
    every set that is not empty, node/root of every node with a link."""
    frequent = frequent_tokens(texts, k)
    signed = cut(signatures(texts, k, percent, frequent))
    shared = cut(shared_tokens(signed))
    prefixes, signed = signed, cut(signed.select("doc_id", "place", "n", "node"))
    drop_cut(prefixes)
    nodes = cut(signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
    sizes = nodes.select("node", "n")

    def compared(pairs: DataFrame) -> DataFrame:
        """The pairs that link; only the nodes in a pair have their sets fetched."""
        both = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return linked(pairs, whole_sets(texts, both.join(nodes.select("node", "rep"), "node"), k), percent)

    # step 2: each node and the node that most of its shared tokens point to
    n_of = lambda key, out: sizes.select(F.col("node").alias(key), F.col("n").alias(out))
    toward = (shared.where("node <> low").groupBy(F.col("node").alias("a"), F.col("low").alias("b"))
              .agg(F.count(F.lit(1)).alias("both")))
    fit = (toward.join(n_of("a", "na"), "a").join(n_of("b", "nb"), "b")
           .where(F.col("both") >= _needed(F.col("na"), F.col("nb"), percent))
           .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))
    best = cut(fit.groupBy("a").agg(F.min(F.struct(-F.col("both"), "b")).alias("x")).select("a", F.col("x.b").alias("b")))
    stars = cut(compared(best))
    first = cut(components(stars))

    # groups: the nodes that point to one other, linked or not, of about one size, in chunks
    tied = cut(toward.groupBy("a").agg(F.min(F.struct(-F.col("both"), "b")).alias("x")).select("a", F.col("x.b").alias("b")))
    leader = tied.select(F.col("a").alias("t"), F.col("b").alias("leader"))
    level = F.floor(F.log("n") / F.log(F.lit(SIZE_STEP)))
    member = (shared.select("node").distinct().join(sizes, "node").join(first, "node", "left")
              .withColumn("root", F.coalesce("root", "node"))
              .join(leader, F.col("node") == F.col("t"), "left")
              .withColumn("leader", F.coalesce("leader", "node")).withColumn("level", level).drop("t"))
    chunks = member.groupBy(F.col("leader").alias("l"), F.col("level").alias("v")).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_NODES), F.ceil(F.sum("n") / CHUNK_TOKENS)).alias("chunks"))
    member = cut(member.join(chunks, (F.col("leader") == F.col("l")) & (F.col("level") == F.col("v"))).withColumn(
        "chunk", F.xxhash64("leader", "level", F.pmod(F.xxhash64("node"), F.col("chunks"))))
        .select("node", "n", "root", "chunk"))

    # step 3: the matrix of tokens and chunks
    cells = cut(shared.select("token", "node").join(member, "node").groupBy("token", "chunk").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("root"), F.max("root").alias("last")))
    apart = (cells.groupBy(F.col("token").alias("t")).agg(F.min("root").alias("l"), F.max("last").alias("h"))
             .where("l <> h").select("t"))
    matrix = cells.join(apart, F.col("token") == F.col("t"), "left_semi")
    there = matrix.toDF(*[f"{c}_" for c in matrix.columns])
    one = (F.col("root") == F.col("last")) & (F.col("root_") == F.col("last_")) & (F.col("root") == F.col("root_"))
    needed = F.least(*[_needed(F.col(x), F.col(y), percent) for x in ("low", "high") for y in ("low_", "high_")]) - 1
    hits = (matrix.join(there, (F.col("token") == F.col("token_")) & (F.col("chunk") <= F.col("chunk_"))
                        & (F.col("high") * 100 >= F.col("low_") * percent) & (F.col("high_") * 100 >= F.col("low") * percent))
            .groupBy("chunk", "chunk_").agg(
                F.count(F.lit(1)).alias("both"), F.max(F.when(one, 0).otherwise(1)).alias("open"),
                F.min("low").alias("low"), F.max("high").alias("high"), F.min("low_").alias("low_"), F.max("high_").alias("high_")))
    # step 4: open the chunks that qualify; a chunk travels whole, in one row
    met = cut(hits.where((F.col("open") == 1) & (F.col("both") >= needed)).select("chunk", F.col("chunk_").alias("g")))
    for done in (shared, cells, best, tied):
        drop_cut(done)
    if met.isEmpty():
        return signed, nodes, first
    opened = met.select("chunk").union(met.select("g")).distinct()
    wanted = member.join(opened, "chunk", "left_semi")
    sets = whole_sets(texts, wanted.select("node").join(nodes.select("node", "rep"), "node"), k)
    packed = cut(packed_chunks(wanted, sets))
    asking = met.join(packed.select("chunk", "size"), "chunk")
    parts = asking.groupBy(F.col("g").alias("of")).agg(F.ceil(F.sum("size") / QUERY_PART).alias("parts"))
    asking = cut(asking.join(parts, F.col("g") == F.col("of")).select(
        "chunk", "g", F.pmod(F.xxhash64("chunk"), F.col("parts")).alias("p")))
    rows_of = packed.select(F.col("chunk").alias("c"), "rows")
    queries = asking.join(rows_of, F.col("chunk") == F.col("c")).select("g", "p", "rows")
    members = asking.select(F.col("g").alias("g_"), F.col("p").alias("p_")).distinct().join(rows_of, F.col("g_") == F.col("c"))
    members = members.select(F.col("g_").alias("g"), F.col("p_").alias("p"), F.col("rows").alias("rows"))
    across = cut(queries.groupBy("g", "p").cogroup(members.groupBy("g", "p"))
                 .applyInArrow(lambda a, b: open_chunk(a, b, percent), "a long, b long"))
    for done in (sets, packed, asking, met, member):
        drop_cut(done)
    if across.isEmpty():
        return signed, nodes, first
    roots = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across))
    return signed, nodes, cut(roots)


def judged(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, place, n, component (smallest id) and root (its name; null for empty sets) of every row."""
    signed, nodes, roots = similar_sets(pick(docs, "doc_id", "text"), k, percent)
    reps = nodes.select("node", "rep")
    named = roots.join(reps, "node")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    answer = (reps.join(named.join(least, "root").select("node", "root", "least"), "node", "left")
              .select("node", F.coalesce("root", "node").alias("root"), F.coalesce("least", "rep").alias("least")))
    rows = signed.select("doc_id", "place", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    return rows.join(answer, "node", "left").select(
        "doc_id", "place", "n", F.coalesce("least", "doc_id").alias("component"), "root")


def join_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    return judged(docs, k, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns: of each component one row stays, that with the
    smallest (doc_id, hash of the text); rows with empty sets stay."""
    rows = cut(judged(docs, k, percent).where("root is not null").select("doc_id", "place", "root"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("first"))
    marked = rows.join(first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
                                                 & (F.col("place") == F.col("first.place")))
    dropped = marked.where("not stays").select(F.col("doc_id").alias("__d"), F.col("place").alias("__p"))
    repeated = marked.where("stays").groupBy("root").count().where("count > 1")
    flat, own = positional(docs)
    flat = flat.withColumn("__id", own["doc_id"]).withColumn("__place", F.xxhash64(own["text"]))
    kept = flat.join(dropped, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__place") == F.col("__p")), "left_anti")
    if not repeated.isEmpty():  # the same row, twice or more
        blank = F.trim(F.translate(F.coalesce(own["text"], F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
        kept = (kept.where(~blank).dropDuplicates(["__id", "__place"])).unionByName(kept.where(blank))
    return restored(kept, docs.columns)
