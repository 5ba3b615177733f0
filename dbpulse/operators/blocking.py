"""Blocking graph operators: block leaders (G2, A8) and blocker closure
(G1, U3).

Both are iterative. Where every session has at most one blocker, the counts
below each session come from pointer doubling: one row per session in every
round, and as many rounds as the logarithm of the deepest chain. Where
sessions have several blockers, sets of sessions as 64-bit words take the
rows' place. Rounds are written to the session's shared checkpoint folder, so the plan never grows with their
number and a lost executor re-reads a round instead of recomputing all
earlier ones. No round number is capped: both loops end on every finite
graph.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dbpulse.session import cut_lineage, drop_table


def blocking_edges(sessions: DataFrame, keys: Sequence[str] = (),
                   blocker_col: str = "blocked") -> DataFrame:
    """(keys, parent, child): ``child`` is blocked by ``parent``. Zero, NULL
    and self-blocks are not edges; duplicate request rows collapse."""
    keys = list(keys)
    b = F.col(blocker_col)
    return (sessions.filter(b.isNotNull() & (b != 0) & (b != F.col("session_id")))
            .select(*keys, b.alias("parent"), F.col("session_id").alias("child")).distinct())


def _doubled(tree: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, size) of a forest given as (keys, node, up): the nodes of
    each subtree, the node itself included. ``up`` is NULL at a root.

    After round k a row knows the ancestor 2^k levels up and how many nodes
    lie fewer than 2^k levels below; the two halves of the next span are
    added with one grouped sum and one join each.
    """
    now = cut_lineage(tree.withColumn("size", F.lit(1).cast("bigint")))
    while not now.where("up is not null").isEmpty():
        gained = (now.where("up is not null").groupBy(*keys, F.col("up").alias("node"))
                  .agg(F.sum("size").alias("_more")))
        upper = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("_next"))
        after = cut_lineage(now.join(gained, on=[*keys, "node"], how="left").join(upper, on=[*keys, "up"], how="left")
                            .select(*keys, "node", F.col("_next").alias("up"),
                                    (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")))
        drop_table(now)
        now = after
    return now.drop("up")


def _cycle_nodes(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, cycle) of the sessions that block one another in a ring;
    ``cycle`` is the smallest of the ring. ``edges`` has one parent per child.

    Doubling the parent pointer until it spans more levels than there are
    edges leaves exactly the ring nodes as ends; the least node met on the
    way names a ring.
    """
    # no ring is longer than the largest snapshot has edges
    total = (edges.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) if keys else edges.count()
    now = cut_lineage(edges.select(*keys, F.col("child").alias("node"), F.col("parent").alias("up"),
                                   F.col("child").alias("least")))
    span = 1
    while span <= total and not now.isEmpty():
        upper = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("_next"), F.col("least").alias("_l"))
        after = cut_lineage(now.join(upper, on=[*keys, "up"])  # chains that have ended drop out
                            .select(*keys, "node", F.col("_next").alias("up"), F.least("least", "_l").alias("least")))
        drop_table(now)
        now, span = after, span * 2
    ends = now.select(*keys, F.col("up").alias("node")).distinct()
    return now.join(ends, on=[*keys, "node"]).select(*keys, "node", F.col("least").alias("cycle"))


def _functional_counts(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, session_id, blocked_session_count) where every child has one parent."""
    rings = cut_lineage(_cycle_nodes(edges, keys))
    nodes = (edges.select(*keys, F.col("child").alias("node"))
             .union(edges.select(*keys, F.col("parent").alias("node"))).distinct())
    up = edges.select(*keys, F.col("child").alias("node"), F.col("parent").alias("up")).join(
        rings.select(*keys, "node"), on=[*keys, "node"], how="left_anti")  # a ring node is the root of its tree
    sizes = _doubled(nodes.join(up, on=[*keys, "node"], how="left"), keys)
    ringed = rings.join(sizes, on=[*keys, "node"])
    whole = ringed.groupBy(*keys, "cycle").agg(F.sum("size").alias("_ring"))
    of_ring = ringed.join(whole, on=[*keys, "cycle"]).select(*keys, "node", "_ring")
    return sizes.join(of_ring, on=[*keys, "node"], how="left").select(
        *keys, F.col("node").alias("session_id"), (F.coalesce("_ring", "size") - 1).alias("blocked_session_count"))


TILE_ENTRIES = 2_000_000   # words that one group of the tile product may give


def _through_tile(key, left, right):
    """What the sessions in ``left`` reach through the 64 sessions of one word.

    ``left``: (keys, node, bits), who reaches which of them; ``right``: (keys,
    node, word, bits), what they reach. What they reach among themselves is
    closed first (Warshall), so a step through the word spans all its levels.
    """
    schema = left.schema
    found = pa.schema([*(f for f in schema if f.name not in ("node", "bits")), pa.field("node", pa.int64()),
                       pa.field("word", pa.int64()), pa.field("bits", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return found.empty_table()
    own = key[-2].as_py()
    words, at = np.unique(right["word"].to_numpy(), return_inverse=True)
    rows = np.zeros((64, len(words)), np.uint64)
    np.bitwise_or.at(rows, (right["node"].to_numpy() & 63, at), right["bits"].to_numpy().view(np.uint64))
    used = [int(b) for b in np.flatnonzero(rows.any(axis=1))]
    holds = lambda bits, b: (bits >> np.uint64(b) & np.uint64(1)).astype(bool)
    inner = np.flatnonzero(words == own)
    if len(inner):
        for b in used:
            rows[holds(rows[:, inner[0]], b)] |= rows[b]
    bits = left["bits"].to_numpy().view(np.uint64)
    parts = []
    step = max(1, TILE_ENTRIES // len(words))
    for s in range(0, len(bits), step):
        some = bits[s:s + step]
        reached = np.zeros((len(some), len(words)), np.uint64)
        for b in used:
            reached[holds(some, b)] |= rows[b]
        if len(inner):  # known already
            reached[:, inner[0]] &= ~some
        i, j = np.nonzero(reached)
        parts.append((i + s, words[j], reached[i, j].view(np.int64)))
    i, word, bits = (np.concatenate(x) for x in zip(*parts))
    taken = left.drop_columns(["bits"]).take(pa.array(i))
    return pa.Table.from_arrays([*(taken[f.name] for f in found if f.name not in ("word", "bits")),
                                 pa.array(word, pa.int64()), pa.array(bits, pa.int64())], schema=found)


def _bitmap_counts(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The same for any graph, by reachability bitmaps.

    A set of sessions is held in 64-bit words: (word, bits) for the sessions
    word * 64 + bit. A round looks up, for every word of a session's set, what
    the sessions of that word reach, and ORs it in: words meet the 64 rows of
    a word in one group, no bit becomes a row of its own. After round k a
    session knows what it reaches in 2^k steps at least, so the number of
    rounds is at most the logarithm of the longest shortest path, in rings
    too, and the ORs combine map-side. A round without a new bit ends it.
    """
    node = [*keys, "node"]
    tile = [*keys, "_tile"]
    id_type = edges.schema["parent"].dataType
    child = F.col("child").cast("bigint")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), child.bitwiseAND(63).cast("int"))
    now = cut_lineage(edges.groupBy(*keys, F.col("parent").cast("bigint").alias("node"), F.shiftright(child, 6).alias("word"))
                      .agg(F.bit_or(one).alias("bits")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.select(*node, "word", "bits").schema)
    held = None
    while True:
        state = now.agg(F.sum(F.bit_count("bits"))).first()
        if state[0] == held:
            break
        held = state[0]
        to, of = now.withColumn("_tile", F.col("word")), now.withColumn("_tile", F.shiftright("node", 6))
        # a word that very many sessions reach, and that reaches many, is met in several parts
        wide = (to.groupBy(*tile).agg(F.count(F.lit(1)).alias("_n"), F.lit(0).cast("bigint").alias("_m"))
                .unionByName(of.groupBy(*tile).agg(F.lit(0).cast("bigint").alias("_n"), F.approx_count_distinct("word").alias("_m")))
                .groupBy(*tile).agg((F.ceil(F.sum("_n") * F.sum("_m") / TILE_ENTRIES)).cast("int").alias("_parts")).where("_parts > 1")
                .select(*[F.col(k).alias(f"_{k}") for k in tile], "_parts"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in tile]
        parts = F.coalesce("_parts", F.lit(1))
        to = to.join(wide, on=same, how="left").select(*tile, F.pmod(F.xxhash64("node"), parts).cast("int").alias("_part"), "node", "bits")
        of = of.join(wide, on=same, how="left").select(*tile, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), "node", "word", "bits")
        of = of.toDF(*of.columns)  # columns of its own
        further = (to.groupBy(*tile, "_part").cogroup(of.groupBy(*tile, "_part"))
                   .applyInArrow(lambda key, a, b: _through_tile(key, a.drop_columns(["_tile", "_part"]), b), schema))
        after = cut_lineage(now.unionByName(further).groupBy(*node, "word").agg(F.bit_or("bits").alias("bits")))
        drop_table(now)
        now = after
    own = F.when(F.shiftright("node", 6) == F.col("word"),
                 F.getbit("bits", F.col("node").bitwiseAND(63).cast("int"))).otherwise(F.lit(0))
    return (now.groupBy(*keys, F.col("node").cast(id_type).alias("session_id"))
            .agg(F.sum(F.bit_count("bits") - own).alias("blocked_session_count")))


def block_leaders(sessions: DataFrame, keys: Sequence[str] = (), blocker_col: str = "blocked") -> DataFrame:
    """G2 + A8: for every session, how many distinct sessions sit below it
    in the blocking graph (directly or transitively). A session never counts
    itself, so cycles terminate.

    Returns (keys, session_id, blocked_session_count) for every session.
    Snapshots in which some session has several blockers are counted by
    bitmaps of the sessions reached, all others by doubling, one row per
    session; both take as many rounds as the logarithm of the longest chain.
    """
    keys = list(keys)
    edges = cut_lineage(blocking_edges(sessions, keys, blocker_col))
    several = edges.groupBy(*keys, "child").agg(F.count(F.lit(1)).alias("_parents")).filter("_parents > 1")
    several = cut_lineage(several.select(*keys).distinct() if keys else several.limit(1).select("_parents"))
    if several.isEmpty():
        counts = _functional_counts(edges, keys)
    elif not keys:
        counts = _bitmap_counts(edges, keys)
    else:
        counts = _functional_counts(cut_lineage(edges.join(several, on=keys, how="left_anti")), keys).unionByName(
            _bitmap_counts(cut_lineage(edges.join(several, on=keys, how="left_semi")), keys))
    nodes = sessions.select(*keys, "session_id").distinct()
    return (nodes.join(counts, on=[*keys, "session_id"], how="left")
            .withColumn("blocked_session_count",
                        F.coalesce(F.col("blocked_session_count"), F.lit(0)).cast("bigint")))


def blocker_closure(all_rows: DataFrame, seeds: DataFrame, keys: Sequence[str] = (),
                    blocker_col: str = "blocked") -> DataFrame:
    """G1 + U3: start from ``seeds`` (rows that passed the filters) and keep
    adding every row of any blocker that is not yet present, until a round
    finds nothing new (a blocker absent from ``all_rows`` just ends its
    chain). Adds ``closure_round``: 0 for seeds, k for rows found in round k.

    The walk runs on a narrow, checkpointed (keys, session, blocker) table;
    the full rows of the sessions found are joined back once at the end.
    """
    keys = list(keys)
    sk = [*keys, "session_id"]
    b = F.col(blocker_col)
    edges = cut_lineage(all_rows.select(*sk, b.alias("_blocker")).distinct())
    seed_rows = seeds.withColumn("closure_round", F.lit(0))
    seed_edges = cut_lineage(seeds.select(*sk, b.alias("_blocker")).distinct())
    present = [seed_edges.select(*sk).distinct()]
    wanted_from = seed_edges.select(*keys, "_blocker")
    found = []
    for rnd in itertools.count(1):
        have = reduce(DataFrame.unionByName, present)
        wanted = (wanted_from.filter(F.col("_blocker").isNotNull() & (F.col("_blocker") != 0))
                  .select(*keys, F.col("_blocker").alias("session_id")).distinct()
                  .join(have, on=sk, how="left_anti"))
        # the semi-join keeps blockers present in the snapshot and yields
        # their own blockers for the next round in the same step
        new_edges = cut_lineage(edges.join(wanted, on=sk, how="left_semi"))
        if new_edges.isEmpty():
            break
        new = new_edges.select(*sk).distinct().withColumn("closure_round", F.lit(rnd))
        found.append(new)
        present.append(new.select(*sk))
        wanted_from = new_edges.select(*keys, "_blocker")
    if not found:
        return seed_rows
    added = all_rows.join(reduce(DataFrame.unionByName, found), on=sk, how="inner")
    return seed_rows.unionByName(added.select(*seed_rows.columns))
