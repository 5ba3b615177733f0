"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: centred, turned by a rotation learnt so that the
signs lose little (alternating between the signs and the nearest rotation to
them, on a bounded sample), one bit for each rotated coordinate. A code is
split into substrings, and each tile of vectors holds one index for each
substring: the rows in the order of the substring's value, with the value's
first place. Codes within a Hamming radius r of a query must lie within
distance t_j in one of the m substrings if the t_j add up to r - m + 1, so
looking up all values that near in each index finds every code within the
radius. These are checked by their whole codes and ranked by the exact
distance of the original vectors.

The radius is the ``RADIUS_SHARE`` quantile of the code distances between the
sample's vectors and their nearest ones within the sample; in the whole table
neighbours are nearer. Queries that find fewer than k codes look again with a
wider radius, at last with one that holds all codes, so none returns fewer
rows than there are.

Every row is indexed. Tiles are those of :mod:`dbpulse.llm.tiles`.

Defined cases: a null id or vector, a zero vector, a null or non-finite
component: the row takes no part; vectors of different lengths are no
candidates of one another; a length that the sample lacks gets a fixed
rotation and a radius that holds all codes; ties go to the smaller id; rows that
repeat an id are candidates each (a query's own id is none), a query id asks
once (smallest vector); fewer than k candidates: all of them; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dbpulse.llm.common import cut, drop_cut
from dbpulse.llm.tiles import matrices, meet, sample_vectors, tile_counts, usable

K = 10
BITS = 64            # a code; held in one long
PARTS = 8            # substrings, of BITS // PARTS bits each
FIT_ROWS = 8192      # vectors that rotations and radius are fitted on, at most
FIT_QUERIES = 512    # ... of which so many look for their neighbours
RADIUS_SHARE = 0.99
WIDER = 8            # the second radius is that much wider; the third holds all codes

_WIDTH = BITS // PARTS
_VALUES = np.arange(1 << _WIDTH)
_ONES = np.array([int(v).bit_count() for v in _VALUES])
_BY_DISTANCE = _VALUES[np.argsort(_ONES, kind="stable")]             # values by their number of ones
_WITHIN = np.cumsum(np.bincount(_ONES, minlength=_WIDTH + 1))        # values with at most so many ones


@dataclass
class Coder:
    """What turns vectors of one length into codes, and the radius to search with."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def codes(self, v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            signs = (v - self.mean) @ self.rotation > 0
        return np.packbits(signs, axis=1).view(np.uint64).ravel()


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows brought into a range where squares do not overflow; directions stay."""
    return v / np.maximum(np.abs(v).max(initial=0), 1e-300)


def learnt_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 30) -> np.ndarray:
    """(dim, bits): principal directions of ``x``, turned towards their signs;
    several turned copies where there are fewer directions than bits."""
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axes = axes[:bits].T
    low = (x - x.mean(0)) @ axes
    out, have, seed = [], 0, 0
    while have < bits:
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(low.T @ np.where(low @ turn > 0, 1.0, -1.0))
            turn = u @ w
        out.append(axes @ turn)
        have, seed = have + axes.shape[1], seed + 1
    return np.concatenate(out, axis=1)[:, :bits]


def fixed_coder(dim: int) -> Coder:
    return Coder(np.zeros(dim), np.random.default_rng(dim).normal(size=(dim, BITS)), BITS)


def fit_coder(x: np.ndarray, k: int = K, share: float = RADIUS_SHARE) -> Coder:
    """A coder from different vectors of one length."""
    if len(x) < 3:
        return fixed_coder(x.shape[1])
    coder = Coder(x.mean(0), learnt_rotation(_scaled(x)), BITS)
    codes = coder.codes(x)
    far = []
    unit = _scaled(x)
    squares = (unit ** 2).sum(1)
    for i in range(min(FIT_QUERIES, len(x))):
        d = squares - 2 * (unit @ unit[i])
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1) - 1)[:min(k, len(x) - 1)]
        far.append(np.bitwise_count(codes[near] ^ codes[i]))
    coder.radius = int(np.quantile(np.concatenate(far), share, method="higher"))
    return coder


def part_distances(radius: int, parts: int = PARTS) -> list[int]:
    """The distance to look up in each substring (-1: none) so that no code within ``radius`` is missed."""
    total = max(radius - parts + 1, -parts)
    base, more = divmod(total, parts)
    return [base + (j < more) for j in range(parts)]


class SubstringIndex:
    """One index for each substring of the codes of a tile."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order, self.first = [], []
        for values in self.split(codes):
            order = np.argsort(values, kind="stable")
            self.order.append(order)
            self.first.append(np.searchsorted(values[order], np.arange((1 << _WIDTH) + 1)))

    @staticmethod
    def split(codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view(np.uint8).reshape(len(codes), PARTS).T.astype(np.int64)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of all codes within ``radius`` of ``code``, ascending."""
        found = np.zeros(len(self.codes), bool)
        for j, (value, t) in enumerate(zip(self.split(np.array([code], np.uint64))[:, 0], part_distances(radius))):
            if t < 0:
                continue
            probe = value ^ _BY_DISTANCE[:_WITHIN[min(t, _WIDTH)]]
            start, size = self.first[j][probe], self.first[j][probe + 1] - self.first[j][probe]
            places = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            found[self.order[j][places]] = True
        at = np.flatnonzero(found)
        return at[np.bitwise_count(self.codes[at] ^ code) <= radius]


def distances(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean, squares added from the first component on."""
    with np.errstate(over="ignore"):
        return np.sqrt(np.cumsum((rows - q) ** 2, axis=1)[:, -1]) if len(rows) else np.zeros(0)


def search_tile(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Of a pair of tiles: each query's k nearest rows within its radius."""
    q_ids, q_codes, radius = (queries.column(c).to_numpy() for c in ("id", "code", "radius"))
    ids, codes = rows.column("id").to_numpy(), rows.column("code").to_numpy()
    out: list[list] = [[], [], []]
    have = {dim: (at, v, SubstringIndex(codes[at].view(np.uint64))) for dim, (at, v) in matrices(rows).items()}
    for dim, (q_at, q) in matrices(queries).items():
        if dim not in have:
            continue
        at, v, index = have[dim]
        for i, row in enumerate(q_at):
            near = index.within(q_codes[row:row + 1].view(np.uint64)[0], int(radius[row]))
            near = near[ids[at[near]] != q_ids[row]]
            d, own = distances(q[i], v[near]), ids[at[near]]
            best = np.lexsort((own, d))[:k]
            out[0] += [int(q_ids[row])] * len(best)
            out[1] += own[best].tolist()
            out[2] += d[best].tolist()
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                     "score": pa.array(out[2], pa.float64())})


def with_codes(vectors: DataFrame, coders: dict[int, Coder]) -> DataFrame:
    """(id, v) with each vector's code and the radius of its length."""
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            code, radius = np.zeros(len(table), np.int64), np.full(len(table), BITS, np.int32)
            for dim, (at, v) in matrices(table).items():
                coder = coders.get(dim) or fixed_coder(dim)
                code[at], radius[at] = coder.codes(v).view(np.int64), coder.radius
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(radius)],
                                             names=["id", "v", "code", "radius"])

    return vectors.mapInArrow(run, "id long, v array<double>, code long, radius int")


def nearest(table: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = K,
            fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each
    row for which ``is_query`` (an expression on ``id``) holds."""
    vectors = usable(table, id_column, vector_column, zero=False).select(F.col("id").cast("long").alias("id"), "v")
    coders = {n: fit_coder(x, k) for n, x in sample_vectors(vectors, fit_rows).items()}
    index = cut(with_codes(vectors, coders))
    tiles = tile_counts(index, is_query)
    asked = (index.where(is_query).groupBy("id").agg(F.min(F.struct("v", "code", "radius")).alias("a"))
             .select("id", "a.*"))
    parts = []
    for wider in (0, WIDER, BITS):
        now = asked.withColumn("radius", F.least(F.col("radius") + wider, F.lit(BITS)))
        got = cut(meet(now, index, tiles, lambda a, b: search_tile(a, b, k),
                       "query_id long, vec_id long, score double"))
        parts.append(got)
        # rows of a tile: at most k of those within the radius, so k rows in all mean that k were found
        enough = got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
        asked = asked.join(enough, F.col("id") == F.col("query_id"), "left_anti")
        if wider == BITS or asked.isEmpty():
            break
    # the last radius that a query searched with holds all that the earlier ones found
    every = parts[0].withColumn("round", F.lit(0))
    for n, got in enumerate(parts[1:], 1):
        every = every.unionByName(got.withColumn("round", F.lit(n)))
    every = (every.withColumn("last", F.max("round").over(Window.partitionBy("query_id")))
             .where(F.col("round") == F.col("last")))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = cut(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
              .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    for table in (index, *parts):
        drop_cut(table)
    return out
