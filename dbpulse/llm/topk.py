"""Exact top-k search by three phases with one uniform threshold.

A vector's dimensions are dealt into ``LISTS`` lists; a candidate's score for
a query is the sum of its local scores, one from each list. Queries and
candidates are dealt into blocks of bounded size by a hash of their id, and
every block of queries meets every block of candidates once in each of two
passes (a cogroup by the pair of blocks):

1. Each list gives its best k local scores for each query, and its least one.
   The full scores of the candidates so gathered are taken; the k-th best of these
   scores is a safe cutoff: the true k-th score is no lower. (Local scores
   may be negative, so they count from their list's least.)
2. The cutoff goes back to the blocks, joined by query: each list gives all
   entries that reach cutoff / lists. A candidate below that in all lists
   cannot reach the cutoff.
3. Of the entries' candidates, those whose known local scores plus the
   threshold for the lists that did not give them can still reach the cutoff
   are ranked by their full scores, and the best k of all blocks are the answer.

The local scores of a pair of blocks are computed whole, in matrix products,
in each of the two passes, and their sum is every full score: the phases
choose which of these are compared and returned, they save no products.

Defined cases: vectors that are null, or hold a null, NaN or infinite
component, take no part; vectors of different lengths are no candidates of
one another; empty vectors score 0; ties go to the smaller id, rows that
repeat an id are one candidate each (the query's own id is none); fewer than
k candidates: all of them; scores beyond 64 bits are held at the ends of the
range; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dbpulse.llm.common import cut, pick

K = 5
LISTS = 4
SCALE = 256
QUERY_BLOCK = 1024       # queries that a block has about
CANDIDATE_BLOCK = 2048   # vectors that a block has about
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def usable_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the vectors that take part, v as doubles."""
    v = F.transform("v", lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (pick(table, id_column, vector_column).toDF("id", "v")
            .where(F.col("v").isNotNull() & F.coalesce(good, F.lit(False))).select("id", v.alias("v")))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products: exact; as whole doubles while they fit, else as Python integers."""
    bound = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if bound < 2.0 ** 53:
        return q @ c.T
    to_int = np.vectorize(int, otypes=[object])
    return (to_int(q) if q.size else q.astype(object)) @ (to_int(c) if c.size else c.astype(object)).T


def _local(q: np.ndarray, c: np.ndarray, lists: int) -> list[np.ndarray]:
    return [_scores(q[:, j::lists], c[:, j::lists]) for j in range(lists)]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one query, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: row numbers and floored vectors of a table's column ``v``."""
    lists = table.column("v").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        out[int(dim)] = at, np.floor(flat.reshape(len(at), int(dim)) * SCALE)
    return out


def _met(queries: pa.Table, candidates: pa.Table, lists: int):
    """For each length of vectors: query rows, query ids, candidate ids, local scores, full scores, own-id mask."""
    q_ids, ids = (t.column("id").to_numpy() for t in (queries, candidates))
    have = _matrices(candidates)
    for dim, (q_at, q) in _matrices(queries).items():
        if dim in have:
            at, c = have[dim]
            local = _local(q, c, lists)
            yield q_at, q_ids[q_at], ids[at], local, sum(local), q_ids[q_at][:, None] == ids[at][None, :]


def _as_long(score) -> list[int]:
    return [min(max(int(s), _LOW), _HIGH) for s in score]


def gather(queries: pa.Table, candidates: pa.Table, k: int, lists: int) -> pa.Table:
    """Phase 1 of a pair of blocks: each query's k best full scores among its lists' best, and the lists' least."""
    ids, least, best = [], [], []
    for _, q_ids, _, local, full, own in _met(queries, candidates, lists):
        low = [x.min(1) for x in local]
        for i, q in enumerate(q_ids):
            seen: set[int] = set()
            for x in local:
                m = min(k + 1, len(x[i]))  # one more, as the query itself may be among them
                seen.update(np.argpartition(-x[i], m - 1)[:m].tolist())
            at = np.array([j for j in seen if not own[i, j]], np.int64)
            ids.append(int(q))
            least.append([float(x[i]) for x in low])
            best.append(_as_long(sorted(full[i, at].tolist(), reverse=True)[:k]))
    return pa.table({"query_id": pa.array(ids, pa.int64()), "least": pa.array(least, pa.list_(pa.float64())),
                     "best": pa.array(best, pa.list_(pa.int64()))})


def resolve(queries: pa.Table, candidates: pa.Table, k: int, lists: int) -> pa.Table:
    """Phases 2 and 3 of a pair of blocks: entries over the threshold, their bounds, their full scores."""
    cutoffs, leasts = queries.column("cutoff").to_pylist(), queries.column("least").to_pylist()
    out = []
    for rows, q_ids, ids, local, full, own in _met(queries, candidates, lists):
        for i, q in enumerate(q_ids):
            cutoff, least = cutoffs[rows[i]], leasts[rows[i]]
            may = ~own[i]
            if cutoff is not None and least is not None:
                target = cutoff - sum(least)   # the cutoff, counted from the lists' least
                threshold = target / lists
                slack = 1e-9 * (abs(target) + abs(cutoff) + 1)
                entries = [(s[i] - low).astype(np.float64) for s, low in zip(local, least)]
                given = [e >= threshold - slack for e in entries]
                bound = sum(np.where(g, e, threshold) for g, e in zip(given, entries))
                may &= np.logical_or.reduce(given) & (bound >= target - lists * slack)
            at = np.flatnonzero(may)
            at = at[_best(full[i, at], ids[at], k)]
            out += zip([int(q)] * len(at), ids[at].tolist(), _as_long(full[i, at]))
    return pa.table({n: pa.array([x[j] for x in out], pa.int64())
                     for j, n in enumerate(("query_id", "vec_id", "score"))})


def top_k(table: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = K,
          lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row for
    which ``is_query`` (an expression on ``id``) holds."""
    vectors = usable_vectors(table, id_column, vector_column)
    size = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    c_blocks, q_blocks = max(1, -(-size[0] // CANDIDATE_BLOCK)), max(1, -(-size[1] // QUERY_BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = (vectors.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(c_blocks)).cast("int"))
                  .withColumn("q", numbers(q_blocks)))
    asked = (vectors.where(is_query).dropDuplicates(["id"])
             .withColumn("q", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_blocks)).cast("int")))

    def meet(queries: DataFrame, fn, schema: str) -> DataFrame:
        each = queries.withColumn("c", numbers(c_blocks))
        each = each.toDF(*[f"{c}_" for c in each.columns]).toDF(*each.columns)  # columns of its own
        return (each.groupBy("q", "c").cogroup(candidates.groupBy("q", "c"))
                .applyInArrow(lambda a, b: fn(a, b, k, lists), schema))

    gathered = cut(meet(asked, gather, "query_id long, least array<double>, best array<long>"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))
    cutoff = (gathered.select("query_id", F.explode("best").alias("s")).withColumn("n", nth)
              .where(F.col("n") == k).select("query_id", F.col("s").alias("cutoff")))
    least = gathered.groupBy("query_id").agg(*[F.min(F.col("least")[j]).alias(f"l{j}") for j in range(lists)])
    safe = least.join(cutoff, "query_id", "left").select(
        F.col("query_id").alias("id"), "cutoff", F.array(*[f"l{j}" for j in range(lists)]).alias("least"))
    found = meet(asked.join(safe, "id", "left"), resolve, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
