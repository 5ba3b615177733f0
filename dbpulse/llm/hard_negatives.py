"""Hard negatives by angular triangle filtering.

Components become ``floor(256 * x)``; a score is the integer inner product of
two such vectors. Each vector is stored with its norm and its angles to a few
reference directions (centres of a bounded sample of vectors, by length). By
the triangle inequality on the sphere the angle between two vectors lies
between the largest difference of their stored angles and the smallest sum (or
two pi less the sum), so the cosine lies in an interval, and times both norms
the score lies between two bounds. The bounds are widened by more than the
rounding of angles, cosines and norms, so they are safe.

The rows of a tile are sorted by label, nearest references and angle, and cut
into cells of a few rows of one label, near one another. A cell has the range
of its rows' norms and angles, so bounds are made for a cell, not for each row,
and the cells that bounds leave are scored for all anchors that need them at
once, as a matrix product.

1. Positives: an anchor's cells of its own label are taken by falling upper
   bound and scored in integers, until the k-th best score is above all upper
   bounds that are left.
2. Each positive sets a window of scores. Of the rows of other labels those
   whose bounds meet no window are not scored; the rest are taken by falling
   upper bound, until every window has its rows or lies above what is left.

Anchors and rows meet in tiles (:mod:`dbpulse.llm.tiles`); a tile gives at most
k rows for an anchor and n for a window, the best of all tiles are the answer.
The references decide on speed only.

Defined cases: a null id, label or vector, a null or non-finite component:
the row takes no part; vectors of different lengths are no candidates of one
another; empty or zero vectors score 0; ties go to the smaller id; rows that
repeat an id are candidates each (an anchor's own id is none), an anchor id
asks once (smallest label, then vector); fewer rows than asked for: all of
them; a window without rows, a negative score of a positive: no row; scores
beyond 64 bits are held at the ends of the range; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dbpulse.llm.common import cut, drop_cut
from dbpulse.llm.tiles import matrices, meet, sample_vectors, tile_counts, usable

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW_PERCENT, HIGH_PERCENT = 50, 95   # a window: these shares of the positive's score
REFERENCES = 16                      # directions for each length of vectors
FIT_ROWS = 4096                      # vectors that the directions are fitted on, at most
CELL = 32                            # rows of a cell, at most
FIRST_STEP = 64                      # rows scored before the bounds are looked at again
BLOCK = 1 << 20                      # bounds (anchors with cells) made at once, about
HELD = 1 << 20                       # scores held before the best are picked, about
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def reference_directions(x: np.ndarray, count: int = REFERENCES, rounds: int = 10) -> np.ndarray:
    """Unit vectors (count or fewer, dim): centres of the directions of ``x``."""
    length = np.linalg.norm(x, axis=1)
    unit = x[length > 0] / length[length > 0][:, None]
    if not len(unit):
        return np.zeros((0, x.shape[1]))
    centres = unit[np.linspace(0, len(unit) - 1, min(count, len(unit))).astype(int)].copy()
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(1)
        for j in range(len(centres)):
            total = unit[near == j].sum(0)
            size = np.linalg.norm(total)
            if size > 0:
                centres[j] = total / size
    return centres


def stored_angles(v: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles to each reference) of the rows of ``v``; a zero row has right angles."""
    top = np.abs(v).max(1, initial=0)
    unit = v / np.where(top > 0, top, 1)[:, None]
    size = np.linalg.norm(unit, axis=1)
    cosine = (unit / np.where(size > 0, size, 1)[:, None]) @ references.T
    return top * size, np.arccos(np.clip(cosine, -1, 1))


def score_bounds(norm, angles: np.ndarray, norms: np.ndarray, others: np.ndarray, dim: int,
                 norms_to: np.ndarray | None = None, others_to: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of one vector (or of each of some) with others, from norms and stored angles.

    With ``norms_to`` and ``others_to``: of all others whose norms and angles lie between.
    """
    norms_to = norms if norms_to is None else norms_to
    others_to = others if others_to is None else others_to
    norm = np.asarray(norm)[..., None]
    least = np.zeros(np.broadcast_shapes(norm.shape, norms.shape))
    most = np.full(least.shape, np.pi)
    for j in range(others.shape[1]):
        own = angles[..., j, None]
        least = np.maximum(least, np.maximum(others[:, j] - own, own - others_to[:, j]))
        most = np.minimum(most, np.minimum(own + others_to[:, j], 2 * np.pi - own - others[:, j]))
    slack = 4 * np.sqrt((dim + 8) * 2.3e-16)   # an angle near 0 or pi is that far off at most
    low, high = np.cos(np.minimum(most + slack, np.pi)), np.cos(np.maximum(least - slack, 0))
    with np.errstate(invalid="ignore", over="ignore"):
        room = norm * norms_to * ((dim + 8) * 1e-15) + 1
        return (norm * np.where(low < 0, norms_to, norms) * low - room,
                norm * np.where(high < 0, norms, norms_to) * high + room)


def integer_scores(q: np.ndarray, rows: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products of ``q`` with ``rows`` of whole doubles, held in 64 bits."""
    if np.abs(q).max(initial=0) * np.abs(rows).max(initial=0) * max(len(q), 1) < 2.0 ** 53:
        return (rows @ q).astype(np.int64)
    own = [int(x) for x in q]
    return np.array([min(max(sum(a * int(b) for a, b in zip(own, r)), _LOW), _HIGH) for r in rows], np.int64)


class _Best:
    """The n best scores of each of some groups, ties to the smaller id."""

    def __init__(self, groups: int, n: int):
        self.n, self.parts, self.held = n, [], 0
        self.group = self.scores = self.ids = np.zeros(0, np.int64)
        self.last = np.full(groups, _LOW)   # the n-th score of a group that has so many

    def add(self, group: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((group, scores.astype(np.int64), ids))
        self.held += len(group)
        if self.held > HELD:
            self.pick()

    def pick(self) -> None:
        if not self.parts:
            return
        group, scores, ids = (np.concatenate(x) for x in zip((self.group, self.scores, self.ids), *self.parts))
        order = np.lexsort((ids, ~scores, group))   # ~s falls as s rises, also at the ends of the range
        group = group[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        order, group, place = order[place < self.n], group[place < self.n], place[place < self.n]
        self.group, self.scores, self.ids = group, scores[order], ids[order]
        ends = place == self.n - 1
        self.last[group[ends]] = self.scores[ends]
        self.parts, self.held = [], 0


def _cells(label: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, where each cell begins): rows of one label, near the same references."""
    near = second = closest = np.zeros(len(label))
    if angles.shape[1]:
        near, closest = angles.argmin(1), angles.min(1)
        rest = angles.copy()
        rest[np.arange(len(rest)), near] = np.inf
        second = rest.argmin(1)
    order = np.lexsort((closest, second, near, label))
    label = label[order]
    place = np.arange(len(label)) - np.searchsorted(label, label)
    return order, np.flatnonzero(place % CELL == 0)


class _Block:
    """Anchors and rows of one length: rows in cells, bounds of each anchor's scores in each cell."""

    def __init__(self, at, q, a_id, a_label, bounds, v, ids, starts, label):
        self.at, self.q, self.a_id, self.v, self.ids = at, q, a_id, v, ids
        self.starts, self.ends = starts, np.append(starts[1:], len(v))
        # scores are held in 64 bits, so are their bounds; an undefined bound meets every window
        self.lower, self.upper = (np.clip(np.where(np.isnan(b), end, b), _LOW, _HIGH)
                                  for b, end in zip(bounds, (-np.inf, np.inf)))
        self.alike = a_label[:, None] == label
        self.exact = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(q.shape[1], 1) < 2.0 ** 53

    def scores(self, who: np.ndarray, rows: slice) -> np.ndarray:
        if self.exact:
            return self.q[who] @ self.v[rows].T   # whole doubles
        return np.stack([integer_scores(q, self.v[rows]) for q in self.q[who]])

    def best(self, alike: bool, low: np.ndarray, high: np.ndarray, n: int) -> _Best:
        """For each anchor and window (a column of ``low`` and ``high``): its n best rows
        of the anchor's own label (but its own id) or of other labels."""
        anchors, windows = low.shape
        best = _Best(low.size, n)
        allowed = self.alike == alike
        place = np.argsort(np.argsort(np.where(allowed, -self.upper, np.inf), 1, kind="stable"), 1, kind="stable")
        start, step, cells = 0, max(1, FIRST_STEP // CELL), int(allowed.sum(1).max(initial=0))
        while start < cells:
            least = np.maximum(low, best.last.reshape(low.shape))
            meets = np.zeros(allowed.shape, bool)
            for p in range(windows):
                meets |= (self.lower <= high[:, p, None]) & (self.upper >= least[:, p, None]) & (low <= high)[:, p, None]
            meets &= allowed
            if not (meets & (place >= start)).any():
                break
            meets &= (place >= start) & (place < start + step)
            start, step = start + step, step * 2
            bottom, top = least.min(1), high.max(1)   # of all windows: first a wide sieve
            for c in np.flatnonzero(meets.any(0)):
                who, rows = np.flatnonzero(meets[:, c]), slice(self.starts[c], self.ends[c])
                s, ids = self.scores(who, rows), self.ids[rows]
                a, r = np.nonzero((s >= bottom[who, None].astype(s.dtype)) & (s <= top[who, None].astype(s.dtype)))
                s, a, ids = s[a, r], who[a], ids[r]
                if alike:
                    other = ids != self.a_id[a]
                    s, a, ids = s[other], a[other], ids[other]
                for p in range(windows):
                    inside = (s >= least[a, p].astype(s.dtype)) & (s <= high[a, p].astype(s.dtype))
                    best.add(a[inside] * windows + p, s[inside], ids[inside])
            best.pick()
        best.pick()
        return best


def _blocks(anchors: pa.Table, rows: pa.Table):
    """The blocks of a pair of tiles."""
    a_id, a_label, a_norm = (anchors.column(c).to_numpy() for c in ("id", "label", "norm"))
    r_id, r_label, r_norm = (rows.column(c).to_numpy() for c in ("id", "label", "norm"))
    of = lambda table, at: (table.column("angles").combine_chunks().take(pa.array(at)).flatten()
                            .to_numpy(zero_copy_only=False).reshape(len(at), -1))
    have = matrices(rows) if len(rows) else {}
    for dim, (a_at, q) in matrices(anchors).items() if len(anchors) else ():
        if dim not in have:
            continue
        at, v = have[dim]
        order, starts = _cells(r_label[at], of(rows, at))
        at, v = at[order], v[order]
        norms, stored, own = r_norm[at], of(rows, at), of(anchors, a_at)
        ranges = [f.reduceat(x, starts) for f in (np.minimum, np.maximum) for x in (norms, stored)]
        size = max(1, BLOCK // len(starts))
        for i in range(0, len(a_at), size):
            part = a_at[i:i + size]
            bounds = score_bounds(a_norm[part], own[i:i + size], *ranges[:2], dim, *ranges[2:])
            yield _Block(part, q[i:i + size], a_id[part], a_label[part], bounds, v, r_id[at], starts, r_label[at][starts])


def _long(columns: dict[str, list]) -> pa.Table:
    return pa.table({n: pa.array(c, pa.int64()) for n, c in columns.items()})


def near_rows(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Of a pair of tiles: each anchor's k best rows of its own label."""
    out: dict[str, list] = {"anchor_id": [], "positive_id": [], "positive_score": []}
    for block in _blocks(anchors, rows):
        every = np.full((len(block.at), 1), _LOW)
        best = block.best(True, every, np.full_like(every, _HIGH), k)
        out["anchor_id"] += block.a_id[best.group].tolist()
        out["positive_id"] += best.ids.tolist()
        out["positive_score"] += best.scores.tolist()
    return _long(out)


def window_rows(anchors: pa.Table, rows: pa.Table, n: int, low: int, high: int) -> pa.Table:
    """Of a pair of tiles: each window's n best rows of other labels."""
    out: dict[str, list] = {"anchor_id": [], "place": [], "negative_id": [], "negative_score": []}
    for block in _blocks(anchors, rows):
        windows = anchors.column("positives").take(pa.array(block.at)).to_pylist()
        shape = len(windows), max(map(len, windows))
        place, first, last = np.zeros(shape, np.int64), np.full(shape, _HIGH), np.full(shape, _LOW)
        for i, own in enumerate(windows):
            for j, w in enumerate(own):
                # low * p <= 100 * s <= high * p in whole numbers
                a, b = -(-low * w["positive_score"] // 100), high * w["positive_score"] // 100
                place[i, j] = w["place"]
                if a <= _HIGH and b >= _LOW:
                    first[i, j], last[i, j] = max(a, _LOW), min(b, _HIGH)
        best = block.best(False, first, last, n)
        out["anchor_id"] += block.a_id[best.group // shape[1]].tolist()
        out["place"] += place.ravel()[best.group].tolist()
        out["negative_id"] += best.ids.tolist()
        out["negative_score"] += best.scores.tolist()
    return _long(out)


def floored(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(v * SCALE))   # beyond a double's range: its ends


def with_angles(vectors: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """The floored vectors of (id, label, v), with norm and angles to the references of their length."""
    def run(batches):
        numbers = pa.list_(pa.float64())
        for batch in batches:
            table = pa.Table.from_batches([batch])
            norm, angles, whole = np.zeros(len(table)), [[]] * len(table), [[]] * len(table)
            for dim, (at, v) in matrices(table).items():
                v = floored(v)
                norm[at], a = stored_angles(v, references.get(dim, np.zeros((0, dim))))
                for i, x, y in zip(at, a, v):
                    angles[i], whole[i] = x, y
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(whole, numbers), pa.array(norm, pa.float64()),
                 pa.array(angles, numbers)], names=["id", "label", "v", "norm", "angles"])

    return vectors.mapInArrow(run, "id long, label long, v array<double>, norm double, angles array<double>")


def hard_negatives(table: DataFrame, id_column: str, vector_column: str, label_column: str, is_anchor: Column,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT,
                   high: int = HIGH_PERCENT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the
    rows for which ``is_anchor`` (an expression on ``id``) holds."""
    vectors = (usable(table, id_column, vector_column, label_column).where(F.col("x0").isNotNull())
               .select(F.col("id").cast("long").alias("id"), F.col("x0").cast("long").alias("label"), "v"))
    references = {n: reference_directions(floored(x)) for n, x in sample_vectors(vectors, fit_rows).items()}
    stored = cut(with_angles(vectors, references))
    tiles = tile_counts(stored, is_anchor)
    anchors = (stored.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v", "norm", "angles")).alias("a"))
               .select("id", "a.*"))
    found = meet(anchors, stored, tiles, lambda a, b: near_rows(a, b, positives),
                 "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = cut(found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= positives))
    windows = (best.groupBy(F.col("anchor_id").alias("id"))
               .agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("positives")))
    got = meet(anchors.join(windows, "id"), stored, tiles, lambda a, b: window_rows(a, b, negatives, low, high),
               "anchor_id long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = cut(best.join(ranked, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score"))
    drop_cut(stored)
    drop_cut(best)
    return out
