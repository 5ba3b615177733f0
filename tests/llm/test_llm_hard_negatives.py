import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import dbpulse.llm.hard_negatives as hard
import dbpulse.llm.tiles as tiles

SCHEMA = "vec_id long, embedding array<float>, label int, VEC_ID string, v int, angles int"


def brute(rows, every, positives=5, negatives=3):
    usable = [(r[0], [math.floor(256 * float(x)) for x in r[1]], r[2]) for r in rows
              if r[0] is not None and r[1] is not None and r[2] is not None
              and all(x is not None and math.isfinite(x) for x in r[1])]
    out, asked = [], {}
    for a, v, label in usable:
        if a % every == 0:
            asked[a] = min(asked.get(a, (label, v)), (label, v))
    for a, (label, v) in asked.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), i, own) for i, w, own in usable if i != a and len(w) == len(v)]
        best = sorted((s, i) for s, i, own in scored if own == label)[:positives]
        others = sorted((s, i) for s, i, own in scored if own != label)
        for s, p in best:
            inside = [(t, i) for t, i in others if 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, every=5, **options):
    got = hard.hard_negatives(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label",
                              F.col("id") % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(n, dim, labels, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (labels, dim))
    return [(i, [float(x) for x in np.float32(centres[i % labels] * spread + rng.normal(0, 1, dim))],
             int(rng.integers(labels)), "a", 1, 2) for i in range(n)]


@pytest.mark.parametrize("dim,spread", [(16, 0.0), (8, 2.0), (1, 1.0), (64, 0.5)])
def test_against_brute_force(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(hard, "FIRST_STEP", 4)
    monkeypatch.setattr(tiles, "LEAST_ROWS", 60)
    rows = vectors(240, dim, 4, dim, spread)
    assert run(spark, rows) == brute(rows, 5)


def test_edge_rows(spark):
    rows = [(i, [1.0, 0.5], i % 2, "a", 1, 2) for i in range(24)]            # ties
    rows += [(5, [0.9, 0.5], 1, "a", 1, 2), (10, [1.0, 0.5], 0, "a", 1, 2)]  # repeated ids
    rows += [(30 + i, [0.7, 0.3 + i / 50], i % 3, "b", 1, 2) for i in range(20)]
    rows += [(100, None, 1, None, None, None), (105, [None, 1.0], 1, "a", 1, 2), (110, [1.0, 1.0], None, "a", 1, 2),
             (115, [float("nan"), 1.0], 0, "a", 1, 2), (120, [float("inf"), 1.0], 0, "a", 1, 2),
             (125, [0.0, 0.0], 0, "a", 1, 2), (126, [0.0, 0.0], 1, "a", 1, 2), (130, [2.0], 0, "a", 1, 2),
             (131, [1.5], 1, "a", 1, 2), (132, [1.9], 0, "a", 1, 2), (135, [], 0, "a", 1, 2), (136, [], 0, "a", 1, 2),
             (137, [], 1, "a", 1, 2), (140, [-1.0, -0.5], 0, "a", 1, 2), (None, [1.0, 1.0], 0, "a", 1, 2)]
    assert run(spark, rows) == brute(rows, 5)


def test_scores_beyond_doubles(spark):
    rows = [(i, [float(np.float32(1e6 + i * 1e3)), float(np.float32(-2e5 * i)), 3e5], i % 2, "a", 1, 2) for i in range(30)]
    assert run(spark, rows) == brute(rows, 5)
    huge = [(i, [3e38, float(i)], i % 2, "a", 1, 2) for i in range(12)]
    assert all(r[4] == (1 << 63) - 1 for r in run(spark, huge))


def test_no_rows_and_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, vectors(1, 4, 1, 0, 1.0)) == []
    assert run(spark, vectors(6, 4, 2, 0, 1.0)) == brute(vectors(6, 4, 2, 0, 1.0), 5)


def test_a_label_and_a_vector_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(tiles, "LEAST_ROWS", 50)
    rows = vectors(300, 6, 5, 3, 1.0)
    rows = [(r[0], rows[7][1] if r[0] % 3 == 0 else r[1], 1 if r[0] % 2 else r[2], *r[3:]) for r in rows]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_bounds_hold_and_leave_rows_unscored(monkeypatch):
    rng = np.random.default_rng(0)
    x = hard.floored(np.repeat(rng.normal(0, 1, (6, 12)), 60, 0) + rng.normal(0, 0.1, (360, 12)))
    x[5] = 0
    references = hard.reference_directions(x)
    norm, angles = hard.stored_angles(x, references)
    for i in range(0, 360, 17):
        lower, upper = hard.score_bounds(norm[i], angles[i], norm, angles, 12)
        exact = x @ x[i]
        assert (lower <= exact).all() and (exact <= upper).all()
        assert (upper < 0.5 * exact.max()).mean() > 0.3   # the filter filters


def tile(rows, references):
    x = hard.floored(np.array([r[1] for r in rows]))
    norm, angles = hard.stored_angles(x, references)
    numbers = pa.list_(pa.float64())
    return pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[2] for r in rows], pa.int64()),
                     "v": pa.array(list(x), numbers), "norm": norm, "angles": pa.array(list(angles), numbers)})


@pytest.mark.parametrize("cell,held,block", [(32, 1 << 20, 1 << 20), (1, 1 << 20, 1 << 20), (8, 10, 500)])
def test_tiles_bound_cells_not_rows(monkeypatch, cell, held, block):
    for name, value in (("CELL", cell), ("HELD", held), ("BLOCK", block)):
        monkeypatch.setattr(hard, name, value)
    made, bounds = [], hard.score_bounds

    def counted(*a, **k):
        made.append(bounds(*a, **k))
        return made[-1]
    monkeypatch.setattr(hard, "score_bounds", counted)
    rows = vectors(600, 6, 4, 11, 2.0)
    rows += [(600 + i, *rows[i][1:]) for i in range(0, 600, 9)]   # copies: ties
    references = hard.reference_directions(hard.floored(np.array([r[1] for r in rows])))
    every, anchors = tile(rows, references), tile([r for r in rows if r[0] % 10 == 0], references)
    near = hard.near_rows(anchors, every, 5).to_pylist()
    best = {}
    for r in near:
        best.setdefault(r["anchor_id"], []).append(r)
    places = [[{"place": n + 1, "positive_score": r["positive_score"]} for n, r in enumerate(
        sorted(best[a], key=lambda r: (-r["positive_score"], r["positive_id"])))] for a in anchors["id"].to_pylist()]
    kind = pa.list_(pa.struct([("place", pa.int64()), ("positive_score", pa.int64())]))
    found = hard.window_rows(anchors.append_column("positives", pa.array(places, kind)), every, 3, 50, 95).to_pylist()
    of = {(r["anchor_id"], n + 1): r for rs in best.values()
          for n, r in enumerate(sorted(rs, key=lambda r: (-r["positive_score"], r["positive_id"])))}
    got = sorted((r["anchor_id"], of[r["anchor_id"], r["place"]]["positive_id"], r["negative_id"],
                  of[r["anchor_id"], r["place"]]["positive_score"], r["negative_score"]) for r in found)
    assert got == sorted((a, p, n, s, t) for a, p, _, n, s, t in brute(rows, 10))
    cells = sum(-(-sum(r[2] == label for r in rows) // cell) for label in range(4))
    assert sum(lower.size for lower, _ in made) == 2 * len(anchors) * cells   # not anchors times rows
    assert len(made) == 2 * -(-len(anchors) // max(1, block // cells))        # nor one call for each anchor


def test_bounds_of_cells_hold():
    rng = np.random.default_rng(1)
    x = hard.floored(np.repeat(rng.normal(0, 1, (6, 12)), 60, 0) + rng.normal(0, 0.1, (360, 12)))
    x[5] = 0
    norm, angles = hard.stored_angles(x, hard.reference_directions(x))
    order, starts = hard._cells(np.arange(360) % 3, angles)
    cell = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, 360)))
    low, high = (f.reduceat(norm[order], starts) for f in (np.minimum, np.maximum))
    low_angles, high_angles = (f.reduceat(angles[order], starts) for f in (np.minimum, np.maximum))
    lower, upper = hard.score_bounds(norm, angles, low, low_angles, 12, high, high_angles)
    exact = x @ x[order].T
    assert (lower[:, cell] <= exact).all() and (exact <= upper[:, cell]).all()
    assert (upper < 0.5 * exact.max(1)[:, None]).mean() > 0.3   # cells are left out
