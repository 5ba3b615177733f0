import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import dbpulse.llm.binary_index as binary
import dbpulse.llm.tiles as tiles

SCHEMA = "vec_id long, embedding array<float>, VEC_ID string, code int, radius int"


def distance(v, w):
    total = 0.0
    for a, b in zip(v, w):   # sum() would carry the rounding along
        total += (a - b) * (a - b)
    return math.sqrt(total)


def brute(rows, every, k):
    usable = [(r[0], [float(x) for x in r[1]]) for r in rows if r[0] is not None and r[1] is not None
              and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    asked, out = {}, {}
    for q, v in usable:
        if q % every == 0:
            asked[q] = min(asked.get(q, v), v)
    for q, v in asked.items():
        found = sorted((distance(v, w), i) for i, w in usable if i != q and len(w) == len(v))
        if found:
            out[q] = found[:k]
    return out


def run(spark, rows, every=10, k=10, **options):
    got = binary.nearest(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.col("id") % every == 0, k, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for q, rank, i, s in sorted(map(tuple, got.collect())):
        assert rank == len(out.setdefault(q, [])) + 1
        out[q].append((s, i))
    assert all(x == sorted(x) for x in out.values())
    return out


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, dim))
    return [(i, [float(x) for x in np.float32(centres[i % 5] + rng.normal(0, 1, dim))], "a", 1, 2) for i in range(n)]


@pytest.mark.parametrize("dim", [2, 24, 64, 100])
def test_recall_and_exact_scores(spark, monkeypatch, dim):
    monkeypatch.setattr(tiles, "LEAST_ROWS", 100)
    rows = vectors(1500, dim, dim)
    got, want = run(spark, rows), brute(rows, 10, 10)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)   # scores equal to the last bit
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_sample_smaller_than_the_table(spark):
    rows = vectors(1500, 32, 1)
    got, want = run(spark, rows, fit_rows=300), brute(rows, 10, 10)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_edge_rows_have_all_candidates(spark):
    rows = [(i, [1.0, 0.5], "a", 1, 2) for i in range(6)] + [(10, [1.0, 0.5], "a", 1, 2), (10, [0.5, 0.5], "a", 1, 2)]
    rows += [(20, None, None, None, None), (30, [None, 1.0], "a", 1, 2), (40, [0.0, 0.0], "a", 1, 2),
             (50, [float("nan"), 1.0], "a", 1, 2), (60, [float("-inf"), 1.0], "a", 1, 2), (70, [3.0], "a", 1, 2),
             (71, [4.0], "a", 1, 2), (80, [], "a", 1, 2), (None, [1.0, 2.0], "a", 1, 2), (90, [5.0, 1.0, 2.0], "a", 1, 2)]
    assert run(spark, rows) == brute(rows, 10, 10)   # fewer than k: all, by the widest radius


def test_copies_of_one_vector(spark):
    rows = [(r[0], [1.0] * 8 if r[0] % 3 == 0 else r[1], *r[2:]) for r in vectors(600, 8, 2)]
    got, want = run(spark, rows), brute(rows, 10, 10)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert got[30] == want[30] and got[30][0] == (0.0, 0)


def test_no_rows(spark):
    assert run(spark, []) == {}


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    codes[::3] = codes[0] ^ np.uint64(5)
    index = binary.SubstringIndex(codes)
    for r in (0, 1, 3, 7, 8, 9, 20, 28, 40, 64):
        assert sum(t + 1 for t in binary.part_distances(r)) == max(r + 1, 0)
        for i in (0, 1, 77):
            want = np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= r)
            assert index.within(codes[i], r).tolist() == want.tolist()


def test_rotation_keeps_more_than_a_random_one():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (2000, 16)) * np.linspace(4, 0.2, 16)
    turn = binary.learnt_rotation(x)
    assert turn.shape == (16, binary.BITS)

    def loss(r):
        y = (x - x.mean(0)) @ r
        return np.linalg.norm(y / np.linalg.norm(y) - np.where(y > 0, 1, -1) / np.sqrt(y.size))
    assert loss(turn[:, :16]) < loss(np.eye(16))
