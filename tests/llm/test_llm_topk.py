import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import dbpulse.llm.topk as topk


def brute(rows, every, k):
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
              if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, every=5, k=5):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, VEC_ID string, v int")
    got = topk.top_k(table, "vec_id", "embedding", F.col("id") % every == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def vectors(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.float32(rng.normal(0, scale, dim))], "a", 1) for i in range(n)]


@pytest.mark.parametrize("dim,scale", [(16, 0.1), (3, 5.0), (1, 1.0), (64, 1e-3)])
def test_against_brute_force(spark, monkeypatch, dim, scale):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 37)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 11)
    rows = vectors(150, dim, 4, scale)
    assert run(spark, rows) == brute([r[:2] for r in rows], 5, 5)


def test_ties_and_edge_vectors(spark):
    rows = [(i, [1.0, 0.5], "a", 1) for i in range(12)]
    rows += [(20, None, None, None), (25, [None, 1.0], "a", 1), (30, [float("nan"), 1.0], "a", 1),
             (35, [float("inf"), 1.0], "a", 1), (40, [2.0], "a", 1), (45, [], "a", 1), (46, [], "a", 1),
             (50, [-3.0, -3.0], "a", 1), (51, [1e9, 1e9], "a", 1), (55, [1e9, -1e9], "a", 1)]
    assert run(spark, rows) == brute([r[:2] for r in rows], 5, 5)


def test_fewer_than_k_and_none(spark):
    rows = vectors(3, 4, 1)
    assert run(spark, rows) == brute([r[:2] for r in rows], 5, 5)
    assert run(spark, rows[:1]) == []
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(table, "vec_id", "embedding", F.col("id") % 5 == 0).count() == 0
