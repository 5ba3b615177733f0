import re
from collections import defaultdict

import numpy as np
import pytest

from dbpulse.llm.common import exclusive_prefix
from dbpulse.llm.mixing import mix_documents, mixed_documents, permuted, source_targets


def targets(sizes):
    """Water filling round by round: sources over their cap stop, the excess is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s] or sizes[s] == 0}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 20, "c": 30}, {"a": 1, "b": 1000, "é": 50, None: 7, "z": 3}, {"x": 0, "y": 5}, {"only": 9}, {None: 4, "": 6}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(table).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-12, abs=1e-9)


def test_permutation():
    for size in (1, 2, 3, 5, 16, 17, 1000, 4097):
        seen = permuted(np.arange(size), np.full(size, size), np.full(size, 99))
        assert sorted(seen.tolist()) == list(range(size))
    a, b = (permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (1, 2))
    assert (a != b).mean() > 0.9


def test_prefix_sums_over_three_levels(spark):
    rows = [(k, i, (i * 7 + k) % 5) for k in (0, 1) for i in range(0, 70, 1 + k)]
    df = spark.createDataFrame(rows, "key long, idx long, n long")
    got = {(r.key, r.idx): r.out for r in exclusive_prefix(df, "key", "idx", "n", "out", 70, radix=4).collect()}
    assert got == {(k, i): sum(n for x, j, n in rows if x == k and j < i) for k, i, _ in rows}


def test_taken_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix_documents(docs).collect()
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    assert len(rows) == len(texts)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        text, source = texts[r.doc_id]
        assert r.size == len(words(text)) and 0 <= r.taken <= 2 * r.size
        size[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
    want = targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s], rel=1e-12)
        assert taken[s] == pytest.approx(target[s], rel=0.02, abs=128)
    again = {(r.doc_id, r.taken) for r in mix_documents(docs.repartition(11)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_edge_rows(edge_docs, no_docs):
    rows = mix_documents(edge_docs, block_words=2).collect()
    assert len(rows) == edge_docs.count()
    assert sorted(r.size for r in rows) == sorted(len(words(r.text)) for r in edge_docs.collect())
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mix_documents(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0


def test_mixed_documents_hold_the_words_taken(edge_docs):
    mixed = mixed_documents(edge_docs, block_words=2)
    assert mixed.columns == edge_docs.columns
    rows = mixed.collect()
    taken = defaultdict(int)
    for r in mix_documents(edge_docs, block_words=2).collect():
        taken[r.doc_id] += r.taken
    got = defaultdict(int)
    own = defaultdict(set)
    for r in edge_docs.collect():
        own[r.doc_id].update(words(r.text))
    for r in rows:
        got[r.doc_id] += len(words(r.text))
        assert set(words(r.text)) <= own[r.doc_id] and r.n_chars == len(r.text)
    assert dict(got) == {k: v for k, v in taken.items() if v}
