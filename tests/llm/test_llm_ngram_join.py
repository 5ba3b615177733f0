import random
import re
from collections import defaultdict

import pytest

from dbpulse.llm.components import components
from dbpulse.llm.ngram_join import join_documents, keep_one_of_each

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                common[j] += 1
        for j, c in common.items():
            if j < i and 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[find(parent, i)] = find(parent, j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(parent, i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids, default=None)) for i in members]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed, clusters, members, length, edits):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    rows, n = [], 0
    for _ in range(clusters):
        base = [rnd.choice(vocabulary) for _ in range(length)]
        for _ in range(rnd.randint(1, members)):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                w += passage
            if rnd.random() < 0.2:
                w = w[:rnd.randint(1, len(w))]
            rows.append((n, " ".join(w)))
            n += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,clusters,members,length,edits,k,percent", [
    (1, 12, 25, 60, 4, 4, 85), (2, 40, 6, 120, 6, 5, 80), (3, 60, 8, 12, 2, 3, 60), (4, 2, 150, 80, 5, 4, 85)])
def test_against_brute_force(spark, seed, clusters, members, length, edits, k, percent):
    rows = corpus(seed, clusters, members, length, edits)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(join_documents(docs, k, percent)) == brute(rows, k, percent)


def test_a_chain_is_one_component(spark):
    """Neighbours link, the ends share nothing."""
    words = [f"c{i}" for i in range(400)]
    rows = [(1000 - i, " ".join(words[i * 3:i * 3 + 100])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 85)
    assert got(join_documents(docs, 4, 85)) == want and len({c for _, _, c in want}) == 1


def test_edge_rows(edge_docs, no_docs):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    assert got(join_documents(edge_docs, 4, 85)) == brute(rows, 4, 85)
    kept = keep_one_of_each(edge_docs, 4, 85)
    assert kept.columns == edge_docs.columns
    # the repeats of "the same text here today" go; empty sets (3, 4, 5) stay
    ids = sorted((r[0] for r in kept.select("doc_id").collect()), key=str)
    assert ids == sorted([1, 3, 4, 5, None, 7, 8, 9, 10, 5], key=str)
    assert join_documents(no_docs).count() == 0 and keep_one_of_each(no_docs).count() == 0


def test_kept_rows_are_one_of_each_component(spark):
    rows = corpus(7, 20, 10, 80, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {c for _, n, c in brute(rows, 5, 80) if n}
    assert {r.doc_id for r in keep_one_of_each(docs).collect()} == want


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
