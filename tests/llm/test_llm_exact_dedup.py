import hashlib
import re

from pyspark.sql import functions as F

from dbpulse.llm.exact_dedup import drop_copies, exact_groups


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [j for (j, _), m in zip(rows, norm) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_edge_rows(edge_docs):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    assert got(exact_groups(edge_docs)) == brute(rows)


def test_clashing_hashes_are_told_apart_by_their_texts(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one_value = lambda norm: F.when(F.length(norm) > 0, F.lit("x")).otherwise(F.lit("y"))
    assert got(exact_groups(docs, one_value)) == brute(rows)
    kept = {r[0] for r in drop_copies(docs, one_value).select("doc_id").collect()}
    assert kept == {0, 1, 2, 3, 4, 5, 6, 100}


def test_a_third_of_all_rows_is_one_text(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) as text")
    rows = [tuple(r) for r in docs.collect()]
    assert got(exact_groups(docs.repartition(7))) == brute(rows)


def test_drop_copies_keeps_all_columns_and_one_row_each(edge_docs, no_docs):
    kept = drop_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted((r[0] for r in kept.select("doc_id").collect()), key=str)
    # 3, 4: null and empty are equal; 5 holds one blank; 2 and its repeat equal 1
    assert ids == sorted([1, 3, 5, None, 7, 8, 9, 10, 11, 5], key=str)
    assert drop_copies(no_docs).count() == 0 and exact_groups(no_docs).count() == 0


def test_repeated_rows_of_the_kept_id(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a  b")], "doc_id long, text string")
    assert [tuple(r) for r in drop_copies(docs).collect()] == [(1, "a b")]
    assert all(r.kept == (r.doc_id == 1) for r in exact_groups(docs).collect())
