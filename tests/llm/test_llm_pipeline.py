import corpus_pipeline
from dbpulse.llm.bpe import encoder, word_bpe_path
from dbpulse.llm.common import cut
import __spark_entry__ as entry


def test_registered():
    names = entry.queries().keys()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and [s for s, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "ngram_jaccard_join", "source_mix", "bpe"]


def test_stages_over_planted_documents(spark, edge_docs):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = documents.where("doc_id = 3").first()
    planted = [(5001, base.text, base.lang, base.source, base.n_chars), (5002, base.text + " one more", base.lang, base.source, 1),
               (5003, "12 34 !!", "en", "src1", 8), (5004, None, None, None, None)]
    docs = documents.unionByName(spark.createDataFrame(planted, documents.schema))
    out, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, out, ""))
        seen[name] = out
        if name != "bpe":
            assert out.columns == documents.columns
    ids = {n: {r.doc_id for r in df.select("doc_id").collect()} for n, df in seen.items()}
    assert {5003, 5004} & ids["language_id"] == set() and {5001, 5002} <= ids["language_id"]
    assert 5001 not in ids["exact_dedup"] and 5002 in ids["exact_dedup"]
    assert 5002 not in ids["ngram_jaccard_join"]
    mixed = seen["source_mix"].collect()
    enc = encoder(word_bpe_path())
    want = sorted((r.doc_id, ids) for r in mixed for _, ids, _ in enc.encode([r.text]))
    assert sorted((r.doc_id, " ".join(map(str, r.ids))) for r in out.collect()) == want


def test_stages_take_edge_rows_and_nothing(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, out, ""))
            if name != "bpe":
                assert out.columns == docs.columns
        assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    for name, stage in corpus_pipeline.STAGES:  # each by itself
        assert stage(spark, edge_docs, "").count() > 0 and stage(spark, no_docs, "").count() == 0
