import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dbpulse.llm.bpe import Vocabulary, encode_documents, encode_words, encoder, word_bpe_path

ALPHABET = ["a", "A", "Σ", "ς", "İ", "é", "é", "\x1c", "\x85", "　", "5", "½", "٣", "'s", "'LL", "don't", "<|startoftext|>",
            "<|endoftext|>", "<|startof", "|>", "aaaa", "日本", "😀", "\n", " ", "!", "_", "ﬁ", "\x00", "hello", "the", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe_path())


def expect(library, text):
    e = library.encode(text or "", add_special_tokens=False)
    return len(e.ids), " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)


ASSIGNED = st.characters(exclude_categories=("Cs", "Cn"))


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(ALPHABET), st.text(ASSIGNED, max_size=6)), max_size=14))
def test_any_text_as_the_library(library, parts):
    text = "".join(parts)
    assert next(iter(encoder(word_bpe_path()).encode([text]))) == expect(library, text)


def test_documents_as_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = encode_documents(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, ids, decoded = expect(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_edge_rows_and_whole_outputs(edge_docs, no_docs, library):
    rows = encode_documents(edge_docs, digests=False).collect()
    texts = [r.text for r in edge_docs.collect()]
    assert sorted((r.n_tokens, " ".join(map(str, r.ids)), r.decoded) for r in rows) == sorted(
        expect(library, t) for t in texts)
    assert encode_documents(no_docs).count() == 0


def test_runs_of_one_symbol_and_empty_words():
    vocab = Vocabulary(word_bpe_path())
    words = [b"", b"a", b"aa", b"aaa", b"aaaaaaa", b"banana" * 50, b""]
    single = [encode_words([w], vocab)[0] for w in words]
    assert encode_words(words, vocab) == single
    assert single[0] == []


def test_words_met_again_are_not_encoded_again(monkeypatch):
    from dbpulse.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 100)
    encoded = []
    monkeypatch.setattr(bpe, "encode_words", lambda words, vocab: encoded.extend(words) or encode_words(words, vocab))
    enc = bpe.Encoder(Vocabulary(word_bpe_path()))
    texts = [" ".join(["often", "seen", *(f"rare{'x' * (i + 1)}y{'z' * j}" for j in range(3))]) for i in range(100)]
    found = list(enc.encode(texts))
    assert encoded.count(b"often") == encoded.count(b"seen") == 1   # though the rare ones fill the tables several times
    assert len(enc.ids) + len(enc.older[0]) <= 2 * (50 + 100)
    single = bpe.Encoder(enc.vocab)
    assert found == [next(iter(single.encode([t]))) for t in texts]
    enc.forget()
    assert not (enc.ids or enc.decoded or any(enc.older))
