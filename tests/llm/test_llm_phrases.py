import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import dbpulse.llm.phrases as phrases

SCHEMA = "doc_id long, text string, lang string, TEXT string, phrase int, n int, words int"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, most=4, least=30, top=2000, scale=2_000_000, covered=80):
    counts, totals = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in range(1, most + 1):
                counts.update((lang, *ws[i:i + k]) for i in range(len(ws) - k + 1))
    found = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    holder = Counter()
    for (lang, *ws), f in found.items():
        for size in range(2, len(ws)):
            for i in range(len(ws) - size + 1):
                key = (lang, *ws[i:i + size])
                holder[key] = max(holder[key], f)
    out = []
    for lang in totals:
        left = []
        for (own, *ws), a in found.items():
            if own != lang or 100 * holder[(own, *ws)] >= covered * a:
                continue
            score, _, l, r = min((scale * a // (counts[(lang, *ws[:k])] + counts[(lang, *ws[k:])]), k,
                                  counts[(lang, *ws[:k])], counts[(lang, *ws[k:])]) for k in range(1, len(ws)))
            left.append((-score, -a, " ".join(ws).encode(), l, r))
        for n, (s, a, p, l, r) in enumerate(sorted(left)[:top]):
            out.append((lang, n + 1, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def run(spark, rows, parts=3, **options):
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(parts), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def corpus(n, seed, vocabulary):
    rng = random.Random(seed)
    blanks, marks = [" ", "  ", "\t", " \t "], [". ", ", ", "\n", "!?", " ; ", ":", "\r\n", "\x0b", "\x0c"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(90))   # longer than a chunk may be
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice(blanks if rng.random() < 0.85 else marks)
                       for _ in range(rng.randrange(60)))
        if i % 3 == 0:
            text += passage
        rows.append((i, text, rng.choice(["en", "de", None, "und"]), "x", 1, 2, 3))
    return rows


VOCABULARY = ["The", "the", "cat", "Sat", "é", "naïve", "Ü", "ü", "日本", "😀", "a b", "x-y", "'s", "0", "w" * 70]


@pytest.mark.parametrize("seed,least", [(1, 30), (2, 5), (3, 1)])
def test_against_brute_force(spark, seed, least):
    rows = corpus(250, seed, VOCABULARY[:6 + 3 * seed])
    assert run(spark, rows, least=least) == brute(rows, least=least)


def test_small_filter_small_chunks_and_limit(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", (32, 64))   # lets nearly all through
    monkeypatch.setattr(phrases, "BATCH_BYTES", 300)
    rows = corpus(200, 5, VOCABULARY)
    assert run(spark, rows, least=4, top=7) == brute(rows, least=4, top=7)


def test_edge_texts(spark, edge_docs, no_docs):
    assert phrases.collocations(no_docs).count() == 0
    own = edge_docs.select("doc_id", "text", "lang", F.lit("x").alias("TEXT"), F.lit(1).alias("phrase"),
                           F.lit(1).alias("n"), F.lit(1).alias("words"))
    rows = [tuple(r) for r in own.collect()]
    rows += [(90, None, "empty", "x", 1, 1, 1), (91, " ,. ", "empty", "x", 1, 1, 1), (92, "so so", "", "x", 1, 1, 1)] * 20
    assert run(spark, rows, least=2) == brute(rows, least=2)
    assert run(spark, rows) == brute(rows)      # one text repeats a word 40,000 times


def test_parse_covers_each_start_once_and_repeats_on_copies():
    rng = random.Random(7)
    words = [f"w{rng.randrange(50)}" for _ in range(400)]
    shared = " ".join(words[100:300])
    row, chunk = phrases.chunks(pa.array([" ".join(words), "other start here " + shared, "", None, "x" * 5000]))
    texts = chunk.to_pylist()
    for r, want in ((0, words), (1, ["other", "start", "here", *words[100:300]])):
        own = [t for t, k in zip(texts, row) if k == r]
        assert [w for t in own for w in t.split("\v")[0].split()] == want
        assert all(len(t.split("\v")[0].split()) <= phrases.LONGEST for t in own)
        done = 0
        for t in own:   # an overlap of three words, or what is left
            done += len(t.split("\v")[0].split())
            assert t.split("\v")[1:] == [" ".join(want[done:done + 3])][:len(want) - done]
    assert len({t for t, k in zip(texts, row) if k == 0} & {t for t, k in zip(texts, row) if k == 1}) >= 3
    assert set(row) == {0, 1, 4}


def test_segments_keep_the_whole_text():
    text = ("abc def. " * 50 + "ghi " * 100 + "\nend") * 3
    parts = [p.to_pylist()[0] for p in phrases.segments(pa.array([text]), 64)]
    assert "".join(parts) == text and len(parts) > 10
    assert all(p[-1] in ".\n" for p in parts[:-1])


def test_only_frequent_words_and_pairs_become_texts(spark):
    rows = corpus(150, 11, [f"v{i}" for i in range(60)])
    docs = spark.createDataFrame(rows, SCHEMA)
    dictionary = phrases.parse(docs).cache()
    counts = Counter()
    for r in dictionary.collect():
        for row, found in phrases.phrases(pa.array([r["chunk"]]), range(1, 3)):
            counts.update({(r["lang"], p): n * r["n"] for p, n in Counter(found.to_pylist()).items()})
    frequent = {p for p, n in counts.items() if n >= 30}
    assert 60 < len(frequent) < len(counts) / 2
    keys = phrases.frequent_hashes(dictionary, 30)
    assert keys.count() == len(frequent)
    bits = phrases.hash_filter(keys)
    for r in dictionary.collect():
        chunk, lang = pa.array([r["chunk"]]), phrases._lang_hash(pa.array([r["lang"]]))

        def passes(row, value):
            places = phrases.filter_places(phrases.mix64(value ^ lang[row]), len(bits) * 8)
            return (bits[places[0] >> 3] >> (places[0] & 7) & 1 > 0) & (bits[places[1] >> 3] >> (places[1] & 7) & 1 > 0)
        for (_, every), (_, found) in zip(phrases.phrases(chunk, range(1, 3)), phrases.phrases(chunk, range(1, 3), passes)):
            wanted = [p for p in every.to_pylist() if (r["lang"], p) in frequent]
            assert [p for p in found.to_pylist() if (r["lang"], p) in frequent] == wanted
            assert len(found) <= len(wanted) + 2   # a few more may pass the filter
    assert {(r["lang"], r["phrase"]): r["f"] for r in phrases.count_phrases(dictionary, range(1, 3), 30, bits).collect()} == {
        p: counts[p] for p in frequent}
    dictionary.unpersist()
