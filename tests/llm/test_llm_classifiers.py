import zlib

import numpy as np
import pyarrow as pa
import pytest

from dbpulse.llm import lang_id, quality_fm
from dbpulse.llm.textkit import Words, shingles, utf8


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_held_out_accuracy(documents):
    langs = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    rows = lang_id.identify(documents).collect()
    assert len(rows) == len(langs) and all(r.held_out == (fold(r.doc_id, 3) == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_rows(edge_docs, no_docs, documents):
    model = lang_id.fit_language_model(documents)
    assert (model.weights == 0).mean() > 0.5 and set(model.labels) == {"de", "en", "es", "fr"}
    rows = lang_id.predict_languages(edge_docs, model).collect()
    texts = [r.text for r in edge_docs.collect()]
    assert len(rows) == len(texts)
    assert sorted(r.lang_pred == "und" for r in rows) == sorted(not any(c.isalpha() for c in t or "") for t in texts)
    assert lang_id.identify(edge_docs).count() == len(texts)
    assert lang_id.identify(no_docs).count() == 0
    unlabelled = edge_docs.withColumn("lang", edge_docs.lang.substr(100, 1)).where("lang is null")
    assert {r.lang_pred for r in lang_id.identify(unlabelled).collect()} == {"und"}


def with_greek(spark, documents, ids):
    words = "και το να του η της με που την από για είναι στο θα τα οι δεν".split()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words, 80)), "el", "src1", 1) for i in ids]
    return documents.unionByName(spark.createDataFrame(rows, documents.schema))


def test_language_rare_in_a_large_table_is_learnt(spark, documents):
    ids = [i for i in range(700_000, 700_100) if fold(i, 3) != 1][:6] + [None, None]
    docs = with_greek(spark, documents, ids)
    model = lang_id.fit_language_model(docs, fit_rows=40)  # 1 row of 17 is drawn, of all languages together
    assert set(model.labels) == {"de", "el", "en", "es", "fr"}
    rows = lang_id.predict_languages(docs.where("lang = 'el'"), model).collect()
    assert len(rows) == 8 and {r.lang_pred for r in rows} == {"el"}


def test_language_sample_is_bounded_for_each_language(spark, documents):
    copies = spark.range(3000).selectExpr("cast(null as long) doc_id", "'και το να' text", "'el' lang", "'src1' source", "9L n_chars")
    sample = lang_id.sample_of_each(documents.unionByName(copies), 100, 20)
    seen = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert seen["el"] == 1 and all(8 <= seen[x] <= 130 for x in ("de", "en", "es", "fr"))
    again = lang_id.sample_of_each(documents.unionByName(copies).repartition(7), 100, 20)
    assert sorted(r.key for r in sample.collect()) == sorted(r.key for r in again.collect())


def test_language_document_counts_cover_all_rows(documents):
    df, n = lang_id.document_counts(documents.repartition(5))
    texts = [r.text for r in documents.collect()]
    want = np.zeros(lang_id.SIZE, int)
    for f, _ in lang_id.sparse_rows(pa.array(texts, pa.string())):
        want[f] += 1
    assert n == len(texts) and (df == want).all()


def test_language_batches_do_not_matter(documents):
    model = lang_id.fit_language_model(documents)
    texts = [r.text for r in documents.orderBy("doc_id").limit(40).collect()] + ["", None, "ok", "😀 字"]
    together = model.predict(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        lang, score = model.predict(pa.array([t], pa.string()))
        assert lang[0] == together[0][i] and score[0] == pytest.approx(together[1][i], abs=1e-9)


def test_language_filter_keeps_clean_documents(documents, edge_docs):
    kept = lang_id.keep_identified(documents)
    assert kept.columns == documents.columns and kept.count() >= 0.995 * documents.count()
    model_docs = documents.select(*documents.columns).unionByName(edge_docs.select(*documents.columns))
    ids = {r.doc_id for r in lang_id.keep_identified(model_docs).where("n_chars < 30 or n_chars is null").collect()}
    assert 10 not in ids and 3 not in ids and 4 not in ids


ITALIAN = ("la casa di mio nonno era sulla collina e ogni mattina il sole entrava dalle finestre mentre noi bambini "
           "correvamo nel giardino con gli altri ragazzi del paese che venivano a giocare fino a sera quando la nonna "
           "ci chiamava per la cena")
POLISH = ("dom mojego dziadka stał na wzgórzu i każdego ranka słońce wpadało przez okna a my dzieci biegaliśmy po ogrodzie "
          "z innymi chłopcami ze wsi którzy przychodzili bawić się aż do wieczora kiedy babcia wołała nas na kolację")


@pytest.mark.parametrize("langs", [["en"], ["en", "de"], ["de", "en", "es", "fr"]])
def test_language_filter_drops_what_fits_no_learnt_language(spark, documents, langs):
    rng = np.random.default_rng(8)
    junk = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60))
    # next to Spanish, Italian is as near as learnt languages' prose of other genres, and stays
    foreign = [POLISH, junk, "και το να του η της με που " * 5] + ([] if "es" in langs else [ITALIAN])
    planted = [(900_000 + i, t, None, "src1", 9) for i, t in enumerate(foreign)]
    own = documents.where(documents.lang.isin(langs))
    kept = lang_id.keep_identified(own.unionByName(spark.createDataFrame(planted, documents.schema)))
    assert kept.where("doc_id >= 900000").count() == 0
    assert kept.count() >= 0.995 * own.count()


PROSE = {
    "en": ["The museum reopened last spring after three years of repairs, and the first visitors were surprised by how bright the old halls had become.",
           "Heavy rain is expected across the northern counties tonight, with a risk of flooding on low roads near the river."],
    "de": ["Das Museum wurde im vergangenen Frühjahr nach drei Jahren Umbau wieder eröffnet, und die ersten Besucher staunten über die hellen Säle.",
           "Für die nördlichen Landkreise wird heute Nacht starker Regen erwartet, auf tiefer gelegenen Straßen droht Hochwasser."],
    "fr": ["Le musée a rouvert ses portes au printemps dernier après trois ans de travaux, et les premiers visiteurs ont été surpris par la clarté des salles.",
           "De fortes pluies sont attendues cette nuit dans les départements du nord, avec un risque d'inondation près de la rivière."],
    "es": ["El museo volvió a abrir la primavera pasada después de tres años de obras, y los primeros visitantes se sorprendieron de la luz de las salas.",
           "Se esperan fuertes lluvias esta noche en las provincias del norte, con riesgo de inundaciones en los caminos junto al río."]}
OTHERS = ["Muzeum otwarto ponownie wiosną po trzech latach remontu, a pierwsi zwiedzający byli zaskoczeni jasnością starych sal.",
          "Museo avattiin uudelleen viime keväänä kolmen vuoden korjausten jälkeen, ja ensimmäiset kävijät ihmettelivät salien valoisuutta.",
          "Müze üç yıllık onarımın ardından geçen ilkbaharda yeniden açıldı ve ilk ziyaretçiler salonların aydınlığına şaşırdı.",
          "Музей вновь открылся весной после трёх лет ремонта, и первые посетители удивились светлым залам.",
          "qwpo zxmn vbkj hgqw plkz mxnb qazw sxed crfv tgby hnuj mikl opqz wsxq edcz rfvx tgbq yhnz ujmx"]


def test_language_filter_keeps_prose_of_learnt_languages(spark, documents):
    """Sentences of another genre than the table's, which the cutoff was not chosen on."""
    planted = [(900_000 + i, t, None, "src1", 9) for i, t in enumerate(x for v in PROSE.values() for x in v)]
    planted += [(910_000 + i, t, None, "src1", 9) for i, t in enumerate(OTHERS)]
    docs = spark.createDataFrame(planted, documents.schema)
    for size in (documents, documents.where("doc_id % 5 = 0")):   # the cutoff does not move with the table
        kept = lang_id.keep_identified(size.unionByName(docs)).where("doc_id >= 900000")
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [900_000 + i for i in range(8)]


def test_temperature_and_ftrl():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 3000)
    z = np.eye(3)[y] * 2 + rng.gumbel(size=(3000, 3)) * 0
    assert lang_id.fit_temperature(z * 0 + rng.normal(size=(3000, 3)), y) > 5
    rows = [(np.array([c, 7]), np.array([0.5, 0.5])) for c in y[:600]]
    w, b = lang_id.fit_ftrl(rows, y[:600], 3)
    assert all((np.array([x @ w[f] + b for f, x in rows]).argmax(1) == y[:600]))


def test_quality_held_out(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_fm.judge_quality(documents, labels).collect()
    assert len(rows) == documents.count() and all(r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    held = [(truth[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([y == p for y, p, _ in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(4)
    machine = quality_fm.FactorisationMachine(0.2, rng.normal(size=quality_fm.SIZE), rng.normal(size=(quality_fm.SIZE, 3)))
    f, x = np.array([3, 9, 40, 77]), np.array([0.5, 1.0, -0.2, 0.7])
    z = 0.2 + machine.w[f] @ x + sum(machine.v[f[i]] @ machine.v[f[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert machine.score(1, np.zeros(4, int), f, x)[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (7, 0, 0, "x"), (9, 1, None, "x"), (10, 0, 1, "x"), (10, 0, 1, "x"), (11, None, 1, "x"),
                                    (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    rows = quality_fm.judge_quality(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_fm.judge_quality(no_docs, labels).count() == 0
    assert quality_fm.judge_quality(edge_docs, labels.limit(0)).count() == len(rows)
    assert quality_fm.judge_quality(edge_docs.drop("n_chars"), labels).count() == len(rows)


def test_words_and_shingles_of_a_batch():
    texts = ["One two  three", None, "", " \t", "a", "x y z x y z x y z", "é\x0bÉ one TWO", "w" * 300]
    words = Words(*utf8(pa.array(texts, pa.string())))
    assert words.counts.tolist() == [len((t or "").split()) for t in texts]
    row, token = shingles(words, 3)
    assert np.bincount(row, minlength=len(texts)).tolist() == [1, 0, 0, 0, 1, 3, 2, 1]
    alone = [set(shingles(Words(*utf8(pa.array([t], pa.string()))), 3)[1].tolist()) for t in texts]
    assert [set(token[row == i].tolist()) for i in range(len(texts))] == alone
    a, b = (shingles(Words(*utf8(pa.array([t]))), 2)[1].tolist() for t in ("Ab cD", "aB Cd"))
    assert a == b
