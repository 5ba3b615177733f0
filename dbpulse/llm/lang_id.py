"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

Features are the hashed runs of 1 to 3 characters (lower case, every run of
characters that are no letter as one blank) of the whole text: the share of
each n-gram among the text's n-grams of its length, times its inverse document
frequency. Document frequencies and the list of languages come from all rows
that may be learnt from (a grouped sum, at most 3 * 2^16 numbers). The weights
are learnt row by row with follow-the-regularised-leader (per-coordinate
rates, elastic net: L1 makes them sparse, L2 bounds them), on a sample: of each
language its share of about ``fit_rows`` rows, but ``each`` rows at least or all
it has, drawn by a hash of id and text, a repeated row once. A temperature,
fitted on every fifth row of each language's sample, calibrates the scores.

A prediction sums looked-up weights over the text's n-grams, in numpy. The
scores of a text add up to 1, also where no learnt language fits. So a text
has a second number, ``fit``: its mean log frequency of 3-grams in a learnt
language, less what the language's own texts have, for the language where that
is largest. Frequencies come from the sample, mixed with a uniform share
(``UNIFORM``), so an unseen 3-gram weighs the same whatever the sample's size.
The filter keeps a text whose fit is above ``REJECT_FIT``, a fixed number of
nats: prose of other genres in a learnt language stays, other languages and
letter junk go. Texts of less than ``SHORT`` 3-grams get a wider margin.

Defined cases: null text or text without a letter: ``und``, score 0; no
labelled row at all: every text is ``und``; labels with one value only: that
value; rows without a label are predicted but not learnt from; repeated rows
are judged alike; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dbpulse.llm.common import pick, positional, restored
from dbpulse.llm.textkit import slices

BITS = 16            # hashed features for each n-gram length
LENGTHS = (1, 2, 3)
SIZE = len(LENGTHS) << BITS
FIT_ROWS = 6000      # the fitting sample, dealt to the languages by their shares ...
FIT_EACH = 200       # ... but of each language so many rows at least, or all it has
REJECT_FIT = -4.2    # nats; the filter keeps a document whose fit is above that
UNIFORM = 0.1        # share of the uniform distribution in a 3-gram's frequency
SHORT = 30           # 3-grams; the mean of fewer says less


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For the code points below 0x10000: lower case, blank if no letter; and whether a letter."""
    low = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            x = ch.lower()
            low[c] = ord(x[0])
        else:
            low[c] = 32
    return low, low != 32


_LOW, _LETTER = _tables()


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets) of the texts, folded as the module says.

    A blank stands before each text and after it, and for every run of
    characters that are no letters. Letters beyond 0xFFFF stand as they are.
    """
    strings = [t or "" for t in texts.to_pylist()]
    joined = "\0".join(["", *strings, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(points, 0xFFFF)
    folded = np.where(points > 0xFFFF, points, _LOW[small])
    if points.max(initial=0) > 0xFFFF:
        for p in np.unique(points[points > 0xFFFF]):
            if unicodedata.category(chr(p))[0] != "L":
                folded[points == p] = 32
    ends = np.cumsum([len(t) + 1 for t in strings]) if strings else np.zeros(0, np.int64)
    edge = np.zeros(len(points), bool)
    edge[np.concatenate([[0], ends]).astype(np.int64)] = True
    keep = np.ones(len(points), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | edge[1:]
    kept_edges = np.cumsum(keep)[np.flatnonzero(edge)] - 1
    return folded[keep], kept_edges


def features(points: np.ndarray, edges: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length (row, hashed feature) of every n-gram, in text order."""
    rows = len(edges) - 1
    out = []
    for k, n in enumerate(LENGTHS):
        size = len(points) - n + 1
        if size <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        h = np.full(size, n, np.uint32)
        for j in range(n):
            h = (h ^ points[j:j + size]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        feature = (h >> np.uint32(32 - BITS)).astype(np.int64) + (k << BITS)
        # an n-gram belongs to the row where it begins and may not go past the row's last blank
        first = edges[:-1] + (n == 1)
        last = np.maximum(edges[1:] - n + 1 + (n > 1), first)
        last = np.minimum(last, size)
        first = np.minimum(first, last)
        lengths = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        out.append((np.repeat(np.arange(rows), lengths), feature[at]))
    return out


@dataclass
class Typical:
    """What 3-grams a language's texts have: log frequencies by (feature, label), and each label's mean."""

    logs: np.ndarray
    mean: np.ndarray

    def fits(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        """The best fit of each text to a label, from (row, hashed feature) of their 3-grams; 0 without any."""
        n = np.bincount(row, minlength=rows)
        logs = self.logs[feature - (2 << BITS)]
        value = np.stack([np.bincount(row, weights=logs[:, c], minlength=rows) for c in range(len(self.mean))], 1)
        best = (value / np.maximum(n, 1)[:, None] - self.mean).max(1)
        margin = np.maximum(3 / np.sqrt(np.maximum(n, 1)) - 3 / np.sqrt(SHORT), 0)
        return np.where(n > 0, best + margin, 0.0)


def fit_typical(texts: list[str], y: np.ndarray, classes: int) -> Typical:
    """From a sample's texts and labels."""
    size = 1 << BITS
    counts = np.zeros((size, classes))
    for s in range(0, len(texts), 200):
        row, feature = features(*letters(pa.array(texts[s:s + 200], pa.string())))[2]
        np.add.at(counts, (feature - (2 << BITS), y[s:s + 200][row]), 1)
    share = counts / np.maximum(counts.sum(0), 1)
    logs = np.log((1 - UNIFORM) * share + UNIFORM / size)
    return Typical(logs.astype(np.float32), (share * logs).sum(0))


@dataclass
class LanguageModel:
    """Weights by (feature, label); they hold the inverse document frequencies and the temperature."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    typical: Typical | None = None

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        return self.judge(texts, fit=False)[:2]

    def judge(self, texts: pa.Array, fit: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and (if asked for) fit of each text."""
        points, edges = letters(texts)
        rows = len(edges) - 1
        letter = np.add.reduceat((points != 32).astype(np.int64), edges[:-1]) if rows else np.zeros(0, np.int64)
        if not self.labels:
            return ["und"] * rows, np.zeros(rows), np.zeros(rows)
        z = np.tile(self.bias, (rows, 1))
        for row, feature in features(points, edges):
            counts = np.bincount(row, minlength=rows)
            w = self.weights[feature]
            for c in range(len(self.labels)):
                z[:, c] += np.bincount(row, weights=w[:, c], minlength=rows) / np.maximum(counts, 1)
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        known = letter > 0
        fits = self.typical.fits(row, feature, rows) if fit and self.typical else np.zeros(rows)
        return ([self.labels[b] if k else "und" for b, k in zip(best, known)],
                np.where(known, p[np.arange(rows), best], 0.0), fits)


def sparse_rows(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, shares) of each text, distinct features."""
    points, edges = letters(texts)
    rows = len(edges) - 1
    parts: list[list] = [[] for _ in range(rows)]
    for row, feature in features(points, edges):
        counts = np.bincount(row, minlength=rows)
        key, n = np.unique(row * SIZE + feature, return_counts=True)
        r, f = np.divmod(key, SIZE)
        cuts = np.searchsorted(r, np.arange(rows + 1))
        for i in range(rows):
            s = slice(cuts[i], cuts[i + 1])
            parts[i].append((f[s], n[s] / max(counts[i], 1)))
    return [(np.concatenate([a for a, _ in p]), np.concatenate([b for _, b in p])) for p in parts]


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha=0.5, beta=1.0,
             l1=0.02, l2=0.02, epochs=3) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, one row at a time: (weights, bias)."""
    size = SIZE
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], size), np.append(rows[i][1], 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            nn = n[at]
            z[at] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha * w
            n[at] = nn + g * g
    w = weights(np.arange(size + 1))
    return w[:-1], w[-1]


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores that makes the held-back labels likeliest."""
    if not len(y):
        return 1.0

    def loss(t):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return -(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(1))).mean()

    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def fit(texts: list[str | None], langs: list[str], df: np.ndarray, documents: int) -> LanguageModel:
    """A model from a sample of labelled texts and the document frequencies ``df`` of all ``documents``."""
    labels = sorted(set(langs))
    y = np.array([labels.index(x) for x in langs], np.int64)
    typical = fit_typical(texts, y, len(labels)) if labels else None
    if len(labels) < 2:
        return LanguageModel(labels, np.zeros((SIZE, len(labels))), np.zeros(len(labels)), typical)
    rows = []
    for s in range(0, len(texts), 200):
        rows += sparse_rows(pa.array(texts[s:s + 200], pa.string()))
    idf = np.log((1 + documents) / (1 + df)) + 1
    rows = [(f, x * idf[f]) for f, x in rows]
    held = np.zeros(len(rows), bool)
    for c in range(len(labels)):  # of each language, so that none is held back whole
        held[np.flatnonzero(y == c)[4::5]] = True
    learn = [r for r, h in zip(rows, held) if not h]
    w, b = fit_ftrl(learn, y[~held], len(labels))
    scores = np.array([x @ w[f] + b for (f, x), h in zip(rows, held) if h])
    t = fit_temperature(scores, y[held])
    return LanguageModel(labels, (w * idf[:, None] / t).astype(np.float32), b / t, typical)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def document_counts(labelled: DataFrame) -> tuple[np.ndarray, int]:
    """(rows that hold each hashed feature, rows) over all rows of ``labelled``."""
    def run(batches):
        df, rows, place = np.zeros(SIZE + 1, np.int64), 0, np.zeros(SIZE, np.int64)
        for part in slices(batches, "text"):
            points, edges = letters(part.column(0))
            for row, feature in features(points, edges):
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    f = feature[cuts[i]:cuts[i + 1]]
                    at = np.arange(len(f))
                    place[f] = at
                    df[f[place[f] == at]] += 1  # each feature of the row once
            rows += part.num_rows
        df[SIZE] = rows
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(df[found], pa.int64())],
                                         names=["feature", "n"])

    got = (labelled.select("text").mapInArrow(run, "feature long, n long")
           .groupBy("feature").agg(F.sum("n").alias("n")).toPandas())
    df = np.zeros(SIZE + 1, np.int64)
    df[got["feature"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return df[:SIZE], int(df[SIZE])


def sample_of_each(labelled: DataFrame, fit_rows: int, each: int) -> DataFrame:
    """Of every language its share of about ``fit_rows`` rows, but about ``each`` at least, or all it has.

    Drawn by a hash of id and text, whatever the partitioning; rows alike in
    both count once.
    """
    keyed = labelled.withColumn("key", F.xxhash64("doc_id", "text", F.lit("sample")))
    found = keyed.select("lang", "key").distinct().groupBy("lang").count().collect()
    total = sum(r["count"] for r in found)
    cells = 1 << 30
    wanted = [(r["lang"], cells if r["count"] <= (most := max(each, fit_rows * r["count"] / total))
               else int(cells * most / r["count"])) for r in found]
    limits = labelled.sparkSession.createDataFrame(wanted, "lang string, cells long")
    return (keyed.join(F.broadcast(limits), "lang").where(F.pmod("key", F.lit(cells)) < F.col("cells"))
            .dropDuplicates(["lang", "key"]))


def fit_language_model(docs: DataFrame, fit_rows: int = FIT_ROWS, learn: Column | None = None,
                       each: int = FIT_EACH) -> LanguageModel:
    """Fit on the labelled rows of ``docs`` (doc_id, text, lang) for which ``learn`` holds."""
    labelled = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.where(~held_out(F.col("doc_id")) if learn is None else learn)
    got = sample_of_each(labelled, fit_rows, each).select("doc_id", "text", "lang").toPandas()
    got = got.sort_values(["doc_id", "lang", "text"], kind="stable")
    return fit(got["text"].tolist(), got["lang"].tolist(), *document_counts(labelled))


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    def run(batches):
        for part in slices(batches, "text"):
            langs, scores = model.predict(part.column(2))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    source = pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on ``docs``' own labels outside the held-out fold, then judge every row."""
    return predict_languages(docs, fit_language_model(docs, fit_rows))


def keep_identified(docs: DataFrame, fit_rows: int = FIT_ROWS, reject_fit: float = REJECT_FIT) -> DataFrame:
    """``docs``, all columns, without the rows whose language stays open
    (``und``, or a fit under ``reject_fit``)."""
    model = fit_language_model(docs, fit_rows)
    flat, _ = positional(docs)
    text = docs.columns.index("text")

    def run(batches):
        for part in slices(batches, f"c{text}"):
            langs, _, fits = model.judge(part.column(text))
            yield part.filter(pa.array([lang != "und" and fit >= reject_fit for lang, fit in zip(langs, fits)], pa.bool_()))

    return restored(flat.mapInArrow(run, flat.schema), docs.columns)
