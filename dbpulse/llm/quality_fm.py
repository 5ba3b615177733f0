"""Quality classifier: a factorisation machine.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the
pair sum is half of sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2], linear in
the features that a text has. The features x:

- hashed words (A-Z as a-z): the square root of a word's share of the text's
  words, for the distinct words of the whole text;
- structure: shares of capitals, digits, symbols, blanks, line ends and
  non-ASCII bytes, the share of words that repeat the word before, the share
  of distinct words, mean word length, share of one-character words and of
  words with a symbol run at their end, words a line (log), all scaled to
  about 0..1;
- metadata: log of the length that the table states (n_chars) and whether it
  states one. Labels, lang, source and doc_id are no features.

Learnt with adaptive gradient steps on a sample of at most about ``fit_rows``
labelled rows, drawn by a hash of the id. The features are made in Spark
tasks, those of the bounded sample are gathered and fitted once; every row is
then scored, whole, in batches.

Defined cases: a null text is an empty text and is scored from the other
features; a null or missing n_chars has its own feature; without labelled
rows, or with one label only, the score is the smoothed share of label 1;
documents without a label are scored but not learnt from; repeated rows score
alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dbpulse.llm.common import bounded_sample, pick
from dbpulse.llm.textkit import Words, slices, utf8

BITS = 15
RANK = 6
FIT_ROWS = 8000      # bound of the fitting sample
CUTOFF = 0.3
STRUCTURE = 14       # structure features, then 2 of metadata
SIZE = (1 << BITS) + STRUCTURE + 2


def _share(mask: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each row the number of true bytes, divided by ``of`` (at least 1)."""
    run = np.concatenate([[0], np.cumsum(mask)])
    return (run[offsets[1:]] - run[offsets[:-1]]) / np.maximum(of, 1)


def _per_word(values: np.ndarray, words: Words) -> np.ndarray:
    run = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (run[words.first[1:]] - run[words.first[:-1]]) / np.maximum(words.counts, 1)


def features(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of every feature that is not 0, by row."""
    data, offsets = utf8(texts)
    rows = len(offsets) - 1
    words = Words(data, offsets)
    counts = words.counts
    row = np.repeat(np.arange(rows), counts)
    bucket = (words.hash >> np.uint64(64 - BITS)).astype(np.int64)
    key, n = np.unique((row << BITS) + bucket, return_counts=True)
    word_row, word_feature = key >> BITS, key & ((1 << BITS) - 1)
    word_value = np.sqrt(n / np.maximum(counts[word_row], 1))
    size = np.diff(offsets)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = ((data > 32) & (data < 127)) & ~upper & ~digit & ~((data >= 97) & (data <= 122))
    lines = _share(data == 10, offsets, np.ones(rows))
    length = words.end - words.start
    again = np.zeros(len(row))
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    tail = np.zeros(len(row))
    if len(row):
        last, before = data[words.end - 1], data[np.maximum(words.end - 2, words.start)]
        tail = (symbol[words.end - 1] & (last == before) & (length > 2)).astype(float)
    only_symbols = (length == 1) & (symbol[words.start] if len(row) else False)
    distinct = np.bincount(word_row, minlength=rows) / np.maximum(counts, 1)
    some = (size > 0).astype(float)
    structure = np.stack([
        _share(upper, offsets, size), _share(digit, offsets, size) * 4, _share(symbol, offsets, size) * 2,
        _share(blank, offsets, size), np.minimum(lines / np.maximum(counts, 1) * 10, 2), _share(data >= 128, offsets, size),
        _per_word(again, words), distinct * some, np.minimum(_per_word(length, words) / 10, 2),
        _per_word(only_symbols, words) * 2, _per_word(tail, words),
        np.minimum(np.log1p(counts / (lines + 1)) / 5, 2), np.log1p(size) / 12, np.minimum(np.log1p(counts) / 10, 2),
    ], 1)
    stated = n_chars.to_numpy(zero_copy_only=False).astype(np.float64)
    known = np.isfinite(stated)
    meta = np.stack([np.where(known, np.log1p(np.maximum(np.nan_to_num(stated), 0)) / 12, 0.0), (~known).astype(float)], 1)
    dense = np.concatenate([structure, meta], 1)
    r, c = np.nonzero(dense)
    return (np.concatenate([word_row, r]), np.concatenate([word_feature, c + (1 << BITS)]),
            np.concatenate([word_value, dense[r, c]]))


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray   # by feature
    v: np.ndarray   # by feature and factor

    def score(self, rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        total = self.w0 + np.bincount(row, weights=self.w[feature] * value, minlength=rows)
        for f in range(self.v.shape[1]):
            part = self.v[feature, f] * value
            total += 0.5 * (np.bincount(row, weights=part, minlength=rows) ** 2
                            - np.bincount(row, weights=part * part, minlength=rows))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, epochs=12, batch=64, rate=0.1,
        l2=1e-5, seed=3) -> FactorisationMachine:
    """Adagrad on the log loss over mini-batches of rows; ``row`` numbers the labels ``y``."""
    rng = np.random.default_rng(seed)
    share = (y.sum() + 1) / (len(y) + 2)
    machine = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(SIZE), np.zeros((SIZE, RANK)))
    if len(set(y.tolist())) < 2:
        return machine
    machine.v = rng.normal(0, 0.05, (SIZE, RANK))
    order = np.argsort(row, kind="stable")
    row, feature, value = row[order], feature[order], value[order]
    first = np.searchsorted(row, np.arange(len(y) + 1))
    gw, gv, g0 = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3), 1e-3
    for _ in range(epochs):
        turn = rng.permutation(len(y))
        for s in range(0, len(turn), batch):
            own = turn[s:s + batch]
            sizes = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            r, f, x = np.repeat(np.arange(len(own)), sizes), feature[at], value[at]
            error = (machine.score(len(own), r, f, x) - y[own]) / len(own)
            vx = machine.v[f] * x[:, None]
            sums = np.zeros((len(own), RANK))
            np.add.at(sums, r, vx)
            used, back = np.unique(f, return_inverse=True)
            dw = np.bincount(back, weights=error[r] * x) + l2 * machine.w[used]
            dv = np.zeros((len(used), RANK))
            np.add.at(dv, back, (error[r] * x)[:, None] * (sums[r] - vx))
            dv += l2 * machine.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            d0 = error.sum()
            g0 += d0 * d0
            machine.w[used] -= rate * dw / np.sqrt(gw[used])
            machine.v[used] -= rate * dv / np.sqrt(gv[used])
            machine.w0 -= rate * d0 / np.sqrt(g0)
    machine.w, machine.v = machine.w.astype(np.float32), machine.v.astype(np.float32)
    return machine


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars (null where the table has none)."""
    if "n_chars" in docs.columns:
        return pick(docs, "doc_id", "text", "n_chars").withColumn("n_chars", F.col("n_chars").cast("double"))
    return pick(docs, "doc_id", "text").withColumn("n_chars", F.lit(None).cast("double"))


def fit_quality_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> FactorisationMachine:
    """Fit on labelled documents outside the held-out fold."""
    known = pick(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1)).where(~held_out(F.col("doc_id")))
    small = bounded_sample(known.groupBy("doc_id").agg(F.max("quality").alias("quality")), F.col("doc_id"), fit_rows)
    # a repeated id brings its texts; the smallest hashes of id and text keep the bound whatever repeats
    joined = inputs(docs).join(small, "doc_id").withColumn("key", F.xxhash64("doc_id", "text", F.lit("fit")))
    rows = joined.dropDuplicates(["doc_id", "key"]).orderBy("key", "doc_id").limit(fit_rows + fit_rows // 4).drop("key")

    def run(batches):
        for part in slices(batches, "text"):
            r, f, x = features(part.column(1), part.column(2))
            order = np.argsort(r, kind="stable")
            ends = np.cumsum(np.bincount(r, minlength=part.num_rows))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(3),
                 pa.ListArray.from_arrays(offsets, pa.array(f[order], pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.float32()))],
                names=["doc_id", "quality", "features", "shares"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = (rows.select("doc_id", "text", "n_chars", F.col("quality").cast("int").alias("quality"))
            .mapInArrow(run, f"doc_id {id_type}, quality int, features array<int>, shares array<float>"))
    got = made.toArrow().sort_by("doc_id")  # bounded: about fit_rows rows
    y = got.column("quality").to_numpy().astype(np.int64)
    lists = got.column("features").combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    return fit(np.repeat(np.arange(len(y)), sizes), lists.flatten().to_numpy().astype(np.int64),
               got.column("shares").combine_chunks().flatten().to_numpy().astype(np.float64), y)


def score_quality(docs: DataFrame, model: FactorisationMachine, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    def run(batches):
        for part in slices(batches, "text"):
            score = model.score(part.num_rows, *features(part.column(1), part.column(2)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(3), pa.array(score, pa.float64()),
                 pa.array((score >= cutoff).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    source = inputs(docs).withColumn("held_out", held_out(F.col("doc_id")))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def judge_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    return score_quality(docs, fit_quality_model(docs, labels, fit_rows), cutoff)
