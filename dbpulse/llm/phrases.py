"""Phrase collocations by prefix-free parsing.

Texts are cut into pieces at punctuation and line ends, pieces into words. A
text's words are parsed into chunks: a word whose hash is 0 modulo ``TRIGGER``
ends one (after ``LONGEST`` words without such a word the chunk ends anyway),
so equal passages give equal chunks wherever they stand. A chunk is written with up to
``most - 1`` words that follow it in its piece: chunks overlap, and every phrase
of up to ``most`` words begins in exactly one of them. The dictionary holds
each distinct chunk of a language with its number of occurrences; phrases are
counted inside the distinct chunks only, weighted by that number, and a phrase
that begins in the overlap is left to the chunk that begins there.

Words and pairs are counted first, by 64-bit hashes: equal phrases have equal
hashes, so a hash has ``least`` occurrences if one of its phrases has. A longer
phrase can occur ``least`` times only if all its pairs do. A Bloom filter of
the frequent hashes (of bounded size; what it lets through wrongly is counted
and dropped like all else) says which words, pairs and longer phrases of a
chunk are worth counting as texts, and only these counts are used.

A candidate is a phrase of 2 to ``most`` words with ``least`` occurrences. Its
score is the least, over its cuts in two, of floor(scale * a / (l + r)) in
decimals; candidates that a longer one mostly accounts for are dropped.

Defined cases: a null text counts as empty and has no words; a null language
is ``und``; repeated rows count as often as they stand; words and texts of any
length are taken whole; ties in the score go to the larger a, then to the
phrase that is smaller in UTF-8 bytes; a language without candidates has no
rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dbpulse.llm.common import cut, drop_cut, pick
from dbpulse.llm.textkit import _PLACES, mix64, slices, utf8

MOST = 4             # words of a phrase, at most
LEAST = 30           # occurrences of a candidate, at least
TOP = 2000           # rows of each language
SCALE = 2_000_000
COVERED = 80         # percent of a phrase's occurrences that a longer one may account for
TRIGGER = 16         # one word in so many ends a chunk
LONGEST = 64         # words of a chunk, without its overlap
FILTER_BITS = (1 << 16, 1 << 27)   # the least and the largest filter of words and pairs
BATCH_BYTES = 1_000_000
HELD_HASHES = 1 << 21   # hashes that a task holds before it adds them up, at least

# Byte kinds: 0 a word's, 1 a blank, 2 the end of a piece, 3 the start of a chunk's overlap.
_BLANK, _END, _OVERLAP = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = _END
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# A written chunk: before each word one of these. None of them is in a word.
_WRITTEN = {" ": _BLANK, "\n": _END, "\v": _OVERLAP}
_CHUNK_KIND = np.zeros(256, np.uint8)
for _c, _k in _WRITTEN.items():
    _CHUNK_KIND[ord(_c)] = _k


class Spans:
    """The words of a batch of texts: byte spans, row, hash, and the strongest sign before each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray):
        n, rows = len(data), len(offsets) - 1
        kind = kinds[data]
        word = kind == 0
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~word[:-1]
        self.start = np.flatnonzero(word & (before | edge[:n]))
        after = np.ones(n, bool)
        after[:-1] = ~word[1:]
        self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        m = len(self.start)
        self.sign = np.zeros(m, np.uint8)
        self.hash = np.zeros(m, np.uint64)
        if not m:
            return
        # the largest kind among the bytes between the last word's end and this one's start
        head = np.concatenate([[0], self.end[:-1]])
        spans = np.maximum.reduceat(np.append(kind, 0), np.stack([head, self.start], 1).ravel())[::2]
        self.sign = np.where(head < self.start, spans, 0).astype(np.uint8)
        at = np.flatnonzero(word)
        lengths = self.end - self.start
        begin = np.cumsum(lengths) - lengths
        place = np.arange(len(at)) - np.repeat(begin, lengths)
        value = _PLACES[(place & 63) * 256 + data[at]]
        if lengths.max() > 64:
            value = value * ((place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        self.hash = mix64(np.add.reduceat(value, begin) + lengths.astype(np.uint64))

    def left_in_piece(self) -> np.ndarray:
        """For each word: the words after it in its piece."""
        m = len(self.start)
        new = np.ones(m, bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | (self.sign[1:] == _END)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], m)
        return np.repeat(ends, ends - starts) - np.arange(m) - 1


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all spans one after the other, where each begins)."""
    begin = np.cumsum(size) - size
    return data[np.repeat(start - begin, size) + np.arange(size.sum())], begin


def _strings(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    offsets = np.append(begin, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def chunks(texts: pa.Array, overlap: int = MOST - 1, trigger: int = TRIGGER,
           longest: int = LONGEST) -> tuple[np.ndarray, pa.Array]:
    """(row, chunk) of the parse of every text."""
    raw, offsets = utf8(texts)
    data = _LOWER[raw]
    words = Spans(data, offsets, _KIND)
    m = len(words.start)
    if not m:
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    at = np.arange(m)
    row_end = np.zeros(m, bool)
    row_end[words.first[1:][np.diff(words.first) > 0] - 1] = True
    ends = (words.hash % np.uint64(trigger) == 0) | row_end
    # words since the last end; every longest-th ends a chunk, too
    last = np.maximum.accumulate(np.where(np.concatenate([[True], ends[:-1]]), at, 0))
    ends |= (at - last + 1) % longest == 0
    stop = np.flatnonzero(ends)
    start = np.concatenate([[0], stop[:-1] + 1])
    more = np.minimum(words.left_in_piece()[stop], overlap)
    sizes = stop - start + 1 + more
    head = np.cumsum(sizes) - sizes
    inside = np.arange(sizes.sum()) - np.repeat(head, sizes)
    word = np.repeat(start, sizes) + inside
    sign = np.where(words.sign[word] == _END, ord("\n"), ord(" "))
    sign[inside == 0] = ord("\n")
    sign[inside == np.repeat(stop - start + 1, sizes)] = ord("\v")
    size = words.end[word] - words.start[word] + 1
    # each word with the byte before it; that byte (of a row's first word: any) becomes the sign
    out, begin = _gathered(np.concatenate([[np.uint8(0)], data]), words.start[word], size)
    out[begin] = sign
    return words.row[start], _strings(out, begin[head])


def _own(words: Spans) -> np.ndarray:
    """For each word of a batch of chunks: whether it stands before its chunk's overlap."""
    since = np.cumsum(words.sign == _OVERLAP)
    return since <= np.concatenate([[0], since])[words.first[:-1]][words.row]


def phrases(chunk: pa.Array, sizes: range, passes: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
            ) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row, phrase) of every phrase that begins in a chunk before its overlap, by number of words.

    ``passes(row, hash)`` says of each word whether it may be a phrase, and of
    each adjacent pair whether phrases may hold it.
    """
    data, offsets = utf8(chunk)
    words = Spans(data, offsets, _CHUNK_KIND)
    m = len(words.start)
    own = np.zeros(m, bool)
    if m:
        own = _own(words)
        left = words.left_in_piece()
        data = np.where((data == ord("\v")) | (data == ord("\n")), np.uint8(32), data)
        pair = np.zeros(m, bool)
        if passes is not None:
            inside = np.flatnonzero(left > 0)
            pair[inside] = passes(words.row[inside], pair_hash(words.hash[inside], words.hash[inside + 1]))
    for n in sizes:
        ok = own.copy()
        if m:
            ok &= left >= n - 1
            if passes is not None and n == 1:
                ok &= passes(words.row, words.hash)
            elif passes is not None:
                for j in range(n - 1):
                    ok[:m - j] &= pair[j:]
        at = np.flatnonzero(ok)
        start = words.start[at]
        out, begin = _gathered(data, start, words.end[np.minimum(at + n - 1, m - 1)] - start if m else start)
        yield words.row[at], _strings(out, begin)


def short_hashes(chunk: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words and pairs that begin in a chunk before its overlap."""
    words = Spans(*utf8(chunk), _CHUNK_KIND)
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = _own(words)
    at = np.flatnonzero(own & (words.left_in_piece() > 0))
    return (np.concatenate([words.row[own], words.row[at]]),
            np.concatenate([words.hash[own], pair_hash(words.hash[at], words.hash[at + 1])]))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _lang_hash(langs: pa.Array) -> np.ndarray:
    data, offsets = utf8(langs)
    sizes = np.diff(offsets)
    value = np.zeros(len(sizes), np.uint64)
    if len(data):
        place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
        np.add.at(value, np.repeat(np.arange(len(sizes)), sizes), _PLACES[(place & 63) * 256 + data])
    return mix64(value + sizes.astype(np.uint64))


def filter_places(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of a hash in the filter, bits a power of two."""
    mask = np.uint64(bits - 1)
    return [(key & mask).astype(np.int64), (key >> np.uint64(32) & mask).astype(np.int64)]


def segments(text: pa.Array, most: int) -> Iterator[pa.Array]:
    """One long text in parts of about ``most`` bytes that end where a piece ends."""
    data, offsets = utf8(text)
    at, size = 0, len(data)
    while size - at > most:
        ends = np.flatnonzero(_KIND[data[at:at + most]] == _END)
        if len(ends):
            stop = at + int(ends[-1]) + 1
        else:
            later = np.flatnonzero(_KIND[data[at + most:]] == _END)
            if not len(later):
                break
            stop = at + most + int(later[0]) + 1
        yield _strings(data[at:stop], np.zeros(1, np.int64))
        at = stop
    yield _strings(data[at:], np.zeros(1, np.int64))


def parse(docs: DataFrame, overlap: int = MOST - 1) -> DataFrame:
    """(lang, chunk, n): the dictionary of distinct chunks with their occurrences."""
    def run(batches):
        for part in slices(batches, "text", BATCH_BYTES):
            for texts in segments(part.column(1), BATCH_BYTES) if part.num_rows == 1 else [part.column(1)]:
                row, chunk = chunks(texts, overlap)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), chunk.cast(pa.string())],
                                                 names=["lang", "chunk"])

    source = pick(docs, "text", "lang").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                                               F.col("text").cast("string").alias("text"))
    return (source.mapInArrow(run, "lang string, chunk string")
            .groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("n")))


def _added_up(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    got = pa.table({"key": key.view(np.int64), "n": n}).group_by("key", use_threads=False).aggregate([("n", "sum")])
    return pa.RecordBatch.from_arrays([got.column("key").combine_chunks(), got.column("n_sum").combine_chunks()],
                                      names=["key", "n"])


def frequent_hashes(dictionary: DataFrame, least: int) -> DataFrame:
    """(key): the hashes of words and pairs of a language with ``least`` occurrences."""
    def run(batches):
        keys, counts, held = [], [], 0
        for part in slices(batches, "chunk", BATCH_BYTES):
            row, value = short_hashes(part.column(1))
            keys.append(mix64(value ^ _lang_hash(part.column(0))[row]))
            counts.append(part.column(2).to_numpy(zero_copy_only=False)[row])
            held += len(row)
            if held >= HELD_HASHES:
                yield _added_up(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [], [], 0
        if held:
            yield _added_up(np.concatenate(keys), np.concatenate(counts))
        pa.default_memory_pool().release_unused()

    return (dictionary.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least).select("key"))


def count_phrases(dictionary: DataFrame, sizes: range, least: int, frequent: np.ndarray) -> DataFrame:
    """(lang, words, phrase, f) of the phrases with ``least`` occurrences; ``frequent``: a filter of words and pairs."""
    bits = len(frequent) * 8

    def run(batches):
        for part in slices(batches, "chunk", BATCH_BYTES):
            langs, weight = part.column(0), part.column(2)
            own = _lang_hash(langs)

            def passes(row, value):
                return np.logical_and.reduce([frequent[p >> 3] >> (p & 7).astype(np.uint8) & 1 > 0
                                              for p in filter_places(mix64(value ^ own[row]), bits)])
            code = langs.dictionary_encode()
            for n, (row, phrase) in zip(sizes, phrases(part.column(1), sizes, passes)):
                row = pa.array(row)
                got = pa.table({"l": code.indices.take(row), "phrase": phrase, "f": weight.take(row)})
                got = got.group_by(["l", "phrase"], use_threads=False).aggregate([("f", "sum")]).combine_chunks()
                for b in got.to_batches():
                    yield pa.RecordBatch.from_arrays(
                        [code.dictionary.take(b.column("l")), pa.array(np.full(b.num_rows, n, np.int32)),
                         b.column("phrase").cast(pa.string()), b.column("f_sum").cast(pa.int64())],
                        names=["lang", "words", "phrase", "f"])

    counted = (dictionary.mapInArrow(run, "lang string, words int, phrase string, f long")
               .groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")))
    return counted.where(F.col("f") >= least)


def word_totals(dictionary: DataFrame) -> DataFrame:
    """(lang, n): all occurrences of words; each word of a chunk has one sign before it."""
    own = F.substring_index("chunk", "\v", 1)
    words = (F.length(own) - F.length(F.translate(own, " \n", ""))).cast("long")
    return dictionary.groupBy("lang").agg(F.sum(words * F.col("n")).alias("n"))


def hash_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of hashes (key), at most ``FILTER_BITS[1]`` bits, as bytes."""
    bits = FILTER_BITS[0]
    while bits < min(16 * keys.count(), FILTER_BITS[1]):
        bits *= 2

    def run(batches):
        for batch in batches:
            place = np.concatenate(filter_places(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place >> 5), pa.array(np.int64(1) << (place & 31))], names=["at", "bit"])

    got = (keys.mapInArrow(run, "at long, bit long")
           .groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas())
    out = np.zeros(bits // 32, np.uint32)
    out[got["at"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def _words(phrase: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def scored(counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of the candidates: their lowest-scoring cuts."""
    own = counts.where(F.col("words") >= 2).withColumnRenamed("f", "a")
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = cuts.select(
        "lang", "words", "phrase", "a", "k",
        F.explode(F.array(F.struct(F.lit("l").alias("side"), _words("phrase", 1, F.col("k")).alias("part")),
                          F.struct(F.lit("r").alias("side"),
                                   _words("phrase", F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))).alias("p"))
    sides = sides.select("lang", "words", "phrase", "a", "k", F.col("p.side").alias("side"), F.col("p.part").alias("part"))
    there = counts.select(F.col("lang").alias("lang_"), F.col("phrase").alias("part_"), F.col("f").alias("f_"))
    met = sides.join(there, (F.col("lang") == F.col("lang_")) & (F.col("part") == F.col("part_")))
    both = met.groupBy("lang", "words", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("f_"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f_"))).alias("r"))
    value = F.expr(f"(CAST(a AS DECIMAL(28,0)) * {scale}) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    cut_ = F.struct(value.cast("long").alias("score"), "k", "l", "r")
    return (both.groupBy("lang", "words", "phrase", "a").agg(F.min(cut_).alias("c"))
            .select("lang", "words", "phrase", "a", "c.l", "c.r", "c.score"))


def largest_holders(counts: DataFrame) -> DataFrame:
    """(lang, phrase, holder): for phrases inside longer candidates, the longer ones' largest count."""
    longer = counts.where(F.col("words") >= 3)
    spans = longer.select("lang", "phrase", "f", "words",
                          F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    parts = spans.select("lang", "f", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("words") - F.col("size") + 1),
        lambda i: _words(F.col("phrase"), i, F.col("size")))).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("holder"))


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, top: int = TOP, scale: int = SCALE,
                 covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` collocations."""
    dictionary = cut(parse(docs, most - 1))
    totals = cut(word_totals(dictionary))
    keys = cut(frequent_hashes(dictionary, least))
    counts = cut(count_phrases(dictionary, range(1, most + 1), least, hash_filter(keys)))
    held = largest_holders(counts).select(F.col("lang").alias("lang_"), F.col("phrase").alias("phrase_"), "holder")
    left = (scored(counts, scale)
            .join(held, (F.col("lang") == F.col("lang_")) & (F.col("phrase") == F.col("phrase_")), "left")
            .where(F.coalesce(F.col("holder").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered,
                              F.lit(True))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = (left.drop("lang_").withColumn("rank", F.row_number().over(order).cast("long"))
            .where(F.col("rank") <= top))
    out = cut(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    for table in (dictionary, totals, keys, counts):
        drop_cut(table)
    return out
