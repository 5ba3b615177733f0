"""Numpy views of batches of texts: words, word hashes, shingle hashes.

Works on the UTF-8 bytes of an Arrow column, whole texts, no Python strings.
Hashes are 64 bits and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 512_000   # a batch's arrays take some 50 times as much


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``most`` bytes of text (one row at least)."""
    for batch in batches:
        at_column = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at_column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()   # workers outlive their tasks


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row (one more than rows); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# One pseudorandom number for every byte at each of 64 places of a word.
_PLACES = mix64(np.arange(64 * 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


class Words:
    """The words (runs of bytes other than space, tab to carriage return) of a batch of texts.

    ``start``/``end``: byte spans; ``first``: index of each row's first word
    (one more than rows); ``hash``: of the word, A-Z as a-z if ``lower``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        n = len(data)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        word = ~blank
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        starts = word.copy()
        starts[1:] &= blank[:-1] | edge[1:n]
        ends = word.copy()
        ends[:-1] &= blank[1:] | edge[1:n]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data) if lower else data
        at = np.flatnonzero(word)
        lengths = self.end - self.start
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(len(at)) - np.repeat(begin, lengths)
        value = _PLACES[(place & 63) * 256 + low[at]]
        if lengths.max() > 64:
            value = value * ((place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        self.hash = mix64(np.add.reduceat(value, begin) + lengths.astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``k`` words, sorted, distinct within a row.

    A row with fewer words, but one at least, has its whole sequence as one.
    """
    rows = len(words.first) - 1
    counts = words.counts
    row = np.repeat(np.arange(rows), counts)
    n = len(row)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = np.repeat(words.first[1:], counts) - np.arange(n)  # words from here to the row's end
    length = np.minimum(k, counts)[row]
    full = left >= length
    full &= (left >= k) | (np.arange(n) == words.first[:-1][row])
    at = np.flatnonzero(full)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = length[at] > j
        step = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words.hash[np.minimum(at + j, n - 1)] + np.uint64(j + 1))
        h = np.where(inside, step, h)
    r = row[at]
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]
