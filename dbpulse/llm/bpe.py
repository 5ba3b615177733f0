"""BPE encoding and decoding by a pair occurrence index.

The vocabulary file (a public one, named by path) gives merges and ids. A
batch's different words lie one after the other in one array of symbols. An
index maps every adjacent pair that some merge joins to all positions where it
occurs; the ranks that occur are taken in ascending order, each rank's pairs
are merged at all its positions at once, and the lists of the pairs that this
makes and unmakes are updated. Every merge makes a symbol of its own, and
merges that use it rank behind, so one ascending pass equals the greedy
lowest-rank-first rule for each word.

Texts are split as the vocabulary's own settings say: special tokens are cut
out of the raw text first, then NFC, white space to one space, lower case,
then contractions, runs of letters, single digits, and runs of anything else;
white space goes. Words repeat, so each worker keeps the words already encoded
in two bounded tables: a word met again moves from the older to the younger,
the others go when the younger one is full and takes the older one's place.

Defined cases: a null text counts as empty and gives no ids; code points that
Python's Unicode tables do not know yet are split as the regex module's newer
tables say; texts of any length are encoded whole; ids and the decoded text are returned, or digests.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dbpulse.llm.common import pick
from dbpulse.llm.textkit import slices

CACHE_WORDS = 70_000       # words in a worker's younger table; beyond, it becomes the older one
BATCH_CHARS = 1_500_000    # characters of text whose new words are encoded together

# The vocabulary's word pattern, white space and word end.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SPACE = regex.compile(r"\p{White_Space}+")
# Code points that str.split() takes for blanks and the vocabulary does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: itself if printable, else from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Ids, merges as arrays, and the special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.final = np.array([ids[c + WORD_END] for c in letters], np.int64)
        self.size = max(self.tokens) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.joined = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = self.left * self.size + self.right
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]
        self.specials = (regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
                         if self.special else None)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge that joins each pair; -1 where none does."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self._keys, want), len(self._keys) - 1)
        return np.where(self._keys[at] == want, self._order[at], -1)


def by_rank(ranks: np.ndarray, at: np.ndarray, index: dict, active: list) -> None:
    """Add positions to the index; a rank that is new becomes active."""
    if not len(ranks):
        return
    order = np.argsort(ranks, kind="stable")
    ranks, at = ranks[order], at[order]
    edges = np.flatnonzero(np.diff(ranks)) + 1
    starts = [0, *edges.tolist()]
    for s, e in zip(starts, [*starts[1:], len(ranks)]):
        r = int(ranks[s])
        if r in index:
            index[r].append(at[s:e])
        else:
            index[r] = [at[s:e]]
            heapq.heappush(active, r)


def encode_words(words: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """The ids of each word (its UTF-8 bytes), all words in one index."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    n = len(flat)
    if not n:
        return [[] for _ in words]
    ends = np.cumsum(sizes)
    sym = vocab.inner[flat]
    last = ends[sizes > 0] - 1
    sym[last] = vocab.final[flat[last]]
    follow = np.arange(1, n + 1, dtype=np.int64)
    follow[last] = -1
    before = np.arange(-1, n - 1, dtype=np.int64)
    first = (ends - sizes)[sizes > 0]
    before[first] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []
    at = np.flatnonzero(follow >= 0)
    ranks = vocab.rank(sym[at], sym[at + 1])
    by_rank(ranks[ranks >= 0], at[ranks >= 0], index, active)
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        a, b, c = int(vocab.left[r]), int(vocab.right[r]), int(vocab.joined[r])
        p = lists[0] if len(lists) == 1 else np.concatenate(lists)
        nxt = follow[p]
        # a listed position may have changed since: keep those that still hold the pair
        ok = (sym[p] == a) & (nxt >= 0)
        ok &= sym[nxt] == b
        p = p[ok]
        if not len(p):
            continue
        p = np.unique(p)
        if a == b:  # a run of one symbol is joined from its left, every second position
            nxt = follow[p]
            chained = np.zeros(len(p), bool)
            chained[1:] = nxt[:-1] == p[1:]
            idx = np.arange(len(p))
            start = np.maximum.accumulate(np.where(chained, 0, idx))
            p = p[(idx - start) % 2 == 0]
        nxt = follow[p]
        after = follow[nxt]
        sym[p], sym[nxt], follow[p] = c, -1, after
        has = after >= 0
        before[after[has]] = p[has]
        left = p[before[p] >= 0]
        pairs_at = np.concatenate([before[left], p[has]])
        if len(pairs_at):
            ranks = vocab.rank(sym[pairs_at], sym[follow[pairs_at]])
            good = ranks >= 0
            by_rank(ranks[good], pairs_at[good], index, active)
    alive = sym >= 0
    ids = sym[alive].tolist()
    cuts = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])].tolist()
    return [ids[s:e] for s, e in zip(cuts[:-1], cuts[1:])]


class Encoder:
    """Texts to words to ids, with two bounded tables of encoded chunks."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.ids: dict[str, str] = {}       # chunk to its ids, joined by a space
        self.decoded: dict[str, str] = {}   # chunk to its tokens, joined by a space
        self.older: tuple[dict[str, str], dict[str, str]] = {}, {}   # the same of earlier texts
        self.name = [str(i) for i in range(vocab.size)]
        self.token = [vocab.tokens.get(i, "") for i in range(vocab.size)]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The blank-separated chunks of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # each character by itself, without the word-end rule
                text = text.replace("Σ", "σ")
        text = text.lower()
        if SEPARATORS.search(text):
            return [c for c in SPACE.split(text) if c]
        return text.split()

    def pieces(self, text: str | None) -> list[str]:
        """Chunks and special tokens (marked by a leading blank), in order."""
        if not text:
            return []
        specials = self.vocab.specials
        if specials is None or not any(t in text for t in self.vocab.special):
            return self.chunks(text)
        out, at = [], 0
        for m in specials.finditer(text):
            out += self.chunks(text[at:m.start()])
            out.append(" " + m[0])
            at = m.end()
        return out + self.chunks(text[at:])

    def _table(self, wanted: set[str]) -> None:
        """Have every wanted chunk in the younger table."""
        if len(self.ids) > CACHE_WORDS:
            self.older = self.ids, self.decoded
            self.ids, self.decoded = {}, {}
        new = wanted.difference(self.ids)
        ids, decoded = self.older
        for c in new.intersection(ids):
            self.ids[c], self.decoded[c] = ids.pop(c), decoded.pop(c)
        self._add(new.difference(self.ids))

    def _add(self, new: set[str]) -> None:
        words = {c: WORD.findall(c) for c in new if c[0] != " "}
        different = list(set().union(*words.values()))
        ids = dict(zip(different, encode_words([w.encode() for w in different], self.vocab)))
        name, token = self.name.__getitem__, self.token.__getitem__
        for c in new:
            if c[0] == " ":
                own = [self.vocab.special[c[1:]]]
            else:
                ws = words[c]
                own = ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]]
            self.ids[c] = " ".join(map(name, own))
            self.decoded[c] = " ".join(map(token, own))

    def forget(self) -> None:
        """Empty the tables; workers outlive their tasks and serve other operators, too."""
        self.ids, self.decoded, self.older = {}, {}, ({}, {})

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by a space, decoded text) of each text.

        Every chunk holds a character that is no blank, and so has an id.
        """
        at = 0
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and (not group or chars < BATCH_CHARS):
                chars += len(texts[at] or "")
                group.append(self.pieces(texts[at]))
                at += 1
            self._table(set().union(*group))
            for p in group:
                ids = " ".join(map(self.ids.__getitem__, p))
                yield ids.count(" ") + (ids != ""), ids, " ".join(map(self.decoded.__getitem__, p))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(Vocabulary(path))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, digests: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens and either digests of ids and
    decoded text (ids_sha256, decoded_sha256) or both whole (ids, decoded)."""
    path = path or word_bpe_path()
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]

    def run(batches):
        enc = encoder(path)
        for part in slices(batches, "text", BATCH_CHARS):
            counts, ids, decoded = zip(*enc.encode(part.column(1).to_pylist()))
            if digests:
                ids, decoded = ([hashlib.sha256(x.encode()).hexdigest() for x in col] for col in (ids, decoded))
                ids = pa.array(ids, pa.string())
            else:
                numbers = np.fromstring(" ".join(x for x in ids if x), np.int32, sep=" ")
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                               pa.array(numbers, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), ids, pa.array(decoded, pa.string())], names=names)
        enc.forget()

    source = pick(docs, "doc_id", "text")
    id_type = source.schema["doc_id"].dataType.simpleString()
    kind = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return source.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, {kind}")
