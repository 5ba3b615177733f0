"""Personal data: fixed patterns, and a linear-chain conditional random field.

The base finds e-mail addresses, IP addresses, card and phone numbers by
pattern, leftmost and non-overlapping for each kind; a match that fails its
check (IP parts up to 255, 13 to 19 digits that pass Luhn, 9 to 15 digits) is
dropped and not tried again.

The field adds what the patterns miss. Its tokens are the blank-separated
pieces of the whole text; pieces without a digit or ``@`` can only be outside,
so the chain falls into runs of the other pieces, and a run's best labels do
not depend on any other run. Features are word shapes (letters as x or X,
digits as d with the length of their run), affixes of the shape, counts of
digits, dots and dashes, and the words beside. It is trained by stochastic
gradient on a small labelled table and decoded by Viterbi, all runs of a batch
at once in numpy. A span that it finds stands if it passes the kind's own
check and overlaps no base span.

Positions are code points, ends exclusive.

Defined cases: a null text is an empty text; texts of any length are read
whole, no pattern's time grows with the square of a run; repeated rows give
the same spans; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dbpulse.llm.common import pick
from dbpulse.llm.textkit import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
FEATURE_BITS = 14

# Written so that they match what the plain patterns match, without trying a
# long run of characters again from each of its places.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
# Pieces end at blanks and at signs that stand between things, not inside them.
_BETWEEN = r"\s\[\]{}<>=:;,/|\"'\u201c\u201d"
_PIECE = re.compile(rf"(?<![^{_BETWEEN}])[^{_BETWEEN}0-9@]*+[0-9@][^{_BETWEEN}]*+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _is_card(text: str) -> bool:
    d = digits_of(text)
    return 13 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """By kind, the (start, end) that the patterns find."""
    found: list[list[tuple[int, int]]] = [[], [], [], []]
    if "@" in text:
        stop = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > stop and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found[0].append((start, m.end()))
                stop = m.end()
    if _TRIGGER.search(text):
        found[1] = [m.span() for m in _IP.finditer(text) if _is_ip(m[0])]
        found[2] = [m.span() for m in _CARD.finditer(text) if _is_card(m[0])]
        if "+" in text:
            found[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


@dataclass
class Run:
    """Neighbouring pieces that may be personal data, and the words beside."""

    spans: list[tuple[int, int]]
    texts: list[str]
    before: str
    after: str


_WORD_BEFORE = re.compile(rf"([^{_BETWEEN}]{{1,24}})[{_BETWEEN}(]+$")
_WORD_AFTER = re.compile(rf"[{_BETWEEN})]+([^{_BETWEEN}]{{1,24}})")


def bare(text: str, s: int, e: int) -> tuple[int, int]:
    """text[s:e] without final stops, lone brackets, and brackets around more than an area code."""
    while e - s > 1:
        if text[e - 1] in ".!?":
            e -= 1
        elif text[s] == "(" and (text.find(")", s, e) < 0 or (
                text.find(")", s, e) == e - 1 and len(digits_of(text[s:e])) > 6)):
            s += 1
        elif text[e - 1] == ")" and text.find("(", s, e) < 0:
            e -= 1
        else:
            break
    return s, e


def runs(text: str) -> list[Run]:
    """The runs of pieces with a digit or ``@`` (only blanks between them)."""
    out: list[Run] = []
    last = -1
    for m in _PIECE.finditer(text):
        s, e = bare(text, *m.span())
        if last >= 0 and s - last <= 3 and text[last:s].isspace():
            out[-1].spans.append((s, e))
            out[-1].texts.append(text[s:e])
        else:
            b = _WORD_BEFORE.search(text[max(0, s - 30):s])
            out.append(Run([(s, e)], [text[s:e]], b[1].lower() if b else "", ""))
        last = e
        a = _WORD_AFTER.match(text[e:e + 30])
        out[-1].after = a[1].lower() if a else ""
    return out


def shape(text: str) -> str:
    """Letters as x or X and digits as d, a run of digits with its length, others as they are."""
    out = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() else "x", text)
    return re.sub(r"\d+", lambda m: f"d{min(len(m[0]), 9)}", out)


@functools.lru_cache(maxsize=100_000)
def _own(text: str) -> tuple[str, ...]:
    ends = text if len(text) <= 200 else text[:100] + text[-100:]   # the counts are of the whole piece
    s = shape(ends)
    digits = len(digits_of(text))
    kinds = re.sub(r"[^@.()/:=\-+,\"]", "", ends)[:8]
    core = s.strip(".,;:!?#*$%&|\"'")
    return (f"s={core[:40]}", f"a={core[:4]}", f"z={core[-4:]}", f"d={min(digits, 20)}", f"k={kinds}",
            f"at={text.count('@')}", f"dots={min(text.count('.'), 5)}", f"dash={min(text.count('-'), 5)}",
            f"x={int('x' in core or 'X' in core)}{int('.x' in core)}")


@functools.lru_cache(maxsize=200_000)
def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << FEATURE_BITS) - 1)


def run_features(run: Run) -> list[list[int]]:
    """For each piece of the run the numbers of its features."""
    own = [_own(t) for t in run.texts]
    words = [re.sub(r"\d+", "#", re.sub(r"\W+", "", w))[:12] for w in (run.before, run.after)]
    out = []
    for i, f in enumerate(own):
        left = own[i - 1][0] if i else "w=" + words[0]
        right = own[i + 1][0] if i + 1 < len(own) else "w=" + words[1]
        more = [*f, "<" + left, ">" + right, "b=" + words[0], f"i={min(i, 3)}", "<>" + left[:8] + f[0], "bias"]
        out.append([_number(x) for x in more])
    return out


@dataclass
class Field:
    emit: np.ndarray    # features x labels
    move: np.ndarray    # labels x labels, from and to
    begin: np.ndarray
    end: np.ndarray

    def scores(self, numbers: list[list[int]]) -> np.ndarray:
        return np.stack([self.emit[f].sum(0) for f in numbers])


# An inside label follows only its own kind.
ALLOWED = np.array([[not t.startswith("I-") or f[2:] == t[2:] for t in LABELS] for f in LABELS])
STARTS = np.array([not t.startswith("I-") for t in LABELS])


def viterbi(scores: list[np.ndarray], field: Field) -> list[np.ndarray]:
    """The best labels of every run, all runs at once, longest first."""
    if not scores:
        return []
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    total = np.concatenate([scores[i] for i in order])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    move = np.where(ALLOWED, field.move, -1e9)
    back = np.zeros((len(total), len(LABELS)), np.int8)
    best = total[first] + np.where(STARTS, field.begin, -1e9)
    final = np.empty_like(best)
    final[:] = best
    for t in range(1, int(lengths[0])):
        n = int(np.searchsorted(-lengths, -t, "left"))  # runs longer than t
        step = best[:n, :, None] + move[None]
        at = first[:n] + t
        back[at] = step.argmax(1)
        best = step.max(1) + total[at]
        final[:n] = best
    label = (final + field.end).argmax(1)
    out: list[np.ndarray] = [np.zeros(0)] * len(scores)
    for k, i in enumerate(order):
        path = np.zeros(lengths[k], np.int64)
        now = int(label[k])
        for t in range(int(lengths[k]) - 1, -1, -1):
            path[t] = now
            now = int(back[first[k] + t, now])
        out[i] = path
    return out


def train(table: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, rate: float = 0.3,
          l2: float = 1e-4, seed: int = 11) -> Field:
    """A field from (text, [(kind, start, end)]) rows, by gradient steps on the log likelihood."""
    data = []
    for text, spans in table:
        for run in runs(text):
            y = [0] * len(run.spans)
            for kind, s, e in spans:
                inside = [i for i, (a, b) in enumerate(run.spans) if a < e and b > s]
                for j, i in enumerate(inside):
                    y[i] = LABELS.index(("I-" if j else "B-") + kind)
            data.append((run_features(run), np.array(y)))
    n = len(LABELS)
    field = Field(np.zeros((1 << FEATURE_BITS, n)), np.zeros((n, n)), np.zeros(n), np.zeros(n))
    rng = np.random.default_rng(seed)
    bar, start_bar = np.where(ALLOWED, 0.0, -1e9), np.where(STARTS, 0.0, -1e9)

    def lse(x, axis):
        m = x.max(axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

    for epoch in range(epochs):
        eta = rate / (1 + epoch)
        for i in rng.permutation(len(data)):
            numbers, y = data[i]
            u, m = field.scores(numbers), field.move + bar
            size = len(u)
            fwd, bwd = np.empty((size, n)), np.empty((size, n))
            fwd[0] = u[0] + field.begin + start_bar
            for t in range(1, size):
                fwd[t] = lse(fwd[t - 1][:, None] + m, 0) + u[t]
            bwd[-1] = field.end
            for t in range(size - 2, -1, -1):
                bwd[t] = lse(m + (u[t + 1] + bwd[t + 1])[None], 1)
            z = lse(fwd[-1] + field.end, 0)
            p = np.exp(fwd + bwd - z)
            p[np.arange(size), y] -= 1
            for t in range(size):
                field.emit[numbers[t]] -= eta * (p[t] + l2 * field.emit[numbers[t]])
            for t in range(1, size):
                pair = np.exp(fwd[t - 1][:, None] + m + (u[t] + bwd[t])[None] - z)
                pair[y[t - 1], y[t]] -= 1
                field.move -= eta * pair
            field.begin -= eta * p[0]
            field.end -= eta * p[-1]
    return field


# The labelled table: texts with [kind|text] marks; # stands for a digit, * for
# a word, {card} for a number that passes Luhn.
TEMPLATES = (
    "write to [email|*.*@*.com] today", "mail [email|*_##@mail#.example.org], please", "from: [email|*@*.co.uk]",
    "contact [email|*+*@*.net]; or call", "* und [email|*ö*@*.de] * *", "reach me at [email|*.##@*-*.fr].",
    "call [phone|(###) ###-####] now", "phone [phone|###-###-####] or", "tel. [phone|### ### ####], *",
    "my number is [phone|1 (###) ###-####] *", "fax [phone|###.###.####].", "ring [phone|0## #### ####] after",
    "call [phone|+# (###) ###-####] * *", "tel [phone|+## ### #######]", "* * [phone|+1 (###) ###-####] * *",
    "card [card|{card}] expires", "paid with [card|{card4}] *", "* * [card|{card}] * *", "visa [card|{carddot}] ok",
    "from [ip|1##.##.1#.2##] at", "* * [ip|##.1##.#.##] * *", "host [ip|10.0.#.##], port", "ip: [ip|192.168.#.1##]",
    "version #.#.# of *", "since 19## and 20##", "page ## of ###", "on 20##-0#-1# at 1#:##", "Licensed under * #.#.",
    "token = \"*##*###*\" *", "total ###,###.## euros", "* #### * ## *", "chapter #.## and #.##", "score ##-## in game #",
    "isbn 978-#-##-######-#", "order ########## shipped", "room ### floor ##", "*@* is no address", "@* said ##",
    "id ##### ##### #####", "pi is 3.14159####", "##% of ###", "serial ###-##-####-##", "build ####.##.##.#####",
    "[phone|###-###-####]", "* [phone|###-###-####] *", "* * [phone|### ### ####] *", "* [phone|(###) ###-####]", "* [phone|###.###.####] *",
    "([phone|###-###-####])", "* [email|*é*@*.com] *", "to [email|*.ß*@*-*.org]", "[email|*@*ñ*.com]", "* ([phone|###-###-####]) *",
    "tel:[phone|###-###-####]", "phone=[phone|### ### ####]; *", "(or [phone|###.###.####]).", "[phone|###-###-####],[phone|###-###-####] *",
    "mail:[email|*@*.org]", "user=[email|*.*@*.com]&x", "<[email|*ü*@*.de]>", "ip=[ip|1##.##.1#.2##];", "card:[card|{carddot}]",
    "* (#-##-###) *", "id=##########&n=##", "(see ###-##) *", "at 1#:##:## *", "##/##/19## *", "v=#.#.#;",
    "{\"n\": #######, \"m\": ##}", "size=###x###",
)


def labelled_rows(copies: int = 12, seed: int = 1) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table that the templates give: (text, [(kind, start, end)])."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word() -> str:
        return "".join(letters[i] for i in rng.integers(0, 26, int(rng.integers(2, 9))))

    def card() -> str:
        body = "".join(str(d) for d in [4, *rng.integers(0, 10, 14)])
        return next(body + c for c in "0123456789" if luhn(body + c))

    def fill(text: str) -> str:
        c = card()
        fours = [c[i:i + 4] for i in range(0, 16, 4)]
        text = text.replace("{card4}", " ".join(fours)).replace("{carddot}", ".".join(fours)).replace("{card}", c)
        return "".join(word() if x == "*" else str(rng.integers(0, 10)) if x == "#" else x for x in text)

    rows = []
    for _ in range(copies):
        for template in TEMPLATES:
            text, spans = " ".join(word() for _ in range(int(rng.integers(0, 4)))), []
            text += " " if text else ""
            for part in re.split(r"(\[\w+\|[^\]]*\])", template):
                m = re.fullmatch(r"\[(\w+)\|([^\]]*)\]", part)
                piece = fill(m[2] if m else part)
                if m:
                    spans.append((m[1], len(text), len(text) + len(piece)))
                text += piece
            rows.append((text, spans))
    return rows


@functools.lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_rows())


_TRIM_LEFT, _TRIM_RIGHT = ".,;:!?#*$%&|\"'<>[]{}=", ".,;:!?#*$%&|\"'<>[]{}=("


def _core(text: str, s: int, e: int, kind: int) -> tuple[int, int] | None:
    """The longest part of text[s:e] that passes the kind's check, without the
    signs and the open or lone brackets around it."""
    while s < e and text[s] in _TRIM_LEFT:
        s += 1
    while e > s and text[e - 1] in _TRIM_RIGHT:
        e -= 1
    if s < e and text[s] == "(" and ")" not in text[s:e - 1]:   # the bracket holds the whole
        s += 1
    if s < e and text[e - 1] == ")":
        e -= 1
        while e > s and text[e - 1] in _TRIM_RIGHT:
            e -= 1
    return (s, e) if _accepted(kind, text[s:e]) else None


def _accepted(kind: int, text: str) -> bool:
    """The check that a span of the field must pass."""
    if kind == 0:
        local, at, host = text.partition("@")
        return bool(local and at and "@" not in host and re.fullmatch(r"[\w-]+(\.[\w-]+)+", host)
                    and re.fullmatch(r"[\w.%+'-]+", local))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text)) and _is_ip(text)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9][0-9 .\-]*[0-9]", text)) and _is_card(text)
    return bool(re.fullmatch(r"[+(0-9][0-9 ().\-/]*[0-9]", text)) and 9 <= len(digits_of(text)) <= 15


def field_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """For each text the (kind, start, end) that the field finds, checked."""
    owners, scores, held = [], [], []
    for i, text in enumerate(texts):
        if _TRIGGER.search(text):
            for run in runs(text):
                owners.append(i)
                held.append(run)
                scores.append(field.scores(run_features(run)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, run, path in zip(owners, held, viterbi(scores, field)):
        t = 0
        while t < len(path):
            name = LABELS[path[t]]
            if name == "O":
                t += 1
                continue
            stop = t + 1
            while stop < len(path) and LABELS[path[stop]] == "I-" + name[2:]:
                stop += 1
            s, e = run.spans[t][0], run.spans[stop - 1][1]
            kind = KINDS.index(name[2:])
            core = _core(texts[i], s, e, kind)
            if core:
                out[i].append((kind, *core))
            t = stop
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, as sorted (kind, start, end)."""
    out = []
    for text, more in zip(texts, field_spans(texts, field)):
        base = [(k, s, e) for k, spans in enumerate(base_spans(text)) for s, e in spans]
        taken = sorted((s, e) for _, s, e in base)
        added = []
        for k, s, e in more:
            if not any(a < e and b > s for a, b in taken):
                added.append((k, s, e))
        out.append((base, sorted(base + added)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, labelled: list | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (all spans), base_sha256 and spans of every row."""
    field = default_field() if labelled is None else train(labelled)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for part in slices(batches, "text"):
            found = all_spans([t or "" for t in part.column(1).to_pylist()], shared.value)
            counts = [[sum(k == kind for k, _, _ in spans) for _, spans in found] for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([written(spans) for _, spans in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    source = pick(docs, "doc_id", "text")
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, "
                                  "base_sha256 string, spans string")
