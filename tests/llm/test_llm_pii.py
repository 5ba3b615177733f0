import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from dbpulse.llm import pii_crf as pii


def plain(text):
    """The contract's patterns, as they are written."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def test_base_is_what_the_patterns_find():
    parts = ["1", "2", "99", "255", "256", "0", ".", "..", "@", "a", "b-c", "+", " ", "(", ")", "-", "4111 1111 1111 1111",
             "4111111111111111", "é", "x@y.zz", "+1 (234) 567-8901", "\n", "1.2.3.4", "٣"]
    rnd = random.Random(3)
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16)))
        assert [(k, *s) for k, spans in enumerate(pii.base_spans(text)) for s in spans] == plain(text), text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.luhn("79927398713")


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    n = len(pii.LABELS)
    field = pii.Field(np.zeros((1, n)), rng.normal(0, 1, (n, n)), rng.normal(0, 1, n), rng.normal(0, 1, n))
    scores = [rng.normal(0, 2, (size, n)) for size in (3, 1, 4, 2, 3)]
    for u, got in zip(scores, pii.viterbi(scores, field)):
        def value(path):
            if not pii.STARTS[path[0]] or any(not pii.ALLOWED[a, b] for a, b in zip(path, path[1:])):
                return -np.inf
            return (field.begin[path[0]] + field.end[path[-1]] + sum(u[t, y] for t, y in enumerate(path))
                    + sum(field.move[a, b] for a, b in zip(path, path[1:])))
        best = max(itertools.product(range(n), repeat=len(u)), key=value)
        assert value(tuple(got)) == value(best)


def test_held_out_rows():
    field, found, right, all_ = pii.default_field(), 0, 0, 0
    rows = [r for r in pii.labelled_rows(5, seed=77) if "ö" not in r[0]]
    for (text, spans), (_, got) in zip(rows, pii.all_spans([r[0] for r in rows], field)):
        want = {(pii.KINDS.index(k), s, e) for k, s, e in spans if k != "ip" or pii._is_ip(text[s:e])}
        found += len(got)
        all_ += len(want)
        right += len(want & set(got))
    assert right / all_ > 0.9 and right / found > 0.9


def test_field_adds_what_the_patterns_miss():
    text = "call (555) 123-4567 now or write to jörg@exämple.de today; paid with 4111.1111.1111.1111 once"
    base, spans = pii.all_spans([text], pii.default_field())[0]
    added = [(pii.KINDS[k], text[s:e]) for k, s, e in spans if (k, s, e) not in base]
    assert ("phone", "(555) 123-4567") in added and ("card", "4111.1111.1111.1111") in added
    assert set(base) <= set(spans)
    clean = "Licensed under CC BY-NC 4.0. Version 3.0.1 of 2024-01-02, page 12 of 300, token = \"9f8a7b6c5d4e3f2a1b0c\"."
    assert pii.all_spans([clean], pii.default_field()) == [([], [])]


@pytest.mark.parametrize("text,want", [
    ("(555-123-4567)", ["phone:555-123-4567"]), ("call (or 555-123-4567).", ["phone:555-123-4567"]),
    ("tel:555-123-4567", ["phone:555-123-4567"]), ("phone=555-123-4567", ["phone:555-123-4567"]),
    ("555-123-4567,555-123-4568", ["phone:555-123-4567", "phone:555-123-4568"]),
    ("mail:jörg@exämple.de", ["email:jörg@exämple.de"]), ("(call (555) 123-4567)", ["phone:(555) 123-4567"]),
    ("mobile: 555-987-6543 / 555-987-6544", ["phone:555-987-6543", "phone:555-987-6544"]),
    ("[owner=jürgen@bücher.example.org]", ["email:jürgen@bücher.example.org"])])
def test_numbers_in_brackets_and_behind_labels(text, want):
    base, spans = pii.all_spans([text], pii.default_field())[0]
    assert [f"{pii.KINDS[k]}:{text[s:e]}" for k, s, e in spans if (k, s, e) not in base] == want


# Forms that no template of the labelled table has.
UNSEEN = ["dial [phone|###-###-####]!", "her cell is [phone|(###) ###-####], ok", "Tel.: [phone|###.###.####]", "{call: [phone|### ### ####]}",
          "reply to [email|*ä*@*.net] soon", "(cc [email|*.*ö@*.org])", "billed to [card|{carddot}] yesterday", "server [ip|10.1#.#.##] went down",
          "chapter ## (page ###)", "in 19##, ## of ###", "ratio #.##:#", "part no. ##-###", "run ##/## took #.# s", "x=##, y=##, z=##",
          "lat ##.####, lon -#.####", "week ## of 20##", "ref ####-####"]


def test_forms_outside_the_labelled_table(monkeypatch):
    field = pii.default_field()
    monkeypatch.setattr(pii, "TEMPLATES", UNSEEN)
    right = found = all_ = 0
    for text, spans in pii.labelled_rows(20, seed=5):
        got = set(pii.all_spans([text], field)[0][1])
        want = {(pii.KINDS.index(k), s, e) for k, s, e in spans if k != "ip" or pii._is_ip(text[s:e])}
        right, found, all_ = right + len(want & got), found + len(got), all_ + len(want)
    assert right / all_ > 0.8 and right / found > 0.8, (right, found, all_)


def test_query_shape_and_edge_rows(spark, edge_docs, no_docs):
    long = "a" * 200_000 + " me@x.org " + "1" * 200_000
    docs = spark.createDataFrame([(1, "mail é me@x.org +1 (234) 567-8901", "s"), (2, None, None), (3, long, "s"), (None, "1.2.3.4", "s"),
                                  (1, "mail é me@x.org +1 (234) 567-8901", "s")], "doc_id long, text string, spans string")
    rows = sorted(pii.find_pii(docs).collect(), key=str)
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 5
    assert by_id[1].spans == "email:7:15,phone:16:33" and (by_id[1].n_email, by_id[1].n_phone) == (1, 1)
    assert by_id[1].base_sha256 == hashlib.sha256(b"email:7:15,phone:16:33").hexdigest()
    assert by_id[2].spans == "" and by_id[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by_id[3].spans == "email:200001:200009"
    assert by_id[None].n_ip == 1
    assert pii.find_pii(edge_docs).count() == edge_docs.count() and pii.find_pii(no_docs).count() == 0
