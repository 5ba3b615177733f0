import gzip
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from dbpulse.llm.common import shared_path
from dbpulse.llm.warc import LoserTree, archived_pages, merged_index, planned, read_archives, records, write_archives


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3)), max_size=12), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def pages(spark):
    big, other = "<p>" + "same " * 40 + "</p>", "x" * 100
    rows = [(5, "http://b.example.com/x", big), (2, "https://www.b.example.com/x", big), (9, None, big), (3, "http://a b/\n", ""),
            (4, "http://é.example/", None), (7, "http://q/", "small"), (8, "http://q/", "small"), (10, "http://q/", other),
            (10, "http://q/", other), (11, "http://q/?a", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9), (12, "", "\r\n\r\n" * 60),
            (13, "http://z/", "ü" * 50), (14, "http://z/", "ü" * 50), (None, "http://z/", "ü" * 50)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, d int")


def test_round_trip(spark):
    rows, table = pages(spark)
    got = sorted((tuple(r)[:5] for r in archived_pages(table).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        revisit = len(raw) >= 100 and same and i != min(same)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response",
                     min(same) if revisit else None))
    assert got == sorted(want, key=str)


def test_archives_are_plain_warc_files(spark):
    _, table = pages(spark)
    path = shared_path(spark, "warc")
    write_archives(planned(table, "page_id", "url", "html"), path)
    files = spark.read.format("binaryFile").load(path).collect()
    found = [r for f in files for r in records(gzip.decompress(bytes(f.content)))]
    assert len(found) == 14
    assert all(h["warc-type"] in ("response", "revisit") and int(h["content-length"]) == len(b) for h, _, _, b in found)
    assert sum(h["warc-type"] == "revisit" for h, *_ in found) == 4


def test_index_is_globally_ordered(spark):
    rnd = random.Random(1)
    rows = [(i, f"http://{'hot' if i % 3 == 0 else 'h%d' % rnd.randrange(50)}.example/{rnd.randrange(9)}", f"<p>{i}</p>")
            for i in range(900)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    path = shared_path(spark, "warc")
    write_archives(planned(table, "page_id", "url", "html"), path)
    import dbpulse.llm.warc as warc
    before, warc.RANGE_ROWS = warc.RANGE_ROWS, 100
    try:
        index = merged_index(read_archives(spark, path))
        parts = index.rdd.glom().collect()
    finally:
        warc.RANGE_ROWS = before
    flat = [(r.url_key, r.captured, r.page_id, r.archive, r.offset) for p in parts for r in p]
    assert len(flat) == 900 and flat == sorted(flat) and sum(bool(p) for p in parts) > 3


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert archived_pages(empty).count() == 0
