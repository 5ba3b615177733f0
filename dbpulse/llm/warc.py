"""WARC archives of captures, read back through a merged index.

Writing: one WARC/1.1 record per capture, written by Spark's text writer into
archive files in a shared folder (a record ends with two line ends, which is
the writer's line separator, so a file is a WARC file, gzipped as a whole;
offsets count in the plain stream). Of captures
with equal payloads (by SHA-256) of at least ``least_bytes`` bytes, the one
with the smallest id is a response that holds the payload; the others are
revisit records that name it.

Reading: every archive file is parsed by its records' lengths, whole, and
gives a run of captures sorted by URL key and timestamp. The runs meet in
ranges of (URL key, timestamp, id): each range's task merges its parts of the
runs with a loser tree, k ways, and writes them in order, so the ranges one
after the other hold every URL's captures as a globally ordered history. A
URL with most of the captures is split between ranges by timestamp and id.

Defined cases: a null payload is empty; a null URL is written without target
and its key is empty; blank characters in a URL are percent-encoded; rows
that repeat an id are captures of their own, of which each says the same; a
null id never is the response of others; an empty table gives no archive and
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbpulse.llm.common import cut, pick, shared_path

LEAST_BYTES = 100
FILE_RECORDS = 2000       # records of an archive file at most
END = "\r\n\r\n"
CAPTURED = "2024-01-01T00:00:00Z"   # for tables that state no time
RANGE_ROWS = 20_000       # captures that a range of the merged index has about


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the last to the first, then the rest.

    Scheme, user, port, a leading www and a fragment do not count.
    """
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^(?:[^/?@]*@)?(?:www\\.)?([^/?:]*)", 1))
    path = F.regexp_replace(rest, "^[^/?]*", "")
    return F.when(F.length(rest) == 0, F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), path))


def planned(pages: DataFrame, id_column: str, url_column: str, payload_column: str,
            least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, bytes, digest, refers_to (null: a response) of every row."""
    rows = (pick(pages, id_column, url_column, payload_column).toDF("page_id", "url", "payload")
            .withColumn("payload", F.coalesce(F.col("payload").cast("string"), F.lit("")))
            .withColumn("bytes", F.octet_length("payload").cast("long"))
            .withColumn("digest", F.sha2("payload", 256)))
    first = (rows.where(F.col("bytes") >= least_bytes).groupBy(F.col("digest").alias("d"))
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    same = (F.col("digest") == F.col("d")) & (F.col("bytes") >= least_bytes)
    return rows.join(first, same, "left").withColumn(
        "refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    ).drop("d", "first")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def record_text(row_time: Column) -> Column:
    """The record of a planned row, without its closing line ends."""
    revisit = F.col("refers_to").isNotNull()
    target = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    lines = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), row_time),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(lines, F.lit(END), body)


def write_archives(plan: DataFrame, path: str, row_time: Column | None = None) -> None:
    (plan.select(record_text(F.lit(CAPTURED) if row_time is None else row_time).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path))


def records(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(headers by lower-case name, offset, length, block) of every record of a WARC file."""
    at, size = 0, len(data)
    end = END.encode()
    while at < size:
        head = data.index(end, at)
        lines = data[at:head].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        body = head + len(end)
        stop = body + int(headers["content-length"])
        if data[stop:stop + len(end)] != end:
            raise ValueError(f"the record at offset {at} does not end where its length says")
        yield headers, at, stop + len(end) - at, data[body:stop]
        at = stop + len(end)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: archive, offset, length, page_id, record_type, url,
    captured, payload_bytes and payload_digest of the block, stated_digest, refers_to."""
    names = ["archive", "offset", "length", "page_id", "record_type", "url", "captured", "payload_bytes",
             "payload_digest", "stated_digest", "refers_to"]

    def name_of(urn: str | None) -> str | None:
        return urn.removeprefix("<urn:page:").removesuffix(">") if urn else None

    def run(batches):
        for b in batches:
            for archive, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(archive.rpartition("/")[2], at, length, name_of(h["warc-record-id"]), h["warc-type"],
                         h.get("warc-target-uri"), h["warc-date"], len(block), hashlib.sha256(block).hexdigest(),
                         h["warc-payload-digest"].removeprefix("sha256:"), name_of(h.get("warc-refers-to")))
                        for h, at, length, block in records(gzip.decompress(data.as_py()))]
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), *[pa.string()] * 3]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, offset long, length long, page_id string, record_type string, "
                                 "url string, captured string, payload_bytes long, payload_digest string, "
                                 "stated_digest string, refers_to string")


class LoserTree:
    """K-way merge: the losers of a tournament sit in a tree over the runs, the
    winner above it; after the winner's next element only its path is replayed."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(self.k, 1)
        for run in range(self.k - 1, -1, -1):
            self._replay(run, building=True)

    def _key(self, run: int):
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, run: int, building: bool = False) -> None:
        winner, node = run, (run + self.k) // 2
        while node > 0:
            held = self.losers[node]
            if held < 0 and building:  # the first to arrive waits for the other side
                self.losers[node] = winner
                return
            if self._beats(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k:
            run = self.losers[0]
            item = self._key(run)
            if item is None:
                return
            self.at[run] += 1
            yield item
            self._replay(run)


def merged_index(captures: DataFrame) -> DataFrame:
    """The captures (archive, offset, length, page_id, url, captured, ...) in
    global order of (url_key, captured, page_id, archive, offset), with ``url_key``.

    A partition holds one range of that order. Each archive is a run, sorted
    by itself; a range's task merges the runs' parts.
    """
    order = ["url_key", "captured", "page_id", "archive", "offset"]
    keyed = captures.withColumn("url_key", url_key(F.col("url")))
    parts = max(1, -(-keyed.count() // RANGE_ROWS))
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions("archive", *order)
    names, schema = ranged.columns, ranged.schema
    key_at = [names.index(c) for c in order]

    def merge(batches):
        tables = list(batches)   # a range, of about RANGE_ROWS index lines
        if not tables:
            return
        table = pa.Table.from_batches(tables).combine_chunks()
        keys = list(zip(*[["" if v is None else v for v in table.column(i).to_pylist()] for i in key_at],
                        range(table.num_rows)))
        runs, archive = [], None
        for key in keys:
            if key[3] != archive:
                runs.append([])
                archive = key[3]
            runs[-1].append(key)
        turn = [item[-1] for item in LoserTree(runs)]
        yield from table.take(pa.array(turn, pa.int64())).to_batches()

    return ranged.mapInArrow(merge, schema)


def archived_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
                   payload_column: str = "html", least_bytes: int = LEAST_BYTES,
                   path: str | None = None) -> DataFrame:
    """Write the archives, read them back through the merged index, and return
    per capture: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url_key, captured, archive, offset, length. A revisit's payload is that of
    its response, found by the record's reference and checked by its digest."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    id_type = pick(pages, id_column).schema[0].dataType.simpleString()
    plan = planned(pages, id_column, url_column, payload_column, least_bytes)
    write_archives(plan, path)
    index = cut(merged_index(cut(read_archives(spark, path))))
    held = (index.where("record_type = 'response'").groupBy(F.col("page_id").alias("r"),
                                                            F.col("payload_digest").alias("rd"))
            .agg(F.max("payload_bytes").alias("rb")))
    joined = index.join(held, (F.col("refers_to") == F.col("r")) & (F.col("stated_digest") == F.col("rd")), "left")
    full = F.col("record_type") == "response"
    as_id = lambda c: F.when(F.col(c) != "", F.col(c)).cast(id_type)
    return joined.select(
        as_id("page_id").alias("page_id"), F.when(full, F.col("payload_bytes")).otherwise(F.col("rb")).alias("payload_bytes"),
        F.when(full, F.col("payload_digest")).otherwise(F.col("rd")).alias("payload_digest"), "record_type",
        as_id("refers_to").alias("refers_to"), "url_key", "captured", "archive", "offset", "length")
