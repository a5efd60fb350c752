"""WARC archives: write captures as records, read archives back, and assemble the transactions.

Writing. A capture becomes three records: the request, the response (or a revisit, if an earlier capture has the same payload of
``LEAST_BYTES`` or more) and a metadata record, the first and last with ``WARC-Concurrent-To`` naming the other. Spark's text sink
writes them with its commit protocol, so a lost executor leaves no half archive: a row is a record up to the first blank line behind
it, the line separator is the second. Archives are gzip files of at most ``records`` records each.

Reading. Spark's text source hands out an archive in pieces that end where ``CRLF CRLF WARC/1.`` stands; a task joins the pieces of a
file again as they come, and cuts records by their ``Content-Length``, so a payload may hold that mark. Memory is bounded by the
longest record. Files of WARC 1.0 and 1.1, of one or many gzip members, can be read. A compressed file is never split; in an
uncompressed one, a mark inside a payload just where Spark splits the file leaves rows with ``broken`` set, none silently lost.

Assembly. Requests, responses and metadata meet by joins on record ids through the concurrent-to identifiers, whichever side names
the other, over as many steps as the links need; a capture is one row with nested ``request``, ``response`` and ``metadata``. A capture with
several requests or metadata records holds the one with the smallest id, the others are rows of ``further``: no group is gathered.

Scale: payloads are hashed in place; only digests are grouped, minima combined before the shuffle. The join that finds revisits carries
the pages; adaptive execution splits a payload with a third of all rows. Assembly moves ids and headers, no payload.

Defined results: a null payload is empty; rows that repeat the smallest page id of a payload are all responses (none revisits itself);
a null page id counts as larger than any; a null url gives a record without a target; line ends in a url are written %0D and %0A in
headers and kept as they are in the metadata; an empty table gives no records; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .frames import stored

LEAST_BYTES = 100
RECORDS = 20_000
_MARK = b"\r\n\r\nWARC/1."
_END = "\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "file string, record_id string, type string, uri string, date string, content_type string, concurrent_to array<string>, "
    "refers_to string, declared_digest string, length bigint, payload_bytes bigint, payload_digest string, block binary, broken string"
)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, first): ``first`` is the smallest id with the same payload, null if there is none smaller."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= LEAST_BYTES
    groups = rows.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    groups = stored(groups, "same-payloads")
    # Short payloads and those that occur once have no partner.
    joined = rows.withColumn("_of", F.when(long, F.col("digest"))).join(groups.withColumnRenamed("digest", "_of"), "_of", "left")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(later, F.col("first")).alias("first"))


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; those with a null value are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit("")) for name, value in pairs])


def _name(kind: str) -> Column:
    """A record's id from what it is of: the same whenever it is written again."""
    own = F.md5(F.concat_ws(":", F.lit(kind), "digest", F.col("named").cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(own, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: str, content_type: str, block: Column, *pairs: tuple[str, Column]) -> Column:
    head = (("WARC-Type", F.lit(kind)), ("WARC-Date", F.col("date")), ("Content-Type", F.lit(content_type)))
    size = ("Content-Length", F.octet_length(block).cast("string"))
    return F.concat(F.lit(f"WARC/1.1{_END}"), _lines(*head, *pairs, size), F.lit(_END), block, F.lit(_END))


def records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", **columns: str) -> DataFrame:
    """``value``: the request, response or revisit, and metadata record of each page, as WARC text."""
    rows = captures(pages, **columns).withColumn("date", F.lit(date)).withColumn("named", F.col("page_id"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    rows = rows.withColumn("uri", uri)
    rows = rows.withColumn("own", F.when(F.col("first").isNull(), _name("response")).otherwise(_name("revisit")))
    rows = rows.withColumn("asked", _name("request")).withColumn("told", _name("metadata"))
    rows = rows.withColumn("named", F.col("first"))
    rows = rows.withColumn("refers", F.when(F.col("first").isNotNull(), _name("response")))
    host = F.regexp_extract("uri", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace("uri", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    request = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(F.coalesce(path, F.lit("*"))), F.lit(" HTTP/1.1\r\n"), _lines(("Host", F.when(host != "", host))), F.lit(_END))
    answer = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"),
        _lines(("Content-Length", F.octet_length("payload").cast("string"))),
        F.lit(_END),
    )
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))
    target, with_own = ("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", F.col("own"))
    own, refers = ("WARC-Record-ID", F.col("own")), (("WARC-Refers-To", F.col("refers")), ("WARC-Profile", F.lit(_REVISIT)))
    http = "application/http; msgtype="
    three = F.array(
        _record("request", f"{http}request", request, ("WARC-Record-ID", F.col("asked")), with_own, target),
        F.when(F.col("first").isNull(), _record("response", f"{http}response", F.concat(answer, "payload"), own, target, digest)).otherwise(
            _record("revisit", f"{http}response", answer, own, target, digest, *refers)
        ),
        _record("metadata", "application/json", F.to_json(F.struct("page_id", "url")), ("WARC-Record-ID", F.col("told")), with_own, target),
    )
    return rows.select(F.explode(three).alias("value"))


def write_archives(warc: DataFrame, path: str, most: int = RECORDS) -> None:
    """Rows of ``value`` as gzip archives of at most ``most`` records each."""
    warc.select("value").write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


class Cutter:
    """Cuts the byte stream of one archive into records as it comes."""

    def __init__(self, file: str, keep: tuple[str, ...] | None):
        self.file, self.keep, self.held, self.size, self.need = file, keep, [], 0, 0

    def feed(self, piece: bytes) -> Iterator[tuple]:
        self.held.append(piece)
        self.size += len(piece)
        if self.size >= self.need:
            yield from self._cut(False)

    def end(self) -> Iterator[tuple]:
        yield from self._cut(True)

    def _cut(self, last: bool) -> Iterator[tuple]:
        data, at = b"".join(self.held), 0
        self.need = 0
        while True:
            while data[at : at + 2] == b"\r\n":
                at += 2
            if at >= len(data):
                break
            stop = data.find(b"\r\n\r\n", at)
            fields = self._fields(data[at:stop]) if stop >= 0 else None
            if fields is None:
                if stop < 0 and not last and data[at : at + 5] == b"WARC/":
                    break  # the mark stood in the header's last line: the blank line comes with the next piece
                # Not a record: whatever stands up to the next mark.
                mark = data.find(_MARK, at)
                to = mark if mark >= 0 else len(data)
                yield self._broken(data[at:to], "no record")
                at = to
                continue
            begin = stop + 4
            size = int(fields["content-length"][0])
            if begin + size > len(data):
                if not last:
                    self.need = begin + size - at
                    break
                yield self._broken(data[at:], "cut short")
                at = len(data)
                continue
            yield self._row(fields, data[begin : begin + size])
            at = begin + size
        self.held, self.size = [data[at:]], len(data) - at

    @staticmethod
    def _fields(head: bytes) -> dict[str, list[str]] | None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            return None
        fields: dict[str, list[str]] = {}
        name = None
        for line in lines[1:]:
            if line[:1] in (" ", "\t") and name:
                fields[name][-1] += " " + line.strip()
            elif ":" in line:
                name, value = line.split(":", 1)
                name = name.strip().lower()
                fields.setdefault(name, []).append(value.strip())
        size = fields.get("content-length", [""])[0]
        return fields if size.isascii() and size.isdigit() else None

    def _broken(self, data: bytes, why: str) -> tuple:
        return (self.file, *[None] * 5, [], *[None] * 2, len(data), None, None, data, why)

    def _row(self, fields: dict[str, list[str]], block: bytes) -> tuple:
        def one(name: str) -> str | None:
            return fields.get(name, [None])[0]

        kind, content = one("warc-type"), one("content-type")
        payload = memoryview(block)
        if content and content.startswith("application/http"):
            head = block.find(b"\r\n\r\n")
            payload = payload[head + 4 :] if head >= 0 else payload[len(block) :]
        kept = self.keep is None or kind in self.keep
        return (
            self.file, one("warc-record-id"), kind, one("warc-target-uri"), one("warc-date"), content,
            fields.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-payload-digest"), len(block), len(payload),
            hashlib.sha256(payload).hexdigest(), block if kept else None, None,
        )


_KINDS = (
    [pa.string()] * 6 + [pa.list_(pa.string())] + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string(), pa.binary(), pa.string()]
)


def read_archives(spark: SparkSession, path: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``RECORD`` rows of the archives at ``path``, in any store that Spark reads; blocks of the types ``keep`` only, of all by default.

    What is no record, or is cut short, is a row with ``broken`` set and its bytes as the block.
    """
    names = [part.strip().split(" ")[0] for part in RECORD.split(", ")]
    pieces = spark.read.option("lineSep", _MARK.decode()).text(path)
    pieces = pieces.select(F.col("value").cast("binary"), "_metadata.file_path", "_metadata.file_block_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _KINDS)], names=names)

        cutter, now = None, None
        for batch in batches:
            files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, place in enumerate(zip(files, starts)):
                piece = batch.column(0)[i].as_py()
                found: list[tuple] = []
                if place != now:
                    found += cutter.end() if cutter else ()
                    cutter, now = Cutter(place[0], keep), place
                    found += cutter.feed(_MARK[4:] + piece if place[1] else piece)
                else:
                    found += cutter.feed(_MARK + piece)
                rows += found
                held += sum(len(r[12] or b"") + 500 for r in found)
                if held > 4 << 20:
                    yield out()
                    rows, held = [], 0
        if cutter:
            rows += cutter.end()
        if rows:
            yield out()

    return pieces.mapInArrow(run, RECORD)


_ANCHORS = ("response", "revisit", "resource")


def linked(found: DataFrame) -> DataFrame:
    """(record_id, capture): for every record that concurrent-to identifiers join to a response, its response's id (the smallest)."""
    ways = found.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    edges = stored(ways.unionByName(ways.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    reached = found.filter(F.col("type").isin(*_ANCHORS)).select("record_id", F.col("record_id").alias("capture")).distinct()
    reached = last = stored(reached, "captures")
    while True:
        step = edges.join(last, edges["a"] == last["record_id"]).groupBy(F.col("b").alias("record_id")).agg(F.min("capture").alias("capture"))
        last = stored(step.join(reached.select("record_id"), "record_id", "left_anti"), "reached")
        if last.isEmpty():
            return reached
        reached = reached.unionByName(last)


def assemble(found: DataFrame, links: DataFrame) -> DataFrame:
    """A row for each response, revisit or resource: nested ``response``, ``request`` and ``metadata``, and how many of the latter there are."""
    members = found.filter(~F.col("type").isin(*_ANCHORS)).join(links, "record_id")
    own = F.struct(*[F.col(c) for c in found.columns])

    def least(kind: str) -> Column:
        return F.min_by(F.when(F.col("type") == kind, own), F.when(F.col("type") == kind, F.col("record_id")))

    grouped = members.groupBy("capture").agg(
        *[least(kind).alias(kind) for kind in ("request", "metadata")],
        *[F.count_if(F.col("type") == kind).alias(f"n_{kind}") for kind in ("request", "metadata")],
    )
    grouped = stored(grouped, "members").withColumnRenamed("capture", "record_id")
    anchors = found.filter(F.col("type").isin(*_ANCHORS)).select("record_id", own.alias("response"))
    out = anchors.join(grouped, "record_id", "left").withColumnRenamed("record_id", "capture")
    return out.fillna(0, ["n_request", "n_metadata"])


def further(found: DataFrame, links: DataFrame) -> DataFrame:
    """The records that no capture row holds, with the ``capture`` that they belong to, or null if nothing links them to one."""
    others = found.filter(F.col("type").isNull() | ~F.col("type").isin(*_ANCHORS))
    rows = others.join(links, "record_id", "left")
    chosen = rows.filter("capture is not null and type in ('request', 'metadata')").groupBy("capture", "type").agg(F.min("record_id").alias("record_id"))
    return rows.join(chosen, ["capture", "type", "record_id"], "left_anti")


def transactions(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Write the pages as archives, read them back and report each capture.

    Returns the id, payload_bytes, payload_digest, record_type, refers_to, url and ``intact``: whether the payload read has the digest
    that its record declares (null for a revisit whose response is missing).
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "archives")
    write_archives(records(pages, id_col=id_col, **columns), folder)
    found = stored(read_archives(spark, folder, ("metadata",)), "records")
    id_type = pages.schema[id_col].dataType.simpleString()
    told = F.from_json(F.col("metadata.block").cast("string"), f"page_id {id_type}, url string")
    rows = assemble(found, linked(found)).select("capture", "response", told.alias("told"))
    rows = rows.select(
        "capture",
        F.col("told.page_id").alias(id_col),
        F.col("told.url").alias("url"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("of"),
        F.regexp_replace("response.declared_digest", "^sha256:", "").alias("declared"),
        F.col("response.payload_bytes").alias("n"),
        F.col("response.payload_digest").alias("digest"),
    )
    rows = stored(rows, "transactions")
    first = rows.filter("record_type = 'response'").groupBy(F.col("capture").alias("of"))
    first = stored(first.agg(F.min(id_col).alias("refers_to"), F.max("n").alias("whole"), F.max("digest").alias("held")), "responses")
    joined = rows.join(first, "of", "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        id_col,
        F.when(revisit, F.col("whole")).otherwise(F.col("n")).alias("payload_bytes"),
        F.coalesce("declared", "digest").alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
        "url",
        (F.when(revisit, F.col("held")).otherwise(F.col("digest")) == F.col("declared")).alias("intact"),
    )
