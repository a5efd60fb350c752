"""Archives round trip: written by Spark, read in pieces, assembled through concurrent-to identifiers."""

import hashlib
import os

import pytest

from sheafline.llm import warc


def plain(rows):
    """Sorted (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    firsts = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            firsts[data] = min(page_id, firsts.get(data, page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = firsts.get(data)
        again = first is not None and (page_id is None or page_id > first)
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def reported(df):
    got = df.collect()
    assert all(r["intact"] for r in got)
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr)


LONG = "<p>" + "wörd " * 60 + "</p>"
MARK = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
ROWS = [
    (5, "http://a.example/x?y=1", LONG),
    (3, "http://a.example", LONG),
    (9, None, LONG),
    (None, "http://a.example/null", LONG),
    (3, "http://a.example/other", LONG),  # the smallest id once more
    (10, "http://b.example/", "short"),
    (11, "http://b.example/", "short"),
    (12, "http://b.example/", None),
    (13, "http://b.example/", ""),
    (14, "http://b.example/" + "z" * 9000, "x" * 99),
    (15, "http://b.example/", "x" * 99),
    (16, "http://b.example/", "x" * 100),
    (17, "http://b.example/", "x" * 100),
    (18, "not a url\r\nWARC-Type: bad\nX: y", MARK * 40),  # looks like records
    (19, "http://c.example/", "\r\n" * 200),
    (20, "http://c.example/", "WARC/1.1\r\n\r\n" + MARK),
    (None, None, None),
    (21, "http://c.example/", "long " * 200_000),
]


def frame(spark, rows=ROWS):
    full = [(i, url, html, "clash", 7) for i, url, html in rows]
    return spark.createDataFrame(full, "page_id bigint, url string, html string, record_type string, payload_bytes int")


@pytest.mark.parametrize("parts", [1, 5])
def test_round_trip(spark, parts):
    df = warc.transactions(frame(spark).repartition(parts))
    assert reported(df) == plain(ROWS)
    urls = {r["page_id"]: r["url"] for r in df.collect()}
    assert urls[18] == ROWS[13][1] and urls[9] is None and urls[14] == ROWS[9][1]


def test_empty_table(spark):
    assert warc.transactions(frame(spark, [])).count() == 0


def test_many_archives(spark, tmp_path):
    """A few records a file: the parts of a transaction lie in different archives."""
    warc.write_archives(warc.records(frame(spark)), str(tmp_path / "w"), most=2)
    assert len([f for f in os.listdir(tmp_path / "w") if f.endswith(".gz")]) > 10
    found = warc.read_archives(spark, str(tmp_path / "w")).cache()
    assert found.count() == 3 * len(ROWS) and found.filter("broken is not null").count() == 0
    rows = warc.assemble(found, warc.linked(found)).collect()
    assert len(rows) == len(ROWS)
    assert all(r["request"]["type"] == "request" and r["metadata"]["type"] == "metadata" and r["n_request"] >= 1 for r in rows)
    payloads = {bytes(r["response"]["block"]).split(b"\r\n\r\n", 1)[1].decode() for r in rows if r["response"]["type"] == "response"}
    assert payloads == {(html or "") for _, _, html in ROWS}


def _record(kind, block=b"", **fields):
    lines = [f"WARC-Type: {kind}"] + [f"{k.replace('_', '-')}: {x}" for k, v in fields.items() for x in (v if isinstance(v, list) else [v])]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + f"\r\ncontent-length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def _read(spark, folder, data, name="a.warc"):
    (folder / name).write_bytes(data)
    return warc.read_archives(spark, str(folder))


def test_links_in_any_direction(spark, tmp_path):
    """The response names the request, the metadata names the request; two requests of one response; an unlinked record."""
    data = b"".join(
        [
            _record("warcinfo", b"software: x", WARC_Record_ID="<i>"),
            _record("request", b"q", WARC_Record_ID="<q1>"),
            _record("response", b"r", WARC_Record_ID="<r1>", WARC_Concurrent_To="<q1>"),
            _record("metadata", b"m", WARC_Record_ID="<m1>", WARC_Concurrent_To="<q1>"),
            _record("request", b"q", WARC_Record_ID="<q3>", WARC_Concurrent_To=["<r2>", "<x>"]),
            _record("request", b"q", WARC_Record_ID="<q2>", WARC_Concurrent_To="<r2>"),
            _record("resource", b"\x00\xff\xfe", WARC_Record_ID="<r2>"),
            _record("metadata", b"m", WARC_Record_ID="<m9>", WARC_Concurrent_To="<none>"),
        ]
    )
    found = _read(spark, tmp_path, data).cache()
    links = warc.linked(found)
    rows = {r["capture"]: r for r in warc.assemble(found, links).collect()}
    assert rows["<r1>"]["request"]["record_id"] == "<q1>" and rows["<r1>"]["metadata"]["record_id"] == "<m1>"
    assert rows["<r2>"]["request"]["record_id"] == "<q2>" and rows["<r2>"]["n_request"] == 2 and rows["<r2>"]["metadata"] is None
    assert bytes(rows["<r2>"]["response"]["block"]) == b"\x00\xff\xfe"
    rest = {(r["record_id"], r["capture"]) for r in warc.further(found, links).collect()}
    assert rest == {("<q3>", "<r2>"), ("<i>", None), ("<m9>", None)}


def test_damaged_archives(spark, tmp_path):
    """Bytes that are no record, and a record that is cut short, are rows; what is whole around them is read."""
    good = _record("resource", b"fine", WARC_Record_ID="<a>")
    data = b"some noise" + b"\r\n\r\n" + good + b"WARC/1.0\r\nno length\r\n\r\n" + b"\r\n\r\n" + _record("resource", b"too", WARC_Record_ID="<b>")
    data += _record("resource", b"x" * 100, WARC_Record_ID="<c>")[:-60]
    got = _read(spark, tmp_path, data).collect()
    assert {r["record_id"] for r in got if r["broken"] is None} == {"<a>", "<b>"}
    assert sorted(r["broken"] for r in got if r["broken"]) == ["cut short", "no record", "no record"]


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_cutter_joins_pieces(step):
    """However the marks fall, cutting at them gives the records back."""
    blocks = [b"a\r\n\r\nWARC/1.1", b"", b"\r\n\r\nWARC/1.", MARK.encode() * step, b"\r\n", b"end"]
    data = b"".join(_record("resource", b, WARC_Record_ID=f"<{i}>") for i, b in enumerate(blocks))
    cutter = warc.Cutter("f", None)
    rows = []
    for i, piece in enumerate(data.split(b"\r\n\r\nWARC/1.")):
        rows += cutter.feed(piece if not i else b"\r\n\r\nWARC/1." + piece)
    rows += cutter.end()
    assert [(r[1], r[12], r[13]) for r in rows] == [(f"<{i}>", b, None) for i, b in enumerate(blocks)]
