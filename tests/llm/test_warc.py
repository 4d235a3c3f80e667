import base64
import glob
import gzip
import hashlib
import os
import zlib

import duckdb

from vectorloom.llm import warc
from vectorloom.llm.common import Scratch

ROWS = [(5, "http://a/1", "<p>one</p>"), (3, "http://a/2", "<p>one</p>"), (4, None, None), (6, "http://b c/", ""), (7, "u", "é" * 50_000), (8, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 900), (9, "u", "x" * 4096), (10, "u", "x" * 4095)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_round_trip(spark):
    got = {r.page_id: r for r in warc.archive_round_trip(pages(spark)).collect()}
    first = {}
    for page_id, _, html in sorted(ROWS):
        first.setdefault(html or "", page_id)
    for page_id, _, html in ROWS:
        raw = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[html or ""] == page_id else ("revisit", first[html or ""]))
        assert r.status == "ok"


def test_payloads_and_threshold(spark):
    path = Scratch(spark, "t").path()
    warc.write_warc(pages(spark), path, min_revisit_bytes=100, segment=1000)
    got = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert {i: bytes(got[i].payload).decode() for i in got} == {i: html or "" for i, _, html in ROWS}
    assert all(r.record_type == "response" for r in got.values())


def test_oracle(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", ROWS)
    cur = con.execute(warc.oracle())
    names = [d[0] for d in cur.description]
    got = warc.archive_round_trip(pages(spark)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


def test_empty(spark):
    assert warc.archive_round_trip(pages(spark).limit(0)).count() == 0


def written(spark, files):
    """A folder with the given archive files."""
    folder = Scratch(spark, "t").path().removeprefix("file://")
    os.makedirs(folder)
    for k, data in enumerate(files):
        with open(f"{folder}/a{k}.warc.gz", "wb") as f:
            f.write(data)
    return f"file://{folder}"


def test_broken_segments(spark):
    page = [r for r in warc._records(1, "u", "abc" * 1000, 1, 500)]

    def status(records):
        return [(r.status, r.page_id) for r in warc.read_warc(spark, written(spark, [b"".join(records)])).collect()]

    assert status(reversed(page)) == [("ok", 1)]
    assert status(page[:2] + page[3:]) == [("missing segment", 1)]
    assert status(page[:-1]) == [("missing segment", 1)]
    assert status([page[0], *page]) == [("missing segment", 1)]
    last = page[-1].replace(b"Total-Length: ", b"Total-Length: 1")
    assert status([*page[:-1], last]) == [("wrong length", 1)]


def test_repeated_and_unnamed_rows(spark):
    """Each row comes back: rows that repeat an id, with the same long payload and with another, and rows without id."""
    long, other = "long " * 20_000, "other " * 9_000
    rows = [(1, "u", long), (1, "u", long), (1, "v", other), (2, "w", long), (None, "x", long), (None, None, "alone"), (None, None, "alone"), (3, "y", "alone"), (4, None, None), (4, None, "")]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.status) for r in warc.archive_round_trip(pages(spark, rows)).collect()), key=str)
    want = [(1, 100_000, "response", None, "ok")] * 2 + [(1, 54_000, "response", None, "ok"), (2, 100_000, "revisit", 1, "ok"), (None, 100_000, "revisit", 1, "ok"), (3, 5, "response", None, "ok")]
    want += [(None, 5, "revisit", 3, "ok")] * 2 + [(4, 0, "response", None, "ok")] * 2
    assert got == sorted(want, key=str)
    alone = warc.archive_round_trip(pages(spark, [(None, None, long), (None, None, long)])).collect()
    assert [(r.page_id, r.payload_bytes, r.record_type, r.status) for r in alone] == [(None, 100_000, "response", "ok")] * 2


def test_files_are_archives_of_one_member_a_record(spark):
    path = Scratch(spark, "t").path()
    warc.write_warc(pages(spark), path, segment=1000)
    seen = 0
    for name in glob.glob(path.removeprefix("file://") + "/part-*"):
        data = open(name, "rb").read()
        while data:
            member = zlib.decompressobj(31)
            record = member.decompress(data)
            assert member.eof and record.startswith(b"WARC/1.1\r\nWARC-Type: ") and record.endswith(b"\r\n\r\n") and b"\r\nWARC-Date: " in record
            data, seen = member.unused_data, seen + 1
    assert seen == sum(len(list(warc._records(i, u, h, i if i not in (5, 6) else {5: 3, 6: 4}[i], 1000))) for i, u, h in ROWS)
    huge = b"x" * (1 << 24)
    assert gzip.decompress(warc._line(huge) + b"\0") == huge


def test_foreign_and_damaged_archives(spark):
    def record(kind, name, block, more=b""):
        return b"WARC/1.0\r\n" + kind + name + more + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    uuid = b"WARC-Record-ID: <urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>\r\n"
    http = b"Content-Type: application/http; msgtype=response\r\n"
    info = record(b"WARC-Type: warcinfo\r\n", b"WARC-Record-ID: <urn:uuid:1>\r\n", b"software: x\r\n", b"Content-Type: application/warc-fields\r\n")
    body = record(b"WARC-Type: response\r\n", uuid, b"HTTP/1.0 200 OK\r\nServer: a\r\n\r\n<p>hi", http)
    bare = record(b"", b"", b"no type")
    first = record(b"WARC-Type: response\r\n", b"WARC-Record-ID: <urn:uuid:s>\r\n", b"HTTP/1.1 200 OK\r\n\r\nab", http + b"WARC-Segment-Number: 1\r\n")
    second = record(b"WARC-Type: continuation\r\n", b"WARC-Record-ID: <urn:uuid:t>\r\n", b"cd", b"WARC-Segment-Number: 2\r\nWARC-Segment-Origin-ID: <urn:uuid:s>\r\nWARC-Segment-Total-Length: 23\r\n")
    whole = b"".join(gzip.compress(r) for r in (info, body, bare, second))
    folder = written(spark, [whole, first, gzip.compress(body)[:60], gzip.compress(body) + b"\x1f\x8bdamage", b"WARC/1.0\r\nContent-Length: x\r\n\r\n", b""])
    got = sorted((r.record_type or "", r.record_id[:10], bytes(r.payload).decode() if r.payload is not None else None, r.status) for r in warc.read_warc(spark, folder).collect())
    assert sorted(g[2:] for g in got if g[0] == "response") == [("<p>hi", "ok"), ("<p>hi", "ok"), ("abcd", "ok")]
    assert [g[2:] for g in got if g[0] == "warcinfo"] == [("software: x\r\n", "ok")]
    assert [g[2:] for g in got if g[0] == "unknown"] == [("no type", "ok")]
    assert [g[2:] for g in got if not g[0]] == [(None, "damaged archive")] * 3


def test_chunk_reader_in_any_pieces():
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"4;x=y\r\nWiki\r\n6\r\npedia \r\nE\r\nin \r\n\r\nchunks.\r\n0\r\nT: 1\r\n\r\n"
    for size in range(1, 30):
        reader = warc._Body(True)
        for i in range(0, len(body), size):
            reader.feed(body[i : i + size])
        assert reader.payload() == b"Wikipedia in \r\n\r\nchunks." and reader.status() == "ok"
    bad = warc._Body(True)
    bad.feed(body[:-9])
    assert bad.status() == "broken framing"
