"""Operator 2: WARC archives with segmented records: writing, segment reassembly and chunked-transfer decoding."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.common import Scratch

CRLF, END = b"\r\n", b"\r\n\r\n"
#: Bytes of a record block in one segment; bytes of one HTTP chunk; records in one archive file. Together they bound a file.
SEGMENT, CHUNK, RECORDS = 16_384, 4_096, 4_096
#: Fixed value: the profile that WARC names for revisits with the same payload.
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record ids are <urn:page:ID:SHA1>, with #N before the end where rows repeat an id and its payload.
PREFIX = "<urn:page:"
#: WARC-Date of written records; fixed, so that archives of equal tables are equal.
DATE = b"2020-01-01T00:00:00Z"

PIECES = pa.schema([("key", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("refers", pa.string()), ("claimed", pa.string()), ("block", pa.binary()), ("size", pa.int64()), ("digest", pa.string()), ("status", pa.string()), ("payload", pa.binary())])
PIECES_DDL = "key long, origin string, segment int, total long, kind string, uri string, refers string, claimed string, block binary, size long, digest string, status string, payload binary"
RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_id", pa.string()), ("claimed", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string()), ("payload", pa.binary())])
RECORD_DDL = "record_id string, record_type string, uri string, refers_id string, claimed string, payload_bytes long, payload_digest string, status string, payload binary"


def _head(fields: list[tuple[bytes, bytes]]) -> bytes:
    return b"WARC/1.1" + CRLF + b"".join(k + b": " + v + CRLF for k, v in fields) + CRLF


def _chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))]
    return b"".join(parts) + b"0\r\n\r\n"


def _name(page: int | None, sha: str, copy: int | None = None) -> bytes:
    return f"{PREFIX}{'' if page is None else page}:{sha}{'' if copy is None else f'#{copy}'}>".encode()


def _records(page: int | None, url: str | None, html: str | None, first: int | None, segment: int, copy: int | None = None) -> Iterator[bytes]:
    payload = (html or "").encode("utf-8", "surrogatepass")
    sha = hashlib.sha1(payload)
    digest = b"sha1:" + base64.b32encode(sha.digest())
    uri = [(b"WARC-Target-URI", b"".join(url.encode("utf-8", "surrogatepass").split()))] if url is not None else []
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    name = _name(page, sha.hexdigest(), copy)

    def record(kind: bytes, own: bytes, more: list[tuple[bytes, bytes]], block: bytes) -> bytes:
        return _head([(b"WARC-Type", kind), (b"WARC-Record-ID", own), (b"WARC-Date", DATE), *uri, *more, (b"Content-Type", b"application/http;msgtype=response"), (b"Content-Length", b"%d" % len(block))]) + block + END

    if first is not None and first != page:
        yield record(b"revisit", name, [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", _name(first, sha.hexdigest())), (b"WARC-Payload-Digest", digest)], http)
        return
    block = http + _chunked(payload)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, piece in enumerate(pieces, 1):
        more = [(b"WARC-Segment-Number", b"%d" % n)] if len(pieces) > 1 else []
        more += [(b"WARC-Segment-Origin-ID", name)] if n > 1 else [(b"WARC-Payload-Digest", digest)]
        more += [(b"WARC-Segment-Total-Length", b"%d" % len(block))] if n == len(pieces) > 1 else []
        yield record(b"response" if n == 1 else b"continuation", name if n == 1 else name[:-1] + b":%d>" % n, more, piece)


def _line(record: bytes) -> bytes:
    """A gzip member of one record, without its last byte: that is the top byte of the record's length, which is 0 below
    16 MiB, and the text writer adds it as line end. A longer record (a giant url) is followed by an empty member."""
    member = gzip.compress(record, 6, mtime=0)
    return (member if member[-1] == 0 else member + gzip.compress(b"", mtime=0))[:-1]


def _map_write(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page, url, html, first, copy in zip(*(batch.column(i) for i in range(5)), strict=True):
                for record in _records(page.as_py(), url.as_py(), html.as_py(), first.as_py(), segment, copy.as_py()):
                    out.append(_line(record))
                    held += len(out[-1])
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Write a response or revisit record for each row of ``pages`` (page_id, url, html) as WARC files of one gzip member
    a record.

    Of equal payloads of ``min_revisit_bytes`` or more, the rows with the smallest page_id are responses and the
    others are revisits that refer to it. Blocks longer than ``segment`` bytes become continuation records. Payloads
    are HTTP bodies in chunked framing. Null html is an empty payload; a null url leaves out the target; white space
    in a url is dropped. A row without page_id is a revisit of an equal payload that has one, else a response. Rows that
    repeat page_id and payload each have their own record, with a number in the id that differs from run to run. An
    empty table gives files without records. The files are written by Spark's text writer, with the members' last byte as
    line end, so they may lie in any store that Spark can write; they carry its suffix.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("content", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    large = F.coalesce(F.octet_length("html"), F.lit(0)) >= min_revisit_bytes
    each = rows.select("content", "page_id", large.alias("large")).groupBy("content", "page_id", "large").agg(F.count("*").alias("n"))
    # written, so that the join deals both sides anew and AQE can split a payload that many pages have
    firsts = Scratch(spark, "firsts").keep(each.groupBy("content").agg(F.min(F.when(F.col("large"), F.col("page_id"))).alias("first"), F.max("n").alias("n"), F.sum("n").alias("all")).where("all > 1").select("content", "first", (F.col("n") > 1).alias("repeated")))
    dealt = rows.join(firsts.hint("shuffle_hash"), "content", "left")
    dealt = dealt.select("page_id", "url", "html", F.coalesce("first", "page_id").alias("first"), F.when(F.col("repeated"), F.monotonically_increasing_id()).alias("copy"))
    records = dealt.mapInArrow(_map_write(segment), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS).text(path)


class _Body:
    """Incremental reader of one HTTP message (or plain block): skips the header, undoes chunked framing, hashes and
    measures."""

    def __init__(self, keep: bool, http: bool = True):
        self.buffer, self.chunked, self.state, self.left = b"", False, "head" if http else "plain", 0
        self.sha, self.size, self.kept = hashlib.sha1(), 0, [] if keep else None

    def _take(self, data: bytes) -> None:
        self.sha.update(data)
        self.size += len(data)
        if self.kept is not None:
            self.kept.append(data)

    def feed(self, data: bytes) -> None:
        buffer = self.buffer + data if self.buffer else data
        at = 0
        while at < len(buffer) and self.state != "bad":
            if self.state == "head":
                end = buffer.find(END, at)
                if end < 0:
                    break
                self.chunked = b"transfer-encoding: chunked" in buffer[at:end].lower()
                self.state, at = ("size" if self.chunked else "plain"), end + 4
            elif self.state == "plain":
                self._take(buffer[at:])
                at = len(buffer)
            elif self.state == "size":
                end = buffer.find(CRLF, at)
                if end < 0:
                    break
                try:
                    self.left = int(buffer[at:end].split(b";")[0], 16)
                    self.state = "data" if self.left else "trailer"
                except ValueError:
                    self.state = "bad"
                at = end + 2
            elif self.state == "data":
                part = buffer[at : at + self.left]
                self._take(part)
                at += len(part)
                self.left -= len(part)
                self.state = "data" if self.left else "after"
            elif self.state == "after":
                if len(buffer) - at < 2:
                    break
                self.state = "size" if buffer[at : at + 2] == CRLF else "bad"
                at += 2
            elif self.state == "trailer":
                end = buffer.find(CRLF, at)
                if end < 0:
                    break
                self.state, at = ("done" if end == at else "trailer"), end + 2
            else:  # bytes after the last chunk
                self.state = "bad"
        self.buffer = buffer[at:]

    def status(self) -> str:
        whole = self.state == "done" or self.state == "plain" or (self.state == "head" and not self.buffer)
        return "ok" if whole and not self.buffer else "broken framing"

    def digest(self) -> str:
        return base64.b32encode(self.sha.digest()).decode()

    def payload(self) -> bytes | None:
        return b"".join(self.kept) if self.kept is not None else None


def _inflate(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive file, piece by piece, whether gzipped (in any number of members) or not."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        while data and not member.eof:
            yield member.decompress(data, 1 << 20)
            data = member.unconsumed_tail or member.unused_data
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        data = data.lstrip(b"\0")


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(fields in lower case, block) of each record of an archive file; raises ValueError or zlib.error where the file is
    damaged, after the records before that place."""
    pieces, buffer = iter(pieces), bytearray()

    def fill() -> bool:
        piece = next(pieces, None)
        buffer.extend(piece or b"")
        return piece is not None

    while True:
        while not (rest := buffer.lstrip(b"\r\n")):
            if not fill():
                return
        buffer = rest
        while (end := buffer.find(END)) < 0:
            if not fill():
                raise ValueError("a record's head is cut short")
        lines = bytes(buffer[:end]).split(CRLF)
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("no record begins here")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
        stop = end + 4 + int(fields.get(b"content-length", b""))
        while len(buffer) < stop:
            if not fill():
                raise ValueError("a record is cut short")
        yield fields, bytes(buffer[end + 4 : stop])
        del buffer[:stop]


def _key(origin: str) -> int:
    return int.from_bytes(hashlib.blake2b(origin.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")


def _count(value: bytes | None, otherwise: int) -> int:
    return int(value) if value and value.isdigit() and len(value) < 19 else otherwise


def _map_parse(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)
            rows.clear()
            return out

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                held = 0
                try:
                    for number, (fields, block) in enumerate(parse(_inflate(content.as_py()))):
                        kind = _text(fields.get(b"warc-type", b"unknown"))
                        segment = _count(fields.get(b"warc-segment-number"), 0)
                        own = _text(fields.get(b"warc-record-id")) or f"<{path.as_py()}#{number}>"
                        origin = _text(fields.get(b"warc-segment-origin-id")) or own
                        claimed = _text(fields.get(b"warc-payload-digest"))
                        http = b"application/http" in fields.get(b"content-type", b"").lower()
                        row = (_key(origin), origin, segment, _count(fields.get(b"warc-segment-total-length"), -1), kind, _text(fields.get(b"warc-target-uri")), _text(fields.get(b"warc-refers-to")), claimed and claimed.removeprefix("sha1:"))
                        if segment:
                            row += (block, None, None, None, None)
                        else:
                            body = _Body(keep, http)
                            body.feed(block)
                            row += (None, body.size, body.digest(), body.status() if kind == "response" else "ok", body.payload())
                        rows.append(row)
                        held += len(block)
                        if held > 8_000_000:
                            yield made()
                            held = 0
                except (ValueError, zlib.error):  # told as a row of its own
                    name = f"<{path.as_py()}>"
                    rows.append((_key(name), name, 0, -1, None, None, None, None, None, None, None, "damaged archive", None))
                if rows:
                    yield made()

    return run


def _map_join(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"origin": None}
        out: list[tuple] = []

        def close() -> None:
            if state["origin"] is None:
                return
            body = state["body"]
            status = body.status()
            if state["gap"] or state["total"] < 0 or state["kind"] is None:
                status = "missing segment"
            elif state["length"] != state["total"]:
                status = "wrong length"
            out.append((state["origin"], state["kind"], state["uri"], state["refers"], state["claimed"], body.size, body.digest(), status, body.payload()))
            state["origin"] = None

        for batch in batches:
            for _, origin, segment, total, kind, uri, refers, claimed, block, size, digest, status, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not segment:
                    out.append((origin, kind, uri, refers, claimed, size, digest, status, payload))
                    continue
                if state["origin"] != origin:
                    close()
                    state = {"origin": origin, "kind": None, "uri": uri, "refers": None, "claimed": None, "body": _Body(keep), "gap": False, "total": -1, "length": 0, "next": 1}
                if segment == 1:
                    state |= {"kind": kind, "uri": uri, "refers": refers, "claimed": claimed}
                if segment != state["next"]:
                    state["gap"] = True
                state["next"] = segment + 1
                state["length"] += len(block)
                state["total"] = max(state["total"], total)
                state["body"].feed(block)
            if len(out) > 2000 or keep:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(RECORD), RECORD, strict=True)], schema=RECORD)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RECORD, strict=True)], schema=RECORD)

    return run


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``, gzipped or not, segments put together.

    Continuation records meet their origin by its identifier (any string) and are read in order of segment number; the
    sum of their lengths is held against the total length, gaps and repeated segments are told, and the chunked framing
    of the HTTP body is undone piece by piece, so a task holds one segment at a time unless payloads are kept. A block
    that is no HTTP message is its own payload.

    Returns (record_id, record_type, uri, refers_id, claimed, payload_bytes, payload_digest, status, payload, page_id,
    refers_to): the last two are the numbers in ids that ``write_warc`` gave, else null. status is ok, missing segment,
    wrong length or broken framing; a file that is damaged gives its records up to that place and a row without type
    and payload of status ``damaged archive``. A record without a type has type unknown, one without an id gets one from
    its place. A revisit has no payload of its own. Archives without records give an empty result.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    pieces = files.mapInArrow(_map_parse(keep_payload), PIECES_DDL)
    whole = pieces.repartition("key").sortWithinPartitions("key", "origin", "segment").mapInArrow(_map_join(keep_payload), RECORD_DDL)

    def number(name: str) -> Column:
        digits = F.regexp_extract(name, rf"^{PREFIX}(-?\d+):", 1)
        return F.when(digits != "", digits.cast("long"))

    return whole.withColumn("page_id", number("record_id")).withColumn("refers_to", number("refers_id"))


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0, segment: int = SEGMENT, scratch: Scratch | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back, and resolve revisits through the record they refer to.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to, uri, status), one row for each row of
    ``pages``, those that repeat and those without page_id too; size and digest are those of the full payload as read
    back. status is also ``dangling`` (the response is missing) or ``wrong digest`` (the payload read differs from the
    one that the record names). Null html is an empty payload; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    path = scratch.path()
    write_warc(pages, path, min_revisit_bytes, segment)
    records = scratch.keep(read_warc(spark, path, keep_payload=False).drop("payload"))
    # rows that repeat a page_id and its payload are one target; written, so that AQE can split a response that many name
    target = F.regexp_replace("record_id", r"#\d+>$", ">")
    targets = scratch.keep(records.where("record_type = 'response'").groupBy(target.alias("refers_id")).agg(F.max("payload_bytes").alias("size"), F.max("payload_digest").alias("digest"), F.max("status").alias("found")))
    own = records.where("record_type is distinct from 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "status", "claimed")
    again = records.where("record_type = 'revisit'").join(targets, "refers_id", "left").select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "uri", F.coalesce("found", F.lit("dangling")).alias("status"), "claimed")
    status = F.when((F.col("status") == "ok") & ~F.col("claimed").eqNullSafe(F.col("payload_digest")), F.lit("wrong digest")).otherwise(F.col("status"))
    return own.unionByName(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", status.alias("status"))


def oracle() -> str:
    """DuckDB SQL for the query's rows. Base 32 digits are cut from the hex form, five bits each."""
    digit = "('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[((CAST('0x' || h[(5 * i) // 4 + 1 : (5 * i) // 4 + 2] AS INTEGER) >> (3 - (5 * i) % 4)) & 31) + 1]"
    return f"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: {digit}), '') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN first <> page_id THEN first END AS refers_to, regexp_replace(url, '\\s', '', 'g') AS uri, 'ok' AS status FROM d"""
