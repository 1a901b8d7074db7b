"""Legacy ARC archives converted to WARC, WARC written and read back.

``parse_arc`` reads version 1 and version 2 containers: the version block names
the fields of the header lines, and the declared length bounds every body.
``convert`` turns each entry into a WARC record with a synthesised identifier
(name-based UUID of URL, date and payload digest), an ISO timestamp, a record
type and SHA-1 digests. ``read_arc`` does so for the archives of a folder,
``arc_containers`` makes containers of a table of pages. ``mark_revisits``
decides which records repeat a payload, ``write_warc`` writes archives, a gzip
member for each record, to a folder that all executors share, and ``read_warc``
parses them back by declared lengths. Files are bounded by bytes, not by rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, pieces, shared_path

#: Smallest payload that is replaced by a revisit record.
MIN_REVISIT = 1000
#: Bytes of an ARC container and of a pack of gzipped records, one record beyond; packs in a file.
CONTAINER_BYTES, PACK_BYTES, PACKS = 4 << 20, 4 << 20, 16
#: An empty gzip member: stands between the packs of a file and has no effect on what is read.
_EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "arc-to-warc")


# -- ARC ---------------------------------------------------------------------


def target_uri(url: str | None) -> str:
    """The URL as archives hold it: white space and control characters escaped as UTF-8 bytes; ``unknown:`` for none."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "unknown:"


def write_arc(entries: Iterable[dict], version: int = 1, name: str = "pages.arc") -> bytes:
    """An ARC container of entries (url, ip, date of 14 digits, mime, body; version 2 also code)."""
    block = f"{version} 0 archive\n{_FIELDS[version]}\n".encode()
    fixed = "0.0.0.0 19960101000000 text/plain"
    more = " 200 - - 0 " + name if version == 2 else ""
    out = [f"filedesc://{name} {fixed}{more} {len(block)}\n".encode(), block, b"\n"]
    at = sum(map(len, out))
    for e in entries:
        url = target_uri(e["url"])
        more = f" {e.get('code', 200)} {hashlib.md5(e['body']).hexdigest()} - {at} {name}" if version == 2 else ""
        line = f"{url} {e['ip']} {e['date']} {e['mime']}{more} {len(e['body'])}\n".encode()
        out += [line, e["body"], b"\n"]
        at += len(line) + len(e["body"]) + 1
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Entries of an ARC container, the version block first.

    Header lines are split from the right, so that a URL with blanks stays
    whole. A length that runs over the end raises ValueError. Gzipped containers
    (a member for each entry, or one for all) are unpacked.
    """
    if data[:2] == b"\x1f\x8b":
        data = b"".join(members(data))
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        length = int(line.rsplit(" ", 1)[1])
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError("an ARC body is shorter than its declared length")
        if fields is None:
            version, _, names = body.decode("utf-8", "replace").partition("\n")
            if int(version.split()[0]) not in _FIELDS:
                raise ValueError(f"unknown ARC version {version.split()[0]}")
            fields = names.split("\n")[0].split()
        values = line.rsplit(" ", len(fields) - 1)
        yield dict(zip(fields, values)) | {"body": body}
        at = end + 1 + length


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with its blank line, payload); no header if the body is no HTTP response."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    m = re.search(rb"\r?\n\r?\n", body)
    return (body[: m.end()], body[m.end() :]) if m else (body, b"")


def convert(data: bytes) -> Iterator[dict]:
    """WARC records of an ARC container: its version block as warcinfo, then one for each entry."""
    for k, e in enumerate(parse_arc(data)):
        head, payload = split_http(e["body"]) if k else (b"", e["body"])
        digest = hashlib.sha1(payload)
        d = e["Archive-date"].ljust(14, "0")
        yield {
            "type": "warcinfo" if not k else "response" if head else "resource",
            "record_id": f"urn:uuid:{uuid.uuid5(_SPACE, ' '.join((e['URL'], d, digest.hexdigest(), hashlib.sha1(head).hexdigest())))}",
            "uri": e["URL"],
            "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
            "ip": e["IP-address"],
            "http": head,
            "payload": payload,
            "digest": digest.hexdigest(),
        }


# -- pages to records ----------------------------------------------------------

_RECORDS = "page_id long, record_id string, uri string, date string, ip string, http binary, payload binary, payload_bytes long, digest string"
_NAMES = [x.split()[0] for x in _RECORDS.split(", ")]


def page_body(page_id: int | None, html: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(html) + html


def arc_containers(pages: DataFrame) -> DataFrame:
    """(content) ARC containers of ``CONTAINER_BYTES`` or one page, of rows (page_id, url, html).

    Containers alternate between the two ARC versions. Null html is an empty
    payload, a null URL ``unknown:``; repeated rows give equal records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(pieces(batches, CONTAINER_BYTES)):
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            html = batch.column("html").cast(pa.binary()).to_pylist()
            arc = write_arc(({"url": u, "ip": "0.0.0.0", "date": "20240101000000", "mime": "text/html", "body": page_body(i, h or b"")} for i, u, h in zip(ids, urls, html)), 1 + k % 2)
            yield pa.RecordBatch.from_pydict({"content": pa.array([arc], pa.binary())})

    return map_batches(pages.select("page_id", "url", "html"), run, "content binary")


def arc_records(containers: DataFrame) -> DataFrame:
    """WARC records of the entries of ARC containers (content), without those of the version blocks; no rows for empty containers."""
    types = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for x in convert(content.as_py() or b""):
                    if x["type"] == "warcinfo":
                        continue
                    rows.append((_page_id(x["http"]), x["record_id"], x["uri"], x["date"], x["ip"], x["http"], x["payload"], len(x["payload"]), x["digest"]))
                    size += len(x["payload"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _NAMES)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _NAMES)

    return map_batches(containers, run, _RECORDS)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """WARC records of the ARC archives (plain or gzipped, either version) in the folder ``path``; an archive is read as a whole."""
    return arc_records(spark.read.format("binaryFile").option("pathGlobFilter", "*.arc*").load(path).select("content"))


def _page_id(head: bytes) -> int | None:
    m = re.search(rb"(?m)^X-Page-Id: (-?\d+)\r?$", head)
    return int(m[1]) if m else None


def mark_revisits(records: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """Add first_id and first_record: of the record that a revisit refers to, else null.

    Of records with equal payloads of ``least`` bytes or more, that with the
    largest page_id stays a response (each of them if that page_id repeats); a
    null page_id is smaller than any other, and where all are null all stay.
    Digests are counted before they are shuffled, and only those that occur
    twice are joined; smaller payloads have a key of their own in that join, so
    that many empty pages don't meet in one task.
    """
    twice = (
        records.where(F.col("payload_bytes") >= least)
        .groupBy("digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "record_id")).alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first.page_id is not null")
        .select("digest", "payload_bytes", "first")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("first").isNotNull()
    key = F.when(F.col("payload_bytes") >= least, F.concat_ws(":", "digest", "payload_bytes")).otherwise(F.concat(F.lit("-"), F.col("record_id")))
    twice = twice.select(F.concat_ws(":", "digest", "payload_bytes").alias("key"), "first")
    return (
        records.withColumn("key", key)
        .join(twice, "key", "left")
        .drop("key")
        .withColumn("first_id", F.when(other, F.col("first.page_id")))
        .withColumn("first_record", F.when(other, F.col("first.record_id")))
        .drop("first")
    )


# -- WARC ------------------------------------------------------------------------


def warc_text() -> Column:
    """The bytes of a record."""
    revisit = F.col("first_record").isNotNull()
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    block = F.concat(F.col("http"), body)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit("<"), F.col("first_record"), F.lit(">"))),
                line("X-Refers-To-Page-Id", F.col("first_id").cast("string")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head.cast("binary"), block, F.lit(b"\r\n\r\n"))


def write_warc(records: DataFrame, path: str) -> str:
    """Write marked records as WARC files, a gzip member for each record, into the folder ``path``.

    Members are packed to ``PACK_BYTES``, so that a file holds ``PACKS`` times as
    much at most (and the records that cross a pack's bound). The text writer
    writes the packs, its separator being an empty member: any gzip reader sees
    plain WARC, and Spark's committer makes files safe against lost executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in pieces(batches):
            for record in batch.column(0):
                packer = zlib.compressobj(wbits=31)
                held.append(packer.compress(record.as_buffer()) + packer.flush())
                size += len(held[-1])
                if size >= PACK_BYTES:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held)], pa.binary())})

    packs = map_batches(records.select(warc_text().alias("value")), run, "value binary").select(F.col("value").cast("string"))
    packs.write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", PACKS).text(path)
    return path


def members(data: bytes, step: int = 1 << 13) -> Iterator[bytes]:
    """Content of each gzip member; ValueError if the last one is cut short."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            part = view[at : at + step]
            out.append(d.decompress(part))
            at += len(part)
        at -= len(d.unused_data)
        yield b"".join(out)


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields in lower case, block) of each record of a plain archive, or of a gzipped one: a member for each record, or one for all."""
    for part in members(data) if data[:2] == b"\x1f\x8b" else [data]:
        yield from _parse_plain(part)


def _parse_plain(data: bytes) -> Iterator[tuple[dict, bytes]]:
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one is expected")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4 + int(fields["content-length"])
        block = data[end + 4 : at]
        if len(block) != int(fields["content-length"]):
            raise ValueError("a WARC block is shorter than its declared length")
        yield fields, block


_READ = "page_id long, uri string, date string, record_id string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, refers_to_record string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives in ``path``.

    Of a response, size and SHA-1 are those of the payload just read, and must
    equal the declared digest (ValueError otherwise); a revisit has no payload
    and reports what its header and HTTP header declare.
    """
    names = [x.split()[0] for x in _READ.split(", ")]
    types = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def record(fields: dict, block: bytes) -> tuple:
        head, payload = split_http(block)
        digest = re.sub("^sha1:", "", fields.get("warc-payload-digest", ""))
        if len(digest) == 32:  # the usual base32 form of other writers
            digest = base64.b32decode(digest.upper()).hex()
        revisit = fields["warc-type"] == "revisit"
        if revisit:
            size = int(re.search(rb"(?mi)^Content-Length:\s*(\d+)", head)[1])
        else:
            size, found = len(payload), hashlib.sha1(payload).hexdigest()
            if digest and found != digest:
                raise ValueError("a payload does not have its declared digest")
            digest = found
        first = fields.get("x-refers-to-page-id")
        return (_page_id(head), fields.get("warc-target-uri"), fields.get("warc-date"), fields["warc-record-id"].strip("<>"), fields["warc-type"], None if revisit else payload, size, digest, int(first) if first else None, fields.get("warc-refers-to", "").strip("<>") or None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parse_warc(content.as_py()):
                    rows.append(record(fields, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,txt,warc}").load(path).select("content").mapInArrow(run, _READ)


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages, from archives written and read back.

    An empty table gives no rows. Other columns of ``pages`` don't matter,
    whatever their names.
    """
    spark = pages.sparkSession
    path = write_warc(mark_revisits(arc_records(arc_containers(pages))), path or shared_path(spark, "warc"))
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
