"""Legacy archives to WARC.

An ARC file starts with a ``filedesc`` record that names its version; from then on a record is a header line with
the fields of that version (1: URL, IP, date, type, length; 2: also result code, checksum, location, offset, file
name), its declared number of bytes, and a line end. Records may be gzip members. A WARC record is made from each:
identifier (UUID of archive, offset, URL and date), ISO timestamp, type (filedesc: warcinfo; HTTP: response;
others: resource) and base32 SHA-1 digests of block and payload.

Archives are written by Spark as files of whole records of about ``PACK_BYTES`` each and read as binary files, so
any store that Spark reaches will do and no file is unbounded but for a single large record. Every record is a gzip
member of its own. Of responses with equal payloads the one with the smallest page_id (null last, then by
identifier) stays; the others become revisit records without payload.

Null html is an empty payload, a null url becomes ``urn:page:<id>``; a null page_id stays null. An empty table gives
an archive without records. Broken headers and short blocks raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_path

PACK_BYTES, PIECE = 8 << 20, 16 << 10
#: Names of the fields of an ARC header line, by version. Fixed values.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each gzip member; data that isn't gzip is one member."""
    if data[:2] != b"\x1f\x8b":
        yield 0, data
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        reader, parts, end = zlib.decompressobj(31), [], at
        while not reader.eof and end < len(data):  # by pieces: the rest of the file is copied for no member
            parts.append(reader.decompress(data[end : end + PIECE]))
            end = min(end + PIECE, len(data)) - len(reader.unused_data)
        if not reader.eof:
            raise ValueError(f"gzip member at {at} is cut off")
        yield at, b"".join(parts)
        at = end
    if data[at:].strip():
        raise ValueError(f"no gzip member at {at}")


def arc_header(url: str, ip: str, date: str, kind: str, length: int, version: int = 1, **more: object) -> bytes:
    values = {"url": url, "ip": ip, "date": date, "type": kind, "length": length} | more
    return " ".join(re.sub(r"\s+", "%20", str(values.get(f, "-"))) for f in ARC_FIELDS[version]).encode() + b"\n"


def arc_record(block: bytes, url: str, ip: str, date: str, kind: str, version: int = 1, **more: object) -> bytes:
    return arc_header(url, ip, date, kind, len(block), version, **more) + block + b"\n"


def arc_filedesc(name: str, date: str, version: int = 1) -> bytes:
    names = {1: "URL IP-address Archive-date Content-type Archive-length",
             2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    block = f"{version} 0 converted\n{names[version]}\n".encode()
    return arc_record(block, f"filedesc://{name}", "0.0.0.0", date, "text/plain", version, result=200, filename=name)


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: the header's fields, block, offset and version."""
    version = None
    for base, plain in members(data):
        at = 0
        while at < len(plain):
            if plain[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = plain.find(b"\n", at)
            if end < 0:
                raise ValueError(f"no header line at {base}+{at}")
            line = plain[at:end].rstrip(b"\r").decode("utf-8", "replace")
            if version is None:
                first = plain[end + 1 : end + 2]
                if not line.startswith("filedesc:") or first not in (b"1", b"2"):
                    raise ValueError("an ARC file starts with a filedesc record of version 1 or 2")
                version = int(first)
            fields = line.rsplit(" ", len(ARC_FIELDS[version]) - 1)
            if len(fields) != len(ARC_FIELDS[version]) or not fields[-1].isdigit():
                raise ValueError(f"not a version {version} header at {base}+{at}: {line[:80]!r}")
            record = dict(zip(ARC_FIELDS[version], fields, strict=True))
            block = plain[end + 1 : end + 1 + int(record["length"])]
            if len(block) != int(record["length"]):
                raise ValueError(f"block at {base}+{at} is cut off")
            yield record | {"block": block, "offset": base + at, "version": version}
            at = end + 1 + len(block)


def iso_date(arc_date: str) -> str:
    d = (arc_date if arc_date.isdigit() else "").ljust(14, "0")[:14]
    month, day = (d[4:6] if d[4:6] != "00" else "01"), (d[6:8] if d[6:8] != "00" else "01")
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header of an HTTP message with its empty line, and payload."""
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def arc_to_warc(record: dict, archive: str) -> dict:
    """The WARC equivalent of an ARC record: named fields, block and payload."""
    url, block = record["url"], record["block"]
    if url.startswith("filedesc:"):
        kind, content, head, payload = "warcinfo", "application/warc-fields", b"", block
    elif block.startswith(b"HTTP/"):
        kind, content = "response", "application/http; msgtype=response"
        head, payload = split_http(block)
    else:
        kind, content, head, payload = "resource", record["type"], b"", block
    name = f"{archive} {record['offset']} {url} {record['date']}"
    return {
        "type": kind, "id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "date": iso_date(record["date"]),
        "uri": url, "ip": record["ip"], "content": content, "block": block, "head": head, "payload": payload,
        "block_digest": digest(block), "payload_digest": digest(payload),
    }


def warc_record(fields: dict[str, object], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields.items() if v is not None)]
    return b"\r\n".join([*lines, f"Content-Length: {len(block)}".encode(), b"", block, b"", b""])


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower case) and block of each record."""
    for _, plain in members(data):
        at = 0
        while at < len(plain):
            if plain[at : at + 2] == b"\r\n" or plain[at : at + 1] == b"\n":
                at += 1 + (plain[at : at + 1] == b"\r")
                continue
            end = plain.find(b"\r\n\r\n", at)
            lines = plain[at : max(end, at)].decode().split("\r\n")
            if end < 0 or not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at {at}")
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            n = int(fields["content-length"])
            block = plain[end + 4 : end + 4 + n]
            if len(block) != n:
                raise ValueError(f"block at {at} is cut off")
            yield fields, block
            at = end + 4 + n


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode() if m else None


def _packs(records: Iterable[bytes], first: bytes = b"") -> Iterator[bytes]:
    """Whole records together, in files of about PACK_BYTES."""
    held, size = [first] if first else [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= PACK_BYTES:
            yield b"".join(held)
            held, size = [first] if first else [], 0
    if size:
        yield b"".join(held)


def _write(packs: DataFrame, label: str) -> str:
    """One file for each row of ``packs`` (pack binary)."""
    path = shared_path(packs.sparkSession, label)
    packs.select(F.col("pack").cast("string")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arc(pages: DataFrame, date: str = "20200101000000", version: int = 1) -> str:
    """Pages (page_id, url, html) as ARC files of HTTP responses; the folder's path."""

    def run(batches):
        def records():
            for batch in batches:
                html = batch["html"].cast(pa.binary()).to_pylist()
                for i, url, payload in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), html, strict=True):
                    payload = payload or b""
                    own = f"X-Page-Id: {i}\r\n" if i is not None else ""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
                    yield gzip_member(arc_record(head.encode() + payload, url or f"urn:page:{i}", "0.0.0.0", date, "text/html", version))

        first = gzip_member(arc_filedesc("pages.arc", date, version))
        for pack in _packs(records(), first):
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.binary())], names=["pack"])

    return _write(pages.select("page_id", "url", "html").mapInArrow(run, "pack binary"), "arc")


_CONVERTED = "record_id string, page_id long, payload_bytes long, payload_digest string"


def convert(arcs: DataFrame, whole: bool = True) -> DataFrame:
    """ARC files (path, content) as WARC records; with ``whole``, also fields and the block as a gzip member."""
    more = ", type string, date string, uri string, ip string, content_type string, block_digest string, block binary"
    names = (_CONVERTED + more * whole).replace(",", " ").split()[::2]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                rows = []
                for record in read_arc(content.as_buffer().to_pybytes()):
                    w = arc_to_warc(record, path.rpartition("/")[2])
                    page = http_field(w["head"], "X-Page-Id")
                    row = [w["id"], int(page) if page else None, len(w["payload"]), w["payload_digest"]]
                    if whole:
                        row += [w["type"], w["date"], w["uri"], w["ip"], w["content"], w["block_digest"], gzip_member(w["block"], 3)]
                    if w["type"] != "warcinfo" or whole:
                        rows.append(row)
                columns = list(zip(*rows, strict=True)) or [[] for _ in names]
                types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 7, pa.binary()][: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return arcs.mapInArrow(run, _CONVERTED + more * whole)


def revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record_id, first_id, refers_to) of the records whose payload an earlier page has."""
    able = records.where(F.col("payload_bytes") >= min_bytes)
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record_id")
    firsts = able.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = able.join(firsts, "payload_digest").where(F.col("record_id") != F.col("first.record_id"))
    return later.select("record_id", F.col("first.record_id").alias("first_id"), F.col("first.page_id").alias("refers_to"))


def write_warc(records: DataFrame, seen: DataFrame) -> str:
    """Records of :func:`convert` as WARC files; those in ``seen`` become revisits. The folder's path."""
    joined = records.join(seen, "record_id", "left")

    def run(batches):
        def out():
            for batch in batches:
                for r in batch.to_pylist():
                    block = zlib.decompress(r["block"], 31)
                    fields = {
                        "WARC-Type": r["type"], "WARC-Record-ID": r["record_id"], "WARC-Date": r["date"],
                        "WARC-Target-URI": r["uri"] if r["type"] != "warcinfo" else None,
                        "WARC-IP-Address": r["ip"] if r["type"] == "response" else None,
                        "Content-Type": r["content_type"], "WARC-Payload-Digest": f"sha1:{r['payload_digest']}",
                    }
                    if r["first_id"] is not None:
                        block = split_http(block)[0]
                        fields |= {
                            "WARC-Type": "revisit", "WARC-Refers-To": r["first_id"], "X-Refers-To-Page": r["refers_to"],
                            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        }
                    fields["WARC-Block-Digest"] = f"sha1:{digest(block) if r['first_id'] else r['block_digest']}"
                    yield gzip_member(warc_record(fields, block))

        for pack in _packs(out()):
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.binary())], names=["pack"])

    return _write(joined.mapInArrow(run, "pack binary"), "warc")


def read_back(warcs: DataFrame) -> DataFrame:
    """Pages of WARC files (path, content), their digests checked against the blocks."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, uri string, date string"

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for fields, block in read_warc(content.as_buffer().to_pybytes()):
                    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
                        raise ValueError(f"{fields['warc-record-id']}: the block doesn't have its digest")
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    want = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and want != digest(payload):
                        raise ValueError(f"{fields['warc-record-id']}: the payload doesn't have its digest")
                    page, refers = http_field(head, "X-Page-Id"), fields.get("x-refers-to-page")
                    size = len(payload) if kind == "response" else int(http_field(head, "Content-Length"))
                    rows.append([int(page) if page else None, size, want, kind, int(refers) if refers else None,
                                 fields["warc-record-id"], fields["warc-target-uri"], fields["warc-date"]])
                names = schema.replace(",", " ").split()
                columns = list(zip(*rows, strict=True)) or [[] for _ in names[::2]]
                types = [{"long": pa.int64(), "string": pa.string()}[t] for t in names[1::2]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names[::2])

    return warcs.mapInArrow(run, schema)


def pages_through_archives(pages: DataFrame, version: int = 1, min_bytes: int = 0) -> DataFrame:
    """Pages -> ARC files -> WARC files -> what a reader of the WARC files finds."""
    spark = pages.sparkSession
    arcs = _files(spark, write_arc(pages, version=version))
    seen = revisits(materialize(convert(arcs, whole=False), "records"), min_bytes)
    return read_back(_files(spark, write_warc(convert(arcs), seen)))
