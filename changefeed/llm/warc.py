"""Converting legacy ARC archives to WARC.

Pages become ARC archives first (versions 1 and 2), the archives are converted, and the WARC archives are
read back. The converter reads the version block of an archive for the names of the header fields, takes each record's
declared length, and makes what ARC lacks: record ids (from the record's place, so a repeated task makes
the same), ISO timestamps, record types and SHA-1 digests.

Of records with equal payloads the first by page id stays a response; the others become revisits that refer to it. Which
is first is one aggregate over digests. Archives hold about ``ARCHIVE_BYTES``, one file each, and are read and written whole by
one task; only names, places and digests of records are shuffled, with the compressed archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changefeed.session import shared_dir

ARCHIVE_BYTES, LEVEL = 8 << 20, 3
READ_BYTES = 1 << 13
CRAWLED = "20240101000000"
# The header fields of the two versions of ARC.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def member(data: bytes) -> bytes:
    """One gzip member; archives are members in a row, so any record can be read alone."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(archive: bytes) -> Iterator[bytes]:
    """What each member holds; bytes after the last member are padding."""
    view, at = memoryview(archive), 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof and at < len(view):  # in short pieces, as the reader copies what follows a member
            piece = view[at : at + READ_BYTES]
            parts.append(reader.decompress(piece))
            at += len(piece) - len(reader.unused_data)
        yield b"".join(parts)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_field(text: str | None) -> str:
    """A text as a header field: no spaces, control characters or lone surrogates; "-" for nothing."""
    raw = (text or "").encode("utf-8", "replace")
    return "".join(chr(b) if 33 <= b < 127 else f"%{b:02X}" for b in raw) or "-"


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 changefeed\n{FIELDS[version]}\n".encode()
    rest = f"{len(body)}" if version == 1 else f"200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} 0.0.0.0 {CRAWLED} text/plain {rest}\n".encode() + body + b"\n"


def http_response(page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_record(version: int, name: str, offset: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    body = http_response(page_id, payload)
    middle = "" if version == 1 else f"200 - - {offset} {name} "
    return f"{one_field(url)} 0.0.0.0 {CRAWLED} text/html {middle}{len(body)}\n".encode() + body + b"\n"


def parse_arc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and block of each record after the version block.

    The version block tells the fields' names; lengths are those declared, whatever the block looks like.
    """
    names: list[str] = []
    for record in members(archive):
        line, _, rest = record.partition(b"\n")
        values = line.decode("ascii").split(" ")
        block = rest[: int(values[-1])]
        if len(block) != int(values[-1]):
            raise ValueError(f"a record of {len(block)} bytes declares {values[-1]}")
        if not names:
            version, fields = block.split(b"\n")[:2]
            names = fields.decode("ascii").split(" ")
            if FIELDS.get(int(version.split(b" ")[0])) != fields.decode("ascii"):
                raise ValueError("not an ARC archive of a known version")
        else:
            yield dict(zip(names, values, strict=True)), block


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return dict(x.split(": ", 1) for x in lines), head + b"\r\n\r\n", payload


def record_id(page_id: int | None, name: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{name}/{place}')}>"


def warc_record(fields: dict[str, str], block: bytes, name: str, place: int, refers: tuple | None) -> bytes:
    """``refers``: page id, archive and place of the response that a revisit refers to."""
    http, head, payload = split_http(block)
    page = int(http["X-Page-Id"]) if "X-Page-Id" in http else None
    d = fields["Archive-date"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {record_id(page, name, place)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers:
        lines += [f"WARC-Refers-To: {record_id(*refers)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers[0]}"]
        block = head
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for record in members(archive):
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError("a block does not match its digest")
        yield fields, block


def _save(archives: DataFrame, path: str) -> None:
    """One file for each row's bytes. The line end that the writer adds is zero padding, which gzip allows."""
    (
        archives.select(F.col("archive").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("lineSep", "\0")
        .text(path)
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each archive; a folder without any gives no rows."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Pack pages (page_id, url, html) in ARC archives, versions in turn. Null html is an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = made = 0
        for b in batches:
            columns = (b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").cast(pa.binary()))
            for page_id, url, html in zip(*columns):
                version, payload = 1 + made % 2, html.as_py() or b""
                name = f"part-{made}.arc.gz"
                if not parts:
                    parts.append(member(arc_version_block(version, name)))
                    offset = len(parts[0])
                parts.append(member(arc_record(version, name, offset, page_id, url, payload)))
                offset += len(parts[-1])
                size += len(payload) + len(parts[-1])  # many empty payloads fill an archive as well
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])
                    parts, size, made = [], 0, made + 1
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    _save(picked.mapInArrow(run, "archive binary"), path)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def arc_payloads(archives: DataFrame) -> DataFrame:
    """path, place, page_id, payload_digest and payload_bytes of each ARC record."""
    kinds = (("place", pa.int64()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, archive in zip(b.column("path").to_pylist(), b.column("content")):
                rows = []
                for place, (_, block) in enumerate(parse_arc(archive.as_py())):
                    http, _, payload = split_http(block)
                    rows.append((place, int(http["X-Page-Id"]) if "X-Page-Id" in http else None, digest(payload), len(payload)))
                columns = zip(*rows) if rows else [()] * 4
                arrays = [pa.array([path] * len(rows), pa.string()), *[pa.array(c, t) for c, (_, t) in zip(columns, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, ["path", *[k for k, _ in kinds]])

    return archives.mapInArrow(run, "path string, place long, page_id long, payload_digest string, payload_bytes long")


def convert(archives: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a WARC archive for each ARC archive (path, content)."""
    found = arc_payloads(archives)
    able = found.where(F.col("payload_bytes") >= least_bytes)
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "path", "place")
    firsts = able.groupBy("payload_digest", "payload_bytes").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = able.join(firsts, ["payload_digest", "payload_bytes"]).where(place > F.col("first"))
    of_archive = later.groupBy("path").agg(
        F.collect_list(F.struct("place", F.col("first.page_id").alias("page"), F.col("first.path").alias("other"), F.col("first.place").alias("at"))).alias("again")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, archive, again in zip(b.column("path").to_pylist(), b.column("content"), b.column("again").to_pylist()):
                refers = {x["place"]: (x["page"], _name(x["other"]), x["at"]) for x in again or []}
                parts = [
                    member(warc_record(fields, block, _name(own), i, refers.get(i)))
                    for i, (fields, block) in enumerate(parse_arc(archive.as_py()))
                ]
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])

    _save(archives.join(of_archive, "path", "left").select("path", "content", "again").mapInArrow(run, "archive binary"), path)


def records(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each WARC record."""
    kinds = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column("content"):
                rows = []
                for fields, block in parse_warc(archive.as_py()):
                    http, _, payload = split_http(block)
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and len(payload) != int(http["Content-Length"]):
                        raise ValueError("a payload does not have the length that its record says")
                    page = int(http["X-Page-Id"]) if "X-Page-Id" in http else None
                    to = fields.get("X-Refers-To-Page", "None")
                    rows.append((page, int(http["Content-Length"]), said, fields["WARC-Type"], None if to == "None" else int(to)))
                columns = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [k for k, _ in kinds])

    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def converted(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC archives say.

    Repeated rows are records of their own; of equal payloads under one page id the first record stays a response. A
    page without id comes after all others. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc, warc = shared_dir(spark, "llm-arc"), shared_dir(spark, "llm-warc")
    write_arc(pages, arc)
    convert(read_archives(spark, arc), warc, least_bytes)
    return records(read_archives(spark, warc))
