"""Legacy ARC archives converted to WARC, and both read back.

Archives are folders of files in the shared folder, each of at most about `file_bytes` compressed bytes (a longer record has a file of its own), and with
one gzip member per record, so that readers can seek. Spark's text writer writes them: a row is a whole file, and the line end it adds is a zero byte, which takes the
place of the last member's last byte (or follows it as padding, where that byte isn't zero). An ARC file's first record
is its version block, which names the fields of the header lines that follow (version 1 has five, version 2
ten); bodies are cut by the declared length alone, so they may hold anything. A WARC file's first record is its warcinfo. Conversion gives each ARC record
a WARC record: the 14-digit date becomes an ISO timestamp, the payload (the HTTP body) gets its base-32 SHA-1,
and the record id is a version-8 UUID made from the page id and a hash of the url, the date and the record's place in the archive. Of records with equal payloads
the one with the smallest page id is a response; the others become revisit records without the payload, which
refer to it. Payloads below min_revisit_bytes are never revisits.

Which record is first for a digest is found by an aggregate of (digest, page id), and joined back to the records' heads alone; a file meets only the list of its own
revisits. So payloads are shuffled by file, compressed, and never by digest.

Defined cases: a null html is an empty payload, a null or empty url is written as "unknown:"; line ends in urls become %0D and %0A, anything else stays; rows with a null page id
are responses and are referred to by none; rows that repeat a page id and payload are all responses, with ids of their own; an empty
table gives empty archives and an empty result; only the three named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shared_folder

#: Compressed bytes of a file; level of compression.
FILE_BYTES, LEVEL = 8 << 20, 4
CAPTURED = "20240102030405"
IP = "192.0.2.1"
#: Bytes of payload that a reader's batch holds before it goes on.
BATCH_BYTES = 8 << 20

# The header fields of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value: the profile of such revisits


# files of gzip members


def bundled(records: Iterator[Callable[[int], bytes]], head: Callable[[int], bytes], file_bytes: int) -> Iterator[bytes]:
    """Files of gzip members; the nth begins with the record head(n), and each record may depend on n too."""
    members, size, n = [], 0, 0
    for record in records:
        member = _member(record(n))
        if members and size + len(member) > file_bytes:
            yield b"".join(members)
            members, size, n = [], 0, n + 1
            member = _member(record(n))
        if not members:
            members.append(_member(head(n)))
        members.append(member)
        size += len(member)
    if members:
        yield b"".join(members)


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def members_of(content: bytes) -> Iterator[bytes]:
    """The members of a gzip file, one at a time; zero bytes between them are padding."""
    view, at = memoryview(content), 0
    while at < len(view):
        if not view[at]:
            at += 1
            continue
        parts, unpacker = [], zlib.decompressobj(31)
        while not unpacker.eof:
            piece = view[at : at + 16_384]
            if not len(piece):
                raise ValueError("the file ends within a gzip member")
            parts.append(unpacker.decompress(piece))
            at += len(piece)
        at -= len(unpacker.unused_data)
        yield b"".join(parts)


def _write(rows: DataFrame, path: str, files_of: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]]) -> None:
    """Every file that files_of() gives for a task's rows becomes a file below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in files_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([content[:-1] if content.endswith(b"\0") else content], pa.binary())], names=["value"])

    files = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    files.write.options(compression="none", lineSep="\0", maxRecordsPerFile=1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of each file below path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(F.col("path").alias("file"), "content")


def _read(spark: SparkSession, path: str, schema: pa.Schema, ddl: str, rows_of: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """Rows of every archive file below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for row in rows_of(file.as_py(), content.as_py()):
                    rows.append(row)
                    held += sum(len(x) for x in row if isinstance(x, bytes)) + 200
                    if held > BATCH_BYTES:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    return _files(spark, path).mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


# ARC


def _version_block(version: int) -> bytes:
    body = f"{version} 0 Archive\n{FIELDS[version]}\n"
    head = f"filedesc://pages.arc 0.0.0.0 {CAPTURED} text/plain" + (" 200 - - 0 pages.arc" if version == 2 else "")
    return f"{head} {len(body)}\n{body}\n".encode()


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """One ARC record per row, files of the two versions by turns. Page ids are whole numbers, or null."""

    def files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        task = TaskContext.get().partitionId()
        version = lambda n: 1 + (task + n) % 2

        def record(page: int | None, address: str, payload: bytes) -> Callable[[int], bytes]:
            named = b"" if page is None else b"X-Page-Id: %d\r\n" % page
            body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%bContent-Length: %d\r\n\r\n%b" % (named, len(payload), payload)
            address = address.replace("\r", "%0D").replace("\n", "%0A")
            more = lambda n: " 200 - - 0 pages.arc" if version(n) == 2 else ""
            return lambda n: f"{address} {IP} {CAPTURED} text/html{more(n)} {len(body)}\n".encode("utf-8", "surrogatepass") + body + b"\n"

        values = (zip(*batch.columns, strict=True) for batch in batches)
        records = (record(p.as_py(), u.as_py() or "unknown:", (h.as_py() or "").encode("utf-8", "surrogatepass")) for rows in values for p, u, h in rows)
        return bundled(records, lambda n: _version_block(version(n)), file_bytes)

    _write(pages.select(page_id, url, html), path, files_of)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its blank line, payload); a body that isn't HTTP is all payload."""
    end = body.find(b"\r\n\r\n") + 4
    return (body[:end], body[end:]) if body.startswith(b"HTTP/") and end > 3 else (b"", body)


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?i)\r\n" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return m and m[1].decode("utf-8", "replace")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def arc_records(members: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by name, body) of each record after the version block, which only a file's first record can be. A member may hold several records."""
    fields: list[str] = FIELDS[1].split()
    is_first = True
    for data in members:
        at = 0
        while at < len(data):
            end = data.index(b"\n", at)
            line = data[at:end].decode("utf-8", "replace")
            at = end + 1
            if not line:
                continue
            n = int(line.rpartition(" ")[2])
            body = data[at : at + n]
            if len(body) < n:
                raise ValueError(f"ARC record of {n} declared bytes ends after {len(body)}")
            at += n
            if is_first and line.startswith("filedesc:"):
                fields = body.split(b"\n")[1].decode().split()
            else:
                values = line.rsplit(" ", len(fields) - 1)
                yield dict(zip(fields, values, strict=True)), body
            is_first = False


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(file, nth, page_id, url, date, mime, n_bytes, payload, digest) of each ARC record; without payloads, that column is null."""
    schema = pa.schema([("file", pa.string()), ("nth", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("digest", pa.string())])

    def rows_of(file: str, content: bytes) -> Iterator[tuple]:
        for nth, (f, body) in enumerate(arc_records(members_of(content))):
            head, payload = split_http(body)
            page = http_field(head, "X-Page-Id")
            yield file, nth, page and int(page), f["URL"], f["Archive-date"], f["Content-type"], len(payload), payload if payloads else None, payload_digest(payload)

    return _read(spark, path, schema, "file string, nth bigint, page_id bigint, url string, date string, mime string, n_bytes bigint, payload binary, digest string", rows_of)


# WARC


def record_id(page: int | None, url: str, date: str, file: str, nth: int) -> str:
    """A version-8 UUID that holds the page id; version 5 (a name's hash alone) where there is none."""
    name = hashlib.sha1(f"{url}|{date}|{file.rpartition('/')[2]}|{nth}".encode("utf-8", "surrogatepass")).hexdigest()  # noqa: S324
    if page is None:
        return f"<urn:uuid:{name[:8]}-{name[8:12]}-5{name[12:15]}-8{name[15:18]}-{name[18:30]}>"
    held = f"{page % (1 << 64):016x}"
    return f"<urn:uuid:{name[:8]}-{name[8:12]}-8{held[0]}{name[12:14]}-8{held[1:4]}-{held[4:]}>"


def page_of(urn: str | None) -> int | None:
    """The page id that record_id() put into an identifier."""
    m = re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8([0-9a-f])[0-9a-f]{2}-8([0-9a-f]{3})-([0-9a-f]{12})>", urn or "")
    if not m:
        return None
    n = int(m[1] + m[2] + m[3], 16)
    return n - (1 << 64) if n >> 63 else n


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _warcinfo(n: int) -> bytes:
    task = TaskContext.get().partitionId()
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, "warcinfo", CAPTURED, str(task), n)), ("WARC-Date", _iso(CAPTURED)), ("Content-Type", "application/warc-fields")]
    return _record(fields, b"format: WARC File Format 1.1\r\ndescription: converted from ARC\r\n")


def revisits_by_file(heads: DataFrame, min_revisit_bytes: int, scratch: Scratch) -> DataFrame:
    """(file, revisits: of each the nth of its record and the head of the first record with that payload). heads: records without payloads."""
    known = heads.where(F.col("page_id").isNotNull() & (F.col("n_bytes") >= min_revisit_bytes)).select("digest", "page_id", "file", "nth", "url", "date")
    of_digest = known.groupBy("digest").agg(F.min(F.struct("page_id", "file", "nth", "url", "date")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = scratch.keep(of_digest.where("n > 1").select("digest", "first"))
    found = known.join(first.hint("merge"), "digest").where("first.page_id < page_id")
    return scratch.keep(found.groupBy("file").agg(F.collect_list(F.struct("nth", "first")).alias("revisits")))  # no more than a file has records


def convert(spark: SparkSession, arc: str, revisits: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the ARC records below arc as WARC files of responses and revisits."""

    def responses(file: str, content: bytes, listed: list[dict] | None) -> Iterator[Callable[[int], bytes]]:
        firsts = {r["nth"]: r["first"] for r in listed or ()}
        for nth, (f, body) in enumerate(arc_records(members_of(content))):
            head, payload = split_http(body)
            page, first = http_field(head, "X-Page-Id"), firsts.get(nth)
            fields = [
                ("WARC-Type", "revisit" if first else "response"),
                ("WARC-Record-ID", record_id(page and int(page), f["URL"], f["Archive-date"], file, nth)),
                ("WARC-Date", _iso(f["Archive-date"])),
                ("WARC-Target-URI", f["URL"]),
                ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
            ]
            if first:
                fields += [
                    ("WARC-Profile", _REVISIT),
                    ("WARC-Refers-To", record_id(first["page_id"], first["url"], first["date"], first["file"], first["nth"])),
                    ("WARC-Refers-To-Target-URI", first["url"]),
                ]
            record = _record([*fields, ("Content-Type", "application/http; msgtype=response")], head if first else body)
            yield lambda _, record=record: record

    def files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        rows = (row for batch in batches for row in zip(*batch.columns, strict=True))
        return bundled((r for row in rows for r in responses(*(x.as_py() for x in row))), _warcinfo, file_bytes)

    _write(_files(spark, arc).join(revisits.hint("merge"), "file", "left").select("file", "content", "revisits"), path, files_of)


def warc_records(members: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each WARC record. A member may hold several records."""
    for data in members:
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError(f"not a WARC record: {lines[0]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            n = int(fields["content-length"])
            yield fields, data[end + 4 : end + 4 + n]
            at = end + 8 + n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_id, record_type, payload_bytes, payload_digest, refers_to) of each response and revisit, digests computed from the payloads that are there."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def rows_of(file: str, content: bytes) -> Iterator[tuple]:
        for f, block in warc_records(members_of(content)):
            if f["warc-type"] not in ("response", "revisit"):
                continue
            head, payload = split_http(block)
            revisit = f["warc-type"] == "revisit"
            n = int(http_field(head, "Content-Length") or 0) if revisit else len(payload)
            stated = f["warc-payload-digest"].partition(":")[2]
            if not revisit and payload_digest(payload) != stated:
                raise ValueError(f"{f['warc-record-id']}: the payload's digest isn't {stated}")
            yield page_of(f["warc-record-id"]), f["warc-target-uri"], f["warc-record-id"], f["warc-type"], n, stated, page_of(f.get("warc-refers-to"))

    return _read(spark, path, schema, "page_id bigint, url string, record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint", rows_of)


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages through ARC and WARC archives in the shared folder, as read_warc() gives them."""
    spark, folder = pages.sparkSession, shared_folder(pages.sparkSession)
    scratch = Scratch(spark)
    write_arc(pages, f"{folder}/arc", page_id, url, html, file_bytes)
    heads = scratch.keep(read_arc(spark, f"{folder}/arc", payloads=False).drop("payload"))
    convert(spark, f"{folder}/arc", revisits_by_file(heads, min_revisit_bytes, scratch), f"{folder}/warc", file_bytes)
    scratch.drop_all_but()
    scratch.remove(f"{folder}/arc")
    return read_warc(spark, f"{folder}/warc")
