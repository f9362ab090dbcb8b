"""Legacy archive conversion: ARC files in, WARC files out.

An ARC file is a version block and then records: a header line whose fields depend on the version
(1: five fields, 2: ten), the declared number of bytes, a newline. ``parse_arc`` reads those lines and
lengths, ``warc_record`` gives a record the identifier, timestamp, type and digest that WARC asks for.
Both kinds of archives are files in the shared folder of many records and at most FILE_BYTES or one record;
tasks make their bytes, the data source of ``sources/files.py`` writes them, Spark's reader reads them. Every WARC record is a gzip member of its own, so
that readers can seek to it. Payloads are bytes throughout: no encoding is assumed.

Which records are revisits is settled on (digest, identifiers) alone. Payloads are not shuffled: the task that parses an
ARC file writes its WARC records, and looks its revisits up in a small file of their own.

Cases: null html counts as empty, a null url becomes ``unknown:``; a page_id of null stays null; of
equal payloads all rows with the smallest page_id are responses (a repeated row is no revisit of
itself); a record that can't be read, or whose bytes are missing, is a row with an ``error`` that says how much
of its file was left unread; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import opened, write_files
from .skew import spread
from .storage import new_path, stored

SMALLEST_REVISIT = 100
#: Bytes of an archive file from which on the next record opens another.
FILE_BYTES = 8 << 20
VERSIONS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file by header line and declared length, with ``at``, the place of the header line."""
    first = data.find(b"\n")
    head = data[: max(first, 0)].decode("latin-1").split(" ")
    if first < 0 or not head[0].startswith("filedesc:") or not head[-1].isdigit():
        raise ValueError("no version block")
    block = data[first + 1 : first + 1 + int(head[-1])]
    fields = VERSIONS.get(block.split(b" ", 1)[0].decode("latin-1"))
    if fields is None:
        raise ValueError("unknown version")
    at = first + 1 + int(head[-1]) + 1
    while at < len(data):
        stop = data.find(b"\n", at)
        line = data[at : stop if stop >= 0 else len(data)].decode("utf-8", "replace")
        if not line.strip():
            at = (stop if stop >= 0 else len(data)) + 1
            continue
        # a URL may hold spaces: the other fields are counted from the right
        values = line.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].strip().isdigit() or stop < 0:
            yield {"at": at, "url": line, "body": None, "error": f"bad header line, {len(data) - at} bytes unread"}
            return
        row = dict(zip(fields, values, strict=True)) | {"at": at, "error": None}
        size = int(row["length"])
        body = data[stop + 1 : stop + 1 + size]
        yield row | ({"body": body} if len(body) == size else {"body": None, "error": f"truncated record, {len(body)} of {size} bytes there"})
        at = stop + 1 + size + 1


def arc_head(version: str = "1") -> bytes:
    """The version block that begins an ARC file."""
    names = " ".join({"1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"), "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")}[version])
    block = f"{version} 0 gridwright\n{names}\n\n".encode()
    return f"filedesc://part.arc 0.0.0.0 20000101000000 text/plain {'200 - - 0 part.arc ' if version == '2' else ''}{len(block)}\n".encode() + block + b"\n"


def arc_record(record: tuple[str, str, str, str, bytes], at: int, version: str = "1") -> bytes:
    """A (url, ip, date, type, body) record at this place of its file; version 2 also has status and checksum."""
    url, ip, date, kind, body = record
    middle = f"200 {hashlib.md5(body).hexdigest()} - {at} part.arc " if version == "2" else ""
    return b"".join((f"{url} {ip} {date} {kind} {middle}{len(body)}\n".encode(), body, b"\n"))


def arc_file(records: list[tuple[str, str, str, str, bytes]], version: str = "1") -> bytes:
    out = bytearray(arc_head(version))
    for r in records:
        out += arc_record(r, len(out), version)
    return bytes(out)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, entity); an archived body without a status line is all entity."""
    if body.startswith(b"HTTP/"):
        stop = body.find(b"\r\n\r\n")
        if stop >= 0:
            return body[: stop + 4], body[stop + 4 :]
    return b"", body


def _iso(date: str) -> str:
    d = re.sub(r"\D", "", date or "").ljust(14, "0")[:14]
    d = d if d[4:8] != "0000" else "19700101" + d[8:]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _batch(rows: list[tuple], ddl: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in ddl.split(", ")])


def _named(data: bytes, end: str) -> pa.RecordBatch:
    """A finished file as a row for write_files()."""
    return pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.{end}"]), pa.array([bytes(data)], pa.binary())], ["name", "body"])


def write_arc(pages: DataFrame, path: str, version: Column | None = None, date: Column | None = None, size: int = FILE_BYTES) -> None:
    """Compressed ARC files of pages (page_id, url, html), a gzip member a record. Every task has an open file of each version; a record's HTTP head carries the page's id.

    version: "1" (the default) or "2" for each row; date: fourteen digits, by default the first second of 2020.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_files: dict[str, bytearray] = {}
        plain: dict[str, int] = {}
        for batch in batches:
            for key, url, html, v, when in zip(*batch.columns, strict=True):
                named = b"" if key.as_py() is None else f"X-Page-Id: {key.as_py()}\r\n".encode()
                url = re.sub(r"[\r\n]", "", url.as_py() or "unknown:")
                body = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n" + named + b"\r\n" + (html.as_py() or b"")
                v = v.as_py()
                if v not in open_files:
                    head = arc_head(v)
                    open_files[v], plain[v] = bytearray(gzip.compress(head, 4, mtime=0)), len(head)
                record = arc_record((url, "0.0.0.0", when.as_py(), "text/html", body), plain[v], v)
                open_files[v] += gzip.compress(record, 4, mtime=0)
                plain[v] += len(record)
                if len(open_files[v]) >= size:
                    yield _named(open_files.pop(v), "arc.gz")
        for data in open_files.values():
            yield _named(data, "arc.gz")

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"), (F.lit("1") if version is None else version), (F.lit("20200101000000") if date is None else date))
    write_files(rows.mapInArrow(run, "name string, body binary"), path)


RECORD = "record_id string, page_id long, warc_date string, uri string, http binary, payload binary, payload_bytes long, payload_digest string, error string, file string"
_RECORD = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]


def _arc_rows(file: str, data: bytes) -> Iterator[tuple]:
    """RECORD of each record of a file."""
    for r in _parsed(data):
        head, payload = split_http(r["body"] or b"")
        key = re.search(rb"(?im)^x-page-id: (-?\d+)\r$", head)
        identity = uuid.uuid5(uuid.NAMESPACE_URL, f"{file}#{r['at']}")
        yield (f"<urn:uuid:{identity}>", int(key[1]) if key else None, _iso(r.get("date", "")), r["url"], head, payload, len(payload), hashlib.sha256(payload).hexdigest(), r["error"], file)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files below path with what WARC needs: identifier, timestamp, digest, head and payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(*batch.columns, strict=True):
                rows, size = [], 0
                for row in _arc_rows(file.as_py(), data.as_py() or b""):
                    rows.append(row)
                    size += row[6]
                    if size > 1 << 22:
                        yield _batch(rows, RECORD, _RECORD)
                        rows, size = [], 0
                yield _batch(rows, RECORD, _RECORD)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def _parsed(data: bytes) -> Iterator[dict]:
    """parse_arc() of a file, plain or compressed; what is wrong with the whole file is a row too."""
    try:
        yield from parse_arc(b"".join(members(data)) if data.startswith(b"\x1f\x8b") else data)
    except (ValueError, zlib.error) as e:
        yield {"at": 0, "url": None, "body": None, "error": f"{e}, {len(data)} bytes unread"}


def revisits(records: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """record_id, first, file: of equal payloads of `smallest` bytes or more, those after the first page_id, and what they repeat."""
    good = records.where(F.col("error").isNull() & (F.col("payload_bytes") >= smallest)).select("payload_digest", "page_id", "record_id", "uri", "warc_date", "file")
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "uri", "warc_date")).alias("first")
    groups = stored(good.groupBy("payload_digest").agg(least, F.count("*").alias("n")).where("n > 1"), "digests")
    met = spread(good.select("payload_digest", "page_id", "record_id", "file"), groups, ["payload_digest"], ["record_id"])
    return met.where(F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))).select("record_id", "first", "file")


def warc_record(kind: str, record_id: str, date: str, body: bytes, fields: list[tuple[str, str]], content: str) -> bytes:
    """A record as a gzip member of its own."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields, ("Content-Type", content), ("Content-Length", str(len(body)))]
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + body + b"\r\n\r\n", 4, mtime=0)


def _info(first_id: str) -> bytes:
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, first_id)}>"
    return warc_record("warcinfo", name, "2020-01-01T00:00:00Z", b"software: gridwright\r\nformat: WARC File Format 1.0\r\n", [], "application/warc-fields")


def _warc_files(records: Iterator[tuple], size: int) -> Iterator[pa.RecordBatch]:
    """WARC files as rows for write_files(), of (record_id, page_id, date, uri, http, payload, digest, first)."""
    data = bytearray()
    for name, page, date, uri, http, payload, digest, first in records:
        fields = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}")]
        if first:
            fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", first["record_id"]), ("WARC-Refers-To-Target-URI", first["uri"]), ("WARC-Refers-To-Date", first["warc_date"]), ("X-Refers-To-Page", str(first["page_id"]))]
        if page is not None:
            fields.append(("X-Page-Id", str(page)))
        data = data or bytearray(_info(name))
        data += warc_record("revisit" if first else "response", name, date, http + payload, fields, "application/http;msgtype=response")
        if len(data) >= size:
            yield _named(data, "warc.gz")
            data = bytearray()
    if data:
        yield _named(data, "warc.gz")


def write_warc(records: DataFrame, found: DataFrame, path: str, size: int = FILE_BYTES) -> None:
    """WARC files of the records without errors; found: revisits(). A revisit keeps its payload, so that nothing is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _warc_files((tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(len(b))), size)

    good = records.where("error IS NULL").select("record_id", "page_id", "warc_date", "uri", "http", "payload", "payload_digest")
    write_files(good.join(found.drop("file"), "record_id", "left").mapInArrow(run, "name string, body binary"), path)


def _side_name(file: str) -> str:
    return f"{hashlib.sha256(file.encode()).hexdigest()}.json"


def write_converted(spark: SparkSession, arcs: str, found: DataFrame, path: str, size: int = FILE_BYTES) -> None:
    """The same straight from the ARC files: no payload is shuffled or leaves its task but as a WARC record.

    What is to be said of the revisits of an ARC file lies beside it, a small file in the shared folder that the task opens which parses the archive.
    """
    side = new_path(spark, "revisits")
    lists = found.groupBy("file").agg(F.to_json(F.collect_list(F.struct("record_id", "first"))).alias("list"))
    write_files(lists.select(F.concat(F.sha2("file", 256), F.lit(".json")).alias("name"), F.encode("list", "UTF-8").alias("body")), side)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        system, top = opened(side)
        for batch in batches:
            for file, data in zip(*batch.columns, strict=True):
                try:
                    with system.open_input_stream(f"{top}/{_side_name(file.as_py())}", compression=None) as f:
                        firsts = {x["record_id"]: x["first"] for x in json.loads(f.read())}
                except FileNotFoundError:
                    firsts = {}
                for name, page, date, uri, http, payload, _, digest, error, _ in _arc_rows(file.as_py(), data.as_py() or b""):
                    if error is None:
                        yield name, page, date, uri, http, payload, digest, firsts.get(name)

    archives = spark.read.format("binaryFile").load(arcs).select("path", "content")
    write_files(archives.mapInArrow(lambda batches: _warc_files(records(batches), size), "name string, body binary"), path)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, error string"
_READ = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def members(data: bytes) -> Iterator[bytes]:
    """The contents of the gzip members of a file, one by one."""
    view, at = memoryview(data), 0
    while at < len(view):
        expand, parts = zlib.decompressobj(31), []
        while not expand.eof:
            if at >= len(view):
                raise zlib.error("truncated member")
            step = view[at : at + (1 << 16)]
            parts.append(expand.decompress(step))
            at += len(step) - len(expand.unused_data)
        yield b"".join(parts)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, payload measured and digested from the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                try:
                    rows += (row for m in members(data.as_py()) if m and (row := _described(m)))
                except zlib.error as e:
                    rows.append((*[None] * 7, f"broken member: {e}"))
                yield _batch(rows, READ, _READ)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def _described(record: bytes) -> tuple | None:
    """READ of one record; none for the record about the file."""
    stop = record.find(b"\r\n\r\n")
    head = record[: max(stop, 0)].decode("utf-8", "replace").split("\r\n")
    fields = dict(x.split(": ", 1) for x in head[1:] if ": " in x)
    size = fields.get("Content-Length", "")
    body = record[stop + 4 : -4]
    if not head[0].startswith("WARC/") or not size.isdigit() or len(body) != int(size) or record[-4:] != b"\r\n\r\n":
        return (*[None] * 7, "broken record")
    if fields.get("WARC-Type") == "warcinfo":
        return None
    payload = split_http(body)[1]
    digest = hashlib.sha256(payload).hexdigest()
    wrong = None if fields.get("WARC-Payload-Digest") == f"sha256:{digest}" else "digest differs"
    key, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    return (key and int(key), len(payload), digest, fields.get("WARC-Type"), refers and int(refers), fields.get("WARC-Record-ID"), fields.get("WARC-Refers-To"), wrong)


def convert(spark: SparkSession, arcs: str, warcs: str, size: int = FILE_BYTES) -> DataFrame:
    """All ARC files below the folder arcs become WARC files in the folder warcs; what is there is read back, with a row for each error."""
    # the archives are read twice, which is cheaper than a copy of all payloads
    records = stored(read_arc(spark, arcs).drop("http", "payload"), "records")
    write_converted(spark, arcs, revisits(records), warcs, size)
    none = {x.split()[0]: F.lit(None).cast(x.split()[1]) for x in READ.split(", ")}
    errors = records.where("error IS NOT NULL").select(*(F.col(c) if c in ("page_id", "record_id", "error") else v.alias(c) for c, v in none.items()))
    return read_warc(spark, warcs).unionByName(errors)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as ARC files of both versions, converted to WARC files in the shared folder, read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arcs, F.when(F.col("page_id") % 2 == 0, "2").otherwise("1"))
    return convert(spark, arcs, warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
