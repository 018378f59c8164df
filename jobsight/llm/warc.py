"""Web archives (WARC 1.1): a writer that marks revisits, and a reader that salvages damaged files.

Writing: of the pages with equal payloads of at least ``LEAST`` bytes one becomes a response
record, the others become revisit records that carry its HTTP headers and its digest but not its
payload. Each record is a gzip member of its own. A task streams its rows into files of about
``FILE_BYTES``; a file gets its name when it is whole, and names are fixed, so a task that runs
again replaces its files.

Reading: a record has to pass all checks: the gzip member ends with the right CRC and length, the
version line and the headers can be read, the block has its Content-Length and is followed by two
line ends, no header of a record's
own is there twice, and the SHA-1 digests of block and payload, where given, are those of the bytes. After
a failed check the reader searches on, byte by byte, for the next gzip member or version line
whose record passes all checks, gives a row for the gap (file, first byte, byte after the last,
the check that failed) and goes on behind it. Compressed and plain records are both read, also
in one file. In a plain file a damaged record is searched too, so a whole record inside its
payload is taken as one. A file is read by one task, one record at a time.

Which payloads are equal is decided by SHA-256 and length. Of equal payloads the largest page_id
is the response.

Edge cases: a null payload counts as empty; a null page_id is smaller than any; of rows with
the same payload and the largest page_id, the one with the largest url is the response (null is
the smallest), of the same rows any one; a null url is written as ``urn:none``, and white space
and control characters of a url are percent-coded; an empty table writes no file and gives an empty
result; other columns are not read; the longest record must fit a task's memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from jobsight.session import scratch_path, stage

from .text import arrow_schema

#: Payloads of fewer bytes are always written whole.
LEAST = 1000
#: Bytes of a file after which a task begins the next.
FILE_BYTES = 256 << 20
#: Longest headers of a record, and longest record.
HEAD_BYTES, MOST = 1 << 16, (1 << 31) - 1
SALTS = 16
LEVEL = 6
#: The date of records where none is given.
DATE = "2000-01-01T00:00:00Z"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:jobsight:page")
# Fixed texts of the format.
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/\d\.\d+\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d")
_END = b"\r\n\r\n"
_ONCE = {"warc-type", "warc-record-id", "warc-date", "content-length"}
_WRITTEN = "name string, records long, bytes long"
RECORD = (
    "file string, start long, stop long, record_type string, reason string, record_id string, page_id long, uri string, "
    "payload_bytes long, payload_digest string, refers_to long, refers_to_id string, payload binary"
)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, *more: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '|'.join(map(str, (page_id, digest, *more))))}>"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), url) if url else "urn:none"


def make_record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record, not compressed."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in lines if value is not None) + "\r\n"
    return head.encode() + block + _END


def page_record(row: dict, own_id: str, date: str = DATE) -> bytes:
    """The record of a row (page_id, url, payload, is_revisit, keep_id, keep_url)."""
    payload, digest = row["payload"], _sha1(row["payload"])
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", own_id), ("WARC-Date", date), ("WARC-Target-URI", _uri(row["url"])), ("WARC-Payload-Digest", digest),
        ("Content-Type", "application/http;msgtype=response"), ("X-Page-Id", row["page_id"]),
    ]
    if not row["is_revisit"]:
        return make_record("response", headers, block + payload)
    headers += [
        ("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(row["keep_id"], digest)),
        ("WARC-Refers-To-Target-URI", _uri(row["keep_url"])), ("X-Refers-To-Page-Id", row["keep_id"]),
    ]
    return make_record("revisit", headers, block)


def member(record: bytes, level: int = LEVEL) -> bytes:
    """A record as a gzip member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class Writer:
    """Writes one file of records; ``close`` gives it its name."""

    def __init__(self, folder: str, name: str) -> None:
        self._fs, root = _opened(folder)
        self._fs.create_dir(root, recursive=True)
        self.name, self._path, self._tried = name, f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self._file, self.records, self.size = self._fs.open_output_stream(self._tried), 0, 0
        info = [("WARC-Record-ID", record_id(None, name)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
        self.add(make_record("warcinfo", info, b"format: WARC File Format 1.1\r\n"))

    def add(self, record: bytes) -> None:
        data = member(record)
        self._file.write(data)
        self.records, self.size = self.records + 1, self.size + len(data)

    def close(self) -> dict:
        self._file.close()
        self._fs.move(self._tried, self._path)
        return {"name": self.name, "records": self.records, "bytes": self.size}


def with_revisits(pages: DataFrame, least: int = LEAST, salts: int = SALTS) -> DataFrame:
    """(page_id, url, payload, is_first, is_revisit, keep_id, keep_url) of every page.

    Groups are counted on ids and digests alone. A digest may hold a third of all rows, so rows
    meet the groups under ``salts`` keys a digest; only groups of two rows or more are joined."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = keyed.withColumn("_key", F.when(F.length("payload") >= least, F.concat(F.sha2("payload", 256), F.length("payload").cast("string"))))
    ids = keyed.where(F.col("_key").isNotNull()).groupBy("_key", "page_id").agg(F.count(F.lit(1)).alias("n"), F.max("url").alias("url"))
    best = ids.groupBy("_key").agg(F.sum("n").alias("rows"), F.max(F.struct("page_id", "n", "url")).alias("top"))
    groups = stage(best.where(F.col("rows") > 1).select(
        "_key", F.col("top.page_id").alias("keep_id"), F.col("top.n").alias("ties"), F.col("top.url").alias("keep_url")), "page_copies")
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    every = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # The groups grow with the pages, so they are dealt at every size and never sent to all.
    joined = salted.join(every.hint("shuffle_hash"), ["_key", "_salt"], "left")
    own = F.col("page_id").eqNullSafe(F.col("keep_id"))
    columns = ["page_id", "url", "payload", F.col("is_first"), (F.col("ties").isNotNull() & ~F.col("is_first")).alias("is_revisit"), "keep_id", "keep_url"]
    shared = F.coalesce(F.col("ties") > 1, F.lit(False)) & own
    out = joined.where(~shared).withColumn("is_first", F.col("ties").isNotNull() & own).select(*columns)
    if groups.where(F.col("ties") > 1).isEmpty():
        return out
    # Rows that share payload and id: one of those with the largest url is the response.
    same = joined.where(shared).groupBy("_key", "page_id", "url", "keep_id", "keep_url", "ties").agg(F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload"))
    each = same.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    first = F.col("url").eqNullSafe(F.col("keep_url")) & (F.col("_copy") == 1)
    return out.unionByName(each.withColumn("is_first", first).select(*columns))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write a record per page (page_id, url, html) and return the table of files (name, records, bytes)."""
    rows = with_revisits(pages, least).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, made, place = None, 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if writer is None:
                        writer = Writer(folder, f"part-{row['part']:06d}-{made:04d}.warc.gz")
                    digest = _sha1(row["payload"])
                    own = record_id(row["page_id"], digest) if row["is_first"] else record_id(row["page_id"], digest, row["part"], place)
                    writer.add(page_record(row, own, date))
                    place += 1
                    if writer.size >= file_bytes:
                        yield pa.RecordBatch.from_pylist([writer.close()], schema=arrow)
                        writer, made = None, made + 1
        if writer is not None:
            yield pa.RecordBatch.from_pylist([writer.close()], schema=arrow)

    arrow = arrow_schema(pages, _WRITTEN)
    # Written, so that the archives are there, once, before anything reads them.
    return stage(rows.mapInArrow(run, _WRITTEN), "archives")


class Broken(Exception):
    """A record that fails a check."""


class Source:
    """Bytes of an open file, read in runs that are kept while they are near."""

    RUN = 1 << 20

    def __init__(self, file) -> None:
        self._file, self.size, self._at, self._data = file, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``, fewer at the end of the file."""
        inside = at - self._at
        if inside < 0 or inside + n > len(self._data):
            self._at, self._data = at, self._file.read_at(max(0, min(max(n, self.RUN), self.size - at)), at)
            inside = 0
        return self._data[inside:inside + n]

    def starts(self, at: int) -> Iterator[int]:
        """Where a record may begin, from ``at`` on."""
        while at < self.size:
            run = self.read(at, self.RUN)
            yield from (at + found.start() for found in _START.finditer(run))
            at += max(1, len(run) - 5) if at + len(run) < self.size else len(run)


def _unpacked(source: Source, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a place, and the byte after it."""
    unpack, out, size, n = zlib.decompressobj(31), [], 0, 1 << 14
    while not unpack.eof:
        data = source.read(at, n)
        if not data:
            raise Broken("truncated member")
        try:
            out.append(unpack.decompress(data, MOST))
        except zlib.error as error:
            raise Broken(f"damaged member: {error}") from None
        size += len(out[-1])
        if size > MOST or unpack.unconsumed_tail:
            raise Broken("member too long")
        at, n = at + len(data), 1 << 18
    return b"".join(out), at - len(unpack.unused_data)


def _checked(what: str, named: str | None, data: bytes) -> None:
    """Compare a SHA-1 digest, base 32 or hexadecimal; other algorithms are not checked."""
    if named and named.lower().startswith("sha1:"):
        value, digest = named[5:].strip(), hashlib.sha1(data)
        if value.lower() != digest.hexdigest() and value.upper() != base64.b32encode(digest.digest()).decode():
            raise Broken(f"{what} digest differs")


def _headers(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in data.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("header without a colon")
        name = name.strip().lower()
        if name in out and name in _ONCE:  # a cut record's headers run on into the next record's
            raise Broken(f"header {name} twice")
        out.setdefault(name, value.strip())
    return out


def _whole(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


def _hex(named: str | None) -> str | None:
    """The digest of a SHA-1 header as lower-case hexadecimal."""
    value = named[5:].strip() if named and named.lower().startswith("sha1:") else ""
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


def _head(data: bytes) -> tuple[dict[str, str], int, int]:
    """Headers of the record that some bytes begin with, where its block begins and its length."""
    version = _VERSION.match(data)
    if not version:
        raise Broken("no version line")
    end = data.find(_END, version.end() - 2, HEAD_BYTES)
    if end < 0:
        raise Broken("headers without an end")
    headers = _headers(data[version.end():end]) if end > version.end() else {}
    length = _whole(headers.get("content-length"))
    if length is None or length < 0:
        raise Broken("no Content-Length")
    return headers, end + 4, length


def _record(headers: dict[str, str], block: bytes) -> dict:
    """A record whose framing is right; its digests are checked here."""
    _checked("block", headers.get("warc-block-digest"), block)
    kind, payload, told = headers.get("warc-type", ""), block, None
    if headers.get("content-type", "").startswith("application/http"):
        end = block.find(_END)
        if end < 0:
            raise Broken("HTTP headers without an end")
        told = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", block[:end])
        payload = block[end + 4:]
    named = headers.get("warc-payload-digest")
    if kind == "revisit":  # the payload lies in the record that this one refers to
        size, digest, payload = (int(told[1]) if told else None), _hex(named), None
    else:
        _checked("payload", named, payload)
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return {
        "record_type": kind, "record_id": headers.get("warc-record-id"), "page_id": _whole(headers.get("x-page-id")),
        "uri": headers.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
        "refers_to": _whole(headers.get("x-refers-to-page-id")), "refers_to_id": headers.get("warc-refers-to"), "payload": payload,
    }


def read_record(source: Source, at: int) -> tuple[dict, int]:
    """The record at a place and the byte after it; raises ``Broken`` if a check fails."""
    if source.read(at, 2) == b"\x1f\x8b":
        data, stop = _unpacked(source, at)
        headers, start, length = _head(data)
        if len(data) != start + length + 4 or data[start + length:] != _END:
            raise Broken("Content-Length does not fit the member")
        return _record(headers, data[start:start + length]), stop
    headers, start, length = _head(source.read(at, HEAD_BYTES))
    stop = at + start + length + 4
    if stop > source.size:
        raise Broken("truncated record")
    if source.read(stop - 4, 4) != _END:
        raise Broken("Content-Length does not fit the record")
    return _record(headers, source.read(at + start, length)), stop


def salvage(source: Source) -> Iterator[dict]:
    """All records that pass the checks, in order, and a ``gap`` for all bytes between them."""
    at = 0
    while at < source.size:
        start, reason = at, None
        try:
            found = read_record(source, at)
        except Broken as failed:
            reason, found = str(failed), None
            for place in source.starts(at + 1):
                try:
                    found = read_record(source, place)
                except Broken:
                    continue
                at = place
                break
            yield {"start": start, "stop": at if found else source.size, "record_type": "gap", "reason": reason}
            if not found:
                return
        yield {"start": at, "stop": found[1], **found[0]}
        at = found[1]


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps (``RECORD``) of the files named in ``files``; a gap has ``record_type``
    'gap' and the failed check as ``reason``. Without ``payloads`` they are checked but not returned."""
    schema = RECORD if payloads else RECORD.removesuffix(", payload binary")
    spread = files.select("name").repartition(max(1, files.count()), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, root = _opened(folder)
                with fs.open_input_file(f"{root}/{name}") as file:
                    out, size = [], 0
                    for row in salvage(Source(file)):
                        if not payloads:
                            row.pop("payload", None)
                        out.append({"file": name, **row})
                        size += len(row.get("payload") or b"") + 200
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(out, schema=arrow)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = arrow_schema(files, schema)
    return spread.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the pages below the shared folder and read the archives back, one row per page."""
    folder = scratch_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    read = read_archives(write_archives(pages, folder, least), folder, payloads=False)
    told = read.where(F.col("record_type").isin("response", "revisit"))
    return told.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in DuckDB.
SQL = """
    SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
           CASE WHEN octet_length(encode(h)) >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN octet_length(encode(h)) >= 1000 AND place > 1 THEN keep_id END AS refers_to
    FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep_id,
                 row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place
          FROM pages)
"""
