"""WARC records in ZIP-packaged archives, written by tasks and read back by byte ranges.

An archive is a ZIP file with stored (uncompressed) members: archive/data.warc.gz, one gzip member per WARC record, and
indexes/index.cdxj, a line per record with its place in the data member. The reader parses the end record, the ZIP64
records and the central directory from the file's tail, locates the members, reads the index and then ranges of records; it never
unpacks or reads a whole archive. Files are opened with pyarrow's file systems, by URI.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, tidy, written

#: Payloads of fewer bytes are never made revisits.
REVISIT_BYTES = 1000
#: An archive that has reached this size is closed and the task begins another,
ARCHIVE_BYTES = 1 << 30
#: and about this much is read at once.
#: Tasks that read ranges, at most, for each shuffle partition.
TASKS_A_PARTITION = 16
RANGE_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# Records


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(data: bytes) -> dict:
    """What one WARC record says; a response's payload is checked against its length and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = _fields(http_head)
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != int(http["content-length"]) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"a damaged record: {fields.get('warc-record-id')}")
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


# The ZIP directory


def _range(file, start: int, length: int) -> bytes:
    file.seek(start)
    return file.read(length)


def directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """Member name -> (offset of its local header, stored size, compression method), from the central directory."""
    tail_size = min(size, 65_557 + 20)
    tail = _range(file, size - tail_size, tail_size)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end record: not a ZIP archive")
    count, length, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
    locator = at - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        where = struct.unpack("<Q", tail[locator + 8 : locator + 16])[0]
        end64 = _range(file, where, 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is missing")
        count, length, offset = struct.unpack("<QQQ", end64[32:56])
    central, at, found = _range(file, offset, length), 0, {}
    for _ in range(count):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a damaged central directory")
        method = struct.unpack("<H", central[at + 10 : at + 12])[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", central[at + 20 : at + 34])
        header = struct.unpack("<I", central[at + 42 : at + 46])[0]
        name = central[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = central[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:  # ZIP64: 8 bytes for each field that is full, in this order
                values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        found[name] = (header, packed, method)
        at += 46 + n_name + n_extra + n_comment
    return found


def stored_range(file, entry: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes lie: (offset, length)."""
    header, length, method = entry
    if method != zipfile.ZIP_STORED:
        raise ValueError("the member is compressed; only stored members can be read by range")
    local = _range(file, header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("a damaged local header")
    n_name, n_extra = struct.unpack("<HH", local[26:30])
    return header + 30 + n_name + n_extra, length


# Spark jobs


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a WARC record per row and returns the archives written: path, length, records.

    Null html is an empty payload; null ids and urls are left empty. Of records with equal payloads of at least REVISIT_BYTES bytes those with the largest id are responses and the
    others revisit it. Names carry a random part and only the archives of tasks that succeeded are returned, so a task that runs again does no harm.
    """
    spark = pages.sparkSession
    folder = _qualified(spark, folder)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    repeated = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1 AND response IS NOT NULL").select("digest", "response")
    repeated = written(repeated, "payloads")  # its size is known now, so Spark broadcasts it only if it is small
    told = rows.join(repeated, "digest", "left").select("id", "url", "payload", "digest", F.when(F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))

    def run(batches):
        archive = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for page_id, url, payload, digest, refers_to in zip(*(part[c].to_pylist() for c in ("id", "url", "payload", "digest", "refers_to"))):
                    archive = archive or _Archive(folder)
                    archive.add(_member(record(page_id, url, payload, digest, refers_to, refers_to is not None)), page_id)
                    if archive.size >= archive_bytes:
                        yield archive.close()
                        archive = None
        if archive:
            yield archive.close()

    return written(told.mapInArrow(tidy(run), "path string, length long, records long"), "archives")


class _Archive:
    """One archive in writing. The stream is never sought back, so any file system will do."""

    def __init__(self, folder: str):
        self.path = f"{folder}/pages-{uuid.uuid4().hex}.wacz"
        self.system, path = _open(self.path)
        self.system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = self.system.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Forward(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, packed: bytes, page_id: int | None) -> None:
        self.data.write(packed)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> pa.RecordBatch:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        length = self.out.tell()
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([length]), pa.array([len(self.index)])], ["path", "length", "records"])


class _Forward:
    """A stream that zipfile must not seek in."""

    def __init__(self, out):
        self.write, self.flush = out.write, lambda: None


def find_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """path and length of the archives that a path pattern names; contents aren't read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


def read_records(archives: DataFrame) -> DataFrame:
    """The records of archives (path, length): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (of responses).

    Indexes are read first and cut into ranges of about RANGE_BYTES; the ranges are dealt out anew, so one large archive is read by many tasks. An archive without
    records gives no rows; a damaged archive or record is an error.
    """

    def ranges(batches):
        for batch in batches:
            for uri, size in zip(batch["path"].to_pylist(), batch["length"].to_pylist()):
                system, path = _open(uri)
                with system.open_input_file(path) as file:
                    members = directory(file, size)
                    start, _ = stored_range(file, members[DATA])
                    lines = _range(file, *stored_range(file, members[INDEX])).splitlines()
                begin, lengths, total = None, [], 0
                for place in map(json.loads, lines):
                    begin = place["offset"] if begin is None else begin
                    lengths.append(place["length"])
                    total += place["length"]
                    if total >= RANGE_BYTES:
                        yield _one_range(uri, start + begin, lengths)
                        begin, lengths, total = None, [], 0
                if lengths:
                    yield _one_range(uri, start + begin, lengths)

    def records(batches):
        for batch in batches:
            for uri, start, lengths in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), batch["lengths"].to_pylist()):
                system, path = _open(uri)
                with system.open_input_file(path) as file:
                    data = _range(file, start, sum(lengths))
                at, rows = 0, []
                for n in lengths:
                    rows.append(parse_record(zlib.decompress(data[at : at + n], 31)))
                    at += n
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 500], _RECORDS)

    places = archives.select("path", "length").mapInArrow(tidy(ranges), "path string, start long, lengths array<long>")
    # The rows of ranges are small, what they name isn't: a number of partitions by the bytes to be read, which Spark doesn't coalesce.
    total = archives.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-total // RANGE_BYTES), TASKS_A_PARTITION * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return places.repartition(tasks, "path", "start").mapInArrow(tidy(records), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _one_range(uri: str, start: int, lengths: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([start]), pa.array([lengths], pa.list_(pa.int64()))], ["path", "start", "lengths"])


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives to the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    archives = write_archives(pages, new_folder(pages.sparkSession, "warc"), id_col, url_col, html_col)
    return read_records(archives).select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
