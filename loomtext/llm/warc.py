"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame a record."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.columns import fields
from loomtext.llm.files import new_file, open_file
from loomtext.plans.runtime import fresh_path, materialise, shuffle_partitions

DICT_FRAME, ZSTD_FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
#: A file's dictionary comes from so many of its first records and bytes at most.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 256, 4 << 20, 16 << 10
#: A file is closed once it holds so many bytes.
ROLL = 256 << 20
CHUNK = 1 << 18
#: Groups of equal payloads up to this number (about 100 bytes each) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 50_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c > "\x1f" and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, place: str) -> bytes:
    """One response or revisit record; a revisit's block keeps the HTTP header and no payload."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http if revisit else http + payload
    name = f"{page_id}|{digest}|{place}" if revisit else f"{page_id}|{digest}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, name)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(SPACE, f'{refers_to}|{digest}')}>"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def type(self) -> str:
        return self.headers["warc-type"]

    def http(self) -> tuple[dict[str, str], bytes]:
        """The HTTP message's headers and payload."""
        head, found, payload = self.block.partition(b"\r\n\r\n")
        status, *lines = head.decode("latin-1").split("\r\n")
        if not found or not status.startswith("HTTP/"):
            raise ValueError("the block is no HTTP message")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def parse_record(data: bytes) -> Record:
    """A record from the content of its frame; ValueError unless version, headers, lengths and digests are right."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not found or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header {line!r}")
        headers[name.lower()] = value.strip()
    if missing := [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in headers]:
        raise ValueError(f"headers are missing: {missing}")
    if not headers["content-length"].isdecimal():
        raise ValueError("malformed Content-Length")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, the frame holds {len(rest) - 4}")
    record = Record(headers, rest[:n])
    if (want := headers.get("warc-block-digest")) and want != f"sha1:{payload_digest(record.block)}":
        raise ValueError("the block digest differs")
    if record.type == "response" and (want := headers.get("warc-payload-digest")):
        http, payload = record.http()
        if want != f"sha1:{payload_digest(payload)}" or http.get("content-length", str(len(payload))) != str(len(payload)):
            raise ValueError("the payload's digest or length differs")
    return record


def train_dictionary(samples: list[bytes]) -> bytes | None:
    """A dictionary for such records; None where they are too few or too alike for one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Writes the dictionary's skippable frame, then a frame for each record."""

    def __init__(self, out, dictionary: bytes | None):
        self.out, self.size, self.records = out, 0, 0
        if dictionary is not None:
            self.size += out.write(struct.pack("<II", DICT_FRAME, len(dictionary)) + dictionary) or 0
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def add(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1


def read_archive(file) -> Iterator[Record]:
    """Records of an open archive, one frame at a time; the file is read in small parts."""
    data = file.read(8)
    decompressor = zstandard.ZstdDecompressor()
    if len(data) == 8 and struct.unpack("<II", data)[0] == DICT_FRAME:
        content = file.read(n := struct.unpack("<II", data)[1])
        if len(content) != n:
            raise ValueError("the dictionary frame is cut short")
        if content[:4] == ZSTD_FRAME:
            content = zstandard.ZstdDecompressor().decompress(content)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        data = b""
    number = 0
    while data or (data := file.read(CHUNK)):
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := file.read(CHUNK)):
                raise ValueError(f"record {number}: the frame is cut short")
        try:
            yield parse_record(b"".join(parts))
        except ValueError as error:
            raise ValueError(f"record {number}: {error}") from None
        number += 1


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()

    def records() -> Iterator[bytes]:
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for row in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    page_id, url, html, refers_to, revisit = row
                    yield make_record(page_id, url, (html or "").encode("utf-8"), refers_to, revisit, f"{part}.{n}")
                    n += 1

    rows, number = records(), 0
    while True:
        sample, size = [], 0
        for record in islice(rows, SAMPLE_RECORDS):
            sample.append(record)
            size += len(record)
            if size > SAMPLE_BYTES:
                break
        if not sample:
            return
        uri = f"{folder}/pages-{part:06d}-{number:04d}.warc.zst"
        with new_file(uri) as out:
            writer = ArchiveWriter(out, train_dictionary(sample))
            for record in chain(sample, rows):
                writer.add(record)
                if writer.size > ROLL:
                    break
        yield pa.RecordBatch.from_pydict({"path": [uri], "records": [writer.records]})
        number += 1


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Manifest (path, records) of the archives of all ``pages`` (page_id, url, html).

    Null html is an empty payload. Of records with equal payloads of at least ``min_payload`` bytes
    the one with the smallest page_id (null last) is a response and the others revisit it; of rows
    that repeat that page_id, the first by url is. Shorter ones are all responses. Null urls write
    no target; an empty table writes no file; other columns are ignored.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("f2").cast("string"), F.lit(""))
    rows = fields(pages, "page_id", "url", "html").select(F.col("f0").cast("long").alias("page_id"), F.col("f1").cast("string").alias("url"), html.alias("html")).withColumn("d", F.sha1("html"))
    counts = rows.where(F.octet_length("html") >= min_payload).groupBy("d", "page_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("late"), "page_id", "n"))
    groups = counts.groupBy("d").agg(first.alias("f"), F.sum("n").alias("rows")).where("rows > 1")
    groups = materialise(groups.select(F.col("d"), F.col("f.page_id").alias("refers_to"), F.col("f.n").alias("ties")), "warc-groups")
    small = groups.count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(groups) if small else groups, "d", "left")
    head = "coalesce(ties is not null and page_id <=> refers_to, false)"
    out = joined.withColumn("revisit", F.expr(f"ties is not null and not {head}"))
    if not groups.where("ties > 1").isEmpty():
        tied = F.expr(f"{head} and ties > 1")
        order = Window.partitionBy("d", "page_id").orderBy("url")
        again = out.where(tied).withColumn("revisit", F.row_number().over(order) > 1)
        out = out.where(~tied).unionByName(again)
    out = out.select("page_id", "url", "html", "refers_to", "revisit")
    manifest = out.mapInArrow(lambda it: _write(folder, it), "path string, records long")
    return materialise(manifest, "warc-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows, size = [], 0
            with open_file(path) as file:
                for record in read_archive(io.BufferedReader(file, CHUNK)):
                    http, payload = record.http()
                    h = record.headers
                    revisit = record.type == "revisit"
                    rows.append((number(h.get("x-page-id")), h.get("warc-target-uri"), None if revisit else payload, int(http["content-length"]), h["warc-payload-digest"].removeprefix("sha1:"), record.type, number(h.get("x-refers-to-page-id"))))
                    size += len(payload)
                    if len(rows) >= 4096 or size > 16 << 20:
                        yield flush(rows)
                        rows, size = [], 0
            if rows:
                yield flush(rows)


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record.

    ``payload`` is null for revisits; bytes and digest are the full payload's. Null ids and urls read
    back as null, repeated rows as often as they were written; an empty manifest gives no rows, and
    a damaged archive raises with the record's number.
    """
    paths = manifest.select("path").repartition(shuffle_partitions(manifest.sparkSession), "path")
    return paths.mapInArrow(_read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, folder: str | None = None, min_payload: int = 0) -> DataFrame:
    """Writes all pages as archives and returns the records that read back."""
    return read_archives(write_archives(pages, folder or fresh_path(pages.sparkSession, "warc"), min_payload))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, html, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS n,
             first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS head FROM p),
b AS (SELECT page_id, n, head, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM r),
d AS (SELECT page_id, n, head, payload_bytes,
             list_transform(range(0, 4), lambda i: CAST('0x' || hex[(i * 10 + 1)::INT:(i * 10 + 10)::INT] AS BIGINT)) AS five FROM b)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda j:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((five[(j // 8 + 1)::INT] >> CAST(35 - 5 * (j % 8) AS BIGINT)) & 31 AS INT) + 1]), 'string_agg', '') AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN head END AS refers_to
FROM d
"""
