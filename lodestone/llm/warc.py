"""WARC archives with one zstandard frame for each record and a dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.files import FileWriter, open_input, train
from lodestone.shared import materialize, new_folder

#: Fixed values of the format: magic numbers of zstandard's frames and of its dictionaries.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed at this many bytes; a dictionary has at most so many, from samples of so many.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 20, 48 << 10, 2 << 20
#: Revisits that are broadcast at most; more of them are joined by key.
BROADCAST_ROWS = 200_000
DATE = b"1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that isn't valid; names the file, the byte and what is wrong."""


def record_id(page_id: int | None) -> bytes:
    """URN of a page's record: its id in the low 64 bits of a fixed UUID (none: a random UUID)."""
    low = uuid.uuid4() if page_id is None else uuid.UUID(int=0x6C6F6465_73744F4E << 64 | page_id & (1 << 64) - 1)
    return f"<urn:uuid:{low}>".encode()


def page_of(urn: bytes | None) -> int | None:
    if urn is None:
        return None
    n = uuid.UUID(urn.strip(b"<>").decode().removeprefix("urn:uuid:")).int & (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: bytes = DATE) -> bytes:
    """One record with its HTTP head; a revisit has no body. Control characters of a URL are percent-coded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode("utf-8", "surrogatepass") if url else b"urn:none"
    head = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + record_id(page_id),
        *([] if page_id is None else [b"X-Page-ID: %d" % page_id]),
        b"WARC-Date: " + date,
        b"WARC-Target-URI: " + target,
        b"WARC-Payload-Digest: sha1:" + digest,
        *([b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + record_id(refers_to)] if revisit else []),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Headers (lower-case names) and block of the one record in ``data``; raises WarcError."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("no end of the headers")
    first, *lines = data[:end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", first):
        raise WarcError(f"not a WARC version: {first[:40]!r}")
    headers: dict[bytes, bytes] = {}
    for line in lines:
        if line[:1] in b" \t" and headers:
            name = next(reversed(headers))
            headers[name] += b" " + line.strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+\-.^_`|~0-9A-Za-z]+", name):
            raise WarcError(f"bad header line: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in (b"warc-type", b"warc-record-id", b"warc-date", b"content-length"):
        if name not in headers:
            raise WarcError(f"no {name.decode()}")
    if not headers[b"content-length"].isdigit():
        raise WarcError(f"bad content-length: {headers[b'content-length'][:40]!r}")
    length = int(headers[b"content-length"])
    if len(data) != end + 4 + length + 4 or data[-4:] != b"\r\n\r\n":
        raise WarcError(f"content-length {length} doesn't fit the record of {len(data)} bytes")
    return headers, data[end + 4 : -4]


def payload_of(headers: dict[bytes, bytes], block: bytes) -> tuple[bytes | None, int]:
    """Payload (None for a revisit) and the length of the full payload; checks length and SHA-1."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("no end of the HTTP head")
    found = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", block[: end + 2])
    if not found:
        raise WarcError("no content-length in the HTTP head")
    length, payload = int(found[1]), block[end + 4 :]
    if headers[b"warc-type"] == b"revisit":
        if payload:
            raise WarcError("a revisit with a body")
        return None, length
    if len(payload) != length:
        raise WarcError(f"HTTP content-length {length}, but the payload has {len(payload)} bytes")
    digest = headers.get(b"warc-payload-digest", b"")
    if digest.lower().startswith(b"sha1:") and base64.b32encode(hashlib.sha1(payload).digest()) != digest[5:].upper():
        raise WarcError("the payload doesn't have its digest")
    return payload, length


class ArchiveWriter:
    """Frames of records; the dictionary is trained on the first records (up to SAMPLE_BYTES), which wait for it."""

    def __init__(self, folder: str, name: str, level: int = 3):
        self.file, self.level = FileWriter(folder, name), level
        self.waiting: list[bytes] | None = []
        self.held, self.records = 0, 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.waiting is None:
            self.file.write(self.zstd.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        waiting, self.waiting = self.waiting, None
        content = train(waiting, DICTIONARY_BYTES)
        self.file.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
        self.zstd = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True)
        for record in waiting:
            self.file.write(self.zstd.compress(record))

    def close(self) -> tuple[str, int, int]:
        if self.waiting is not None:
            self.start()
        return self.file.close(), self.records, self.file.bytes


def read_frames(stream, name: str = "", chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(byte offset, content) of each frame after the dictionary; memory for one record and one chunk."""
    head = stream.read(8)
    if not head:
        return
    if len(head) < 8:
        raise WarcError(f"{name}: {len(head)} bytes only")
    magic, size = struct.unpack("<II", head)
    dictionary, data, at = None, head, 0
    if magic == DICTIONARY_FRAME:
        content = stream.read(size)
        if len(content) != size:
            raise WarcError(f"{name}: the dictionary frame is cut off")
        if content[:4] == struct.pack("<I", ZSTD_FRAME):
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        dictionary, data, at = zstandard.ZstdCompressionDict(content), b"", 8 + size
    zstd = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        frame, parts, used = zstd.decompressobj(), [], 0
        while True:
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"{name}: byte {at}: {e}") from None
            used += len(data)
            if frame.eof:
                break
            data = stream.read(chunk)
            if not data:
                raise WarcError(f"{name}: byte {at}: the last frame is cut off")
        data = frame.unused_data
        yield at, b"".join(parts)
        at += used - len(data)


def read_records(uri: str) -> Iterator[tuple[dict[bytes, bytes], bytes | None, int]]:
    """(headers, payload or None, length of the full payload) of each record of an archive, all validated."""
    with open_input(uri) as stream:
        for at, data in read_frames(stream, uri):
            try:
                headers, block = parse_record(data)
                if headers[b"warc-type"] not in (b"response", b"revisit"):
                    yield headers, block, len(block)
                else:
                    yield headers, *payload_of(headers, block)
            except WarcError as e:
                raise WarcError(f"{uri}: record at byte {at}: {e}") from None


def _revisits(pages: DataFrame, id_col: str, least: int) -> DataFrame:
    """(``page_id``, ``_sha``, ``refers_to``) of the pages whose payload a page with a larger id has."""
    keys = pages.where(F.col(id_col).isNotNull() & (F.octet_length("_payload") >= least)).select(F.col(id_col).alias("_page"), "_sha")
    last = keys.groupBy("_sha").agg(F.max("_page").alias("refers_to"), F.min("_page").alias("_first")).where("_first < refers_to")
    return keys.join(last.drop("_first"), "_sha").where("_page < refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write a record for every row of ``pages`` and return the manifest (``path``, ``records``, ``bytes``).

    Of rows with equal payloads of at least ``least`` bytes (UTF-8 of the html; null: empty) the one with
    the largest id is a response and the others are revisits of it. Only ids and digests are shuffled:
    rows with a repeated payload are found from them, and the few ids of revisits are joined to the pages
    (broadcast up to BROADCAST_ROWS rows, by key beyond). Each task writes its own archives.

    Defined cases: a null id is never equal to another: its row is a response and comes back with a null
    id; repeated rows of the largest id are all responses; a null or empty url becomes ``urn:none``; an
    empty table writes no archive.
    """
    spark = pages.sparkSession
    source = pages.select(F.col(id_col), F.col(url_col), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("_payload"))
    source = source.withColumn("_sha", F.sha1("_payload"))
    revisits = materialize(_revisits(source, id_col, least), "warc-revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    rows = source.join(revisits.withColumnRenamed("_sha", "_sha2"), (F.col(id_col) == F.col("_page")) & (F.col("_sha") == F.col("_sha2")), "left")
    rows = rows.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), "_payload", "_sha", "refers_to")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, archive = TaskContext.get().partitionId(), None
        done = []
        for batch in batches:
            for page, url, payload, sha, other in zip(batch["id"], batch["url"], batch["_payload"], batch["_sha"], batch["refers_to"]):
                archive = archive or ArchiveWriter(folder, f"part-{part:06d}.warc.zst")
                other = None if other is None or other != other else int(other)
                page = None if page is None or page != page else int(page)
                archive.add(build_record(page, url, bytes(payload), base64.b32encode(bytes.fromhex(sha)), other))
                if archive.file.bytes >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    ids = [F.col("id").cast("decimal(20,0)").alias("id"), "url", "_payload", "_sha", F.col("refers_to").cast("decimal(20,0)").alias("refers_to")]
    return materialize(rows.select(*ids).mapInPandas(write, "path string, records long, bytes long"), "warc-manifest")


RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in column ``path``: page_id, url, record_type, payload (null for revisits),
    payload_bytes and payload_digest of the full payload, refers_to. One archive is read by one task, a
    record at a time. Raises WarcError for anything invalid. No archives: no rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["path"]:
                rows, held = [], 0
                for headers, payload, length in read_records(uri):
                    page = headers.get(b"x-page-id")
                    digest = headers.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
                    kind, url = headers[b"warc-type"].decode(), headers.get(b"warc-target-uri", b"").decode("utf-8", "replace")
                    rows.append((page and int(page), url, kind, payload if payloads else None, length, digest, page_of(headers.get(b"warc-refers-to"))))
                    held += len(payload or b"") * payloads + 200
                    if held >= 8 << 20:
                        yield _frame(rows)
                        rows, held = [], 0
                yield _frame(rows)

    return manifest.select("path").repartition(max(1, min(10_000, manifest.count())), "path").mapInPandas(read, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])
    return out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    records = read_archives(write_archives(pages, new_folder(spark, "warc")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    m AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 8), lambda i:
        list_aggregate(list_transform(range(0, 4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (((('0x' || substr(h, (5 * i + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * j)) & 31) + 1)::BIGINT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = last OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id < last THEN last END AS refers_to
FROM m
"""

QUERIES = {"op1_warc": op1_warc}
ORACLES = {"op1_warc": SQL_OP1}
