"""WARC archives with a Zstandard dictionary: writer and reader.

An archive is ``.warc.zst``: a leading skippable frame holds the dictionary, then every record is a frame
of its own. The dictionary is built from a bounded sample of the records to be archived. Records with
equal payloads are written once; the others are revisit records that name it.

Each task writes its records to one new file in the shared folder and reports it in a manifest. Files of
lost or repeated attempts are in no manifest, so they are never read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import read, shared_folder, ship, stored

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"

#: Payloads from this many bytes on are written once.
REVISIT_BYTES = 100
#: At most so many records, each of at most so many bytes, train the dictionary.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 800, 16_384, 65_536
DATE = "1970-01-01T00:00:00Z"


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id, url: str | None, payload: bytes | None, size: int, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One response record, or a revisit record if ``payload`` is None; size and digest are the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    name = uuid.uuid4().urn if page_id is None else f"{RECORD_ID}{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if payload is None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """None if the samples are too few or too short for one."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes() if len(samples) >= 16 else None
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    def __init__(self, out, dictionary: bytes | None, level: int = 3):
        self.out = out
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.codec = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
        if dictionary:
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)

    def add(self, one: bytes) -> None:
        self.out.write(self.codec.compress(one))


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive; headers have lower-case names."""
    start = source.read(8)
    if len(start) < 8:
        return
    magic, size = struct.unpack("<II", start)
    trained = None
    if magic == DICTIONARY_FRAME:
        trained = zstandard.ZstdCompressionDict(source.read(size))
        start = b""
    joined = io.BufferedReader(_Prefixed(start, source), 1 << 20)
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=trained).stream_reader(joined, read_across_frames=True), 1 << 20)
    while line := plain.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := plain.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = plain.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block


class _Prefixed(io.RawIOBase):
    """A source behind a few bytes that were already read from it."""

    def __init__(self, first: bytes, rest):
        self.first, self.rest = first, rest

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got, self.first = (self.first[: len(into)], self.first[len(into) :]) if self.first else (self.rest.read(len(into)), b"")
        into[: len(got)] = got
        return len(got)


def plan(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest and refers_to, the key of the equal page to revisit or null.

    Only keys and digests are grouped; a payload moves once, dealt by key and digest, so a payload that
    very many pages share stays spread out.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    keyed = pages.withColumns({"payload_bytes": F.octet_length(body).cast("long"), "payload_digest": F.sha2(body, 256)})
    large = keyed.where(F.col("payload_bytes") >= least).select(F.col(key).alias("k"), F.col("payload_digest").alias("d")).distinct()
    first = large.groupBy("d").agg(F.min("k").alias("refers_to"), F.count("*").alias("many")).where("many > 1 and refers_to is not null")
    others = large.join(first, "d").where("k is null or k <> refers_to").select("k", "d", "refers_to")
    return keyed.join(others, keyed[key].eqNullSafe(F.col("k")) & (F.col("payload_digest") == F.col("d")), "left").drop("k", "d")


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_BYTES
) -> DataFrame:
    """Write one record for each row into new archives below ``folder``; returns (archive, records, bytes).

    Of pages with equal payloads of at least ``least`` bytes that with the smallest key is the response
    and the others revisit it; repeated rows of the smallest are responses too. A null payload is empty,
    a null url leaves its header out, a null key gets a random record id and reads back as null.
    ``folder`` is a URI that pyarrow opens on every executor. An empty table writes nothing.
    """
    spark = pages.sparkSession
    ship(spark)
    pages = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"))
    size = F.octet_length("payload")
    total = max(1, pages.count())
    sampled = pages.where((size > 0) & (size <= SAMPLE_BYTES))
    sampled = sampled.where(F.pmod(F.xxhash64(F.lit("dictionary"), "key"), F.lit(1 << 24)) < 2 * SAMPLE_RECORDS * (1 << 24) // total)
    rows = sampled.limit(SAMPLE_RECORDS).collect()
    samples = [record(r.key, r.url, r.payload.encode(), len(r.payload.encode()), hashlib.sha256(r.payload.encode()).hexdigest()) for r in rows]
    dictionary = build_dictionary(samples)
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = writer = None
        count = 0
        for batch in batches:
            for page, address, body, length, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    where, path = fs.FileSystem.from_uri(folder)
                    where.create_dir(path, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    out = where.open_output_stream(f"{path}/{name}")
                    writer = ArchiveWriter(out, shared.value)
                content = (body or "").encode() if refers is None else None
                writer.add(record(page, address, content, length, digest, refers))
                count += 1
        if out is not None:
            written = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [count], "bytes": [written]})

    planned = plan(pages, "key", "payload", least).select(
        "key", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "refers_to"
    )
    return stored(planned.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the manifest's archives: (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]).

    Digest and size of a response are taken from the bytes read; if they differ from its headers, reading
    fails. Those of a revisit are in its headers. Page ids are integers.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def ident(value: str | None) -> int | None:
        name = (value or "").strip("<>")
        return int(name[len(RECORD_ID) :]) if name.startswith(RECORD_ID) else None

    def rows(uri: str) -> Iterator[tuple]:
        where, path = fs.FileSystem.from_uri(uri)
        with where.open_input_stream(path) as source:
            for head, block in read_records(source):
                http, _, body = block.partition(b"\r\n\r\n")
                said = head["warc-payload-digest"].removeprefix("sha256:")
                size = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                if head["warc-type"] == "response" and (hashlib.sha256(body).hexdigest(), len(body)) != (said, size):
                    raise ValueError(f"the payload of {head['warc-record-id']} in {uri} is damaged")
                found = (ident(head["warc-record-id"]), head.get("warc-target-uri"), size, said, head["warc-type"], ident(head.get("warc-refers-to")))
                yield (*found, body if head["warc-type"] == "response" else None) if with_payload else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held: list[tuple] = []
                for row in rows(uri):
                    held.append(row)
                    if len(held) == (64 if with_payload else 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=False)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=False)], names=names)

    ship(manifest.sparkSession)
    files = manifest.select("archive")
    return files.repartition(max(1, min(files.count(), 10_000)), "archive").mapInArrow(run, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page what its record says, read back from the archives that this call writes."""
    pages = read(spark, sf_dir, "pages")
    manifest = write_archives(pages, shared_folder(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
#: What the archives must say follows from the pages alone.
ORACLE_SQL = {
    "op8_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> low THEN low END AS refers_to
        FROM f"""
}
