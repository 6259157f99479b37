"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed, and goes on with
one frame a record, so a record is read alone from its offset with the dictionary at hand. The dictionary is built from
a bounded sample of the records to be archived: about SAMPLE pages of at most SAMPLE_BYTES, those whose hash of page_id is small.

Pages with equal payloads are found by digest: only (page_id, digest) is shuffled. The digests that occur more than once
are broadcast if they are MOST_SHARED at most, so that no payload moves; beyond that, the pages that a filter of fixed size
passes are joined with them by digest.

Each task writes its rows as one file, first under a name of its own attempt, then renamed; a task that is run again
writes a file of its own and only the files that the finished tasks report are read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_of, materialize, passed, scratch_path, small_batches, table

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 * 1024
SAMPLE = 500
SAMPLE_BYTES = 64 * 1024
#: Shared digests that are broadcast, at most: 40 bytes each.
MOST_SHARED = 200_000
LEAST_SHARED = 1000
DATE = "2024-01-01T00:00:00Z"


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of the records; empty if they are too few or too small to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, records)) // 8)), records).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def record_id(page_id: int | None, ordinal: int) -> str:
    name = f"page:{page_id}" if page_id is not None else f"row:{ordinal}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, ordinal: int = 0) -> bytes:
    """One WARC/1.1 record: a response with its payload or a revisit without; digests and lengths are of the full payload."""
    kind = "revisit" if refers_to is not None else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, ordinal)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, 0)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record; its lengths and, for a response, its digest are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and (len(payload) != int(fields["X-Payload-Length"]) or "sha1:" + hashlib.sha1(payload).hexdigest() != fields["WARC-Payload-Digest"]):
        raise ValueError("a record's payload is damaged")
    return fields, payload


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def read_dictionary(f) -> bytes:
    magic, size = struct.unpack("<II", f.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the file doesn't begin with a dictionary frame")
    return zstandard.ZstdDecompressor().decompress(f.read(size))


def _codec_options(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def decompressed_frames(f, codec, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The content of each frame of f, read in chunks."""
    data = b""
    while True:
        d, parts = codec.decompressobj(), []
        while not d.eof:
            if not data:
                data = f.read(chunk)
                if not data:
                    if parts:
                        raise ValueError("the file ends within a record")
                    return
            parts.append(d.decompress(data))
            data = d.unused_data if d.eof else b""
        yield b"".join(parts)


def with_references(pages: DataFrame, least: int = LEAST_SHARED, most_shared: int = MOST_SHARED) -> DataFrame:
    """page_id, url, html and refers_to: of pages with equal payloads of at least `least` bytes, the largest page_id of them, for the others."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("key", F.when(F.octet_length("html") >= least, F.unhex(F.sha2("html", 256))))
    counted = keyed.where("key IS NOT NULL").select("page_id", "key").groupBy("key").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    shared = materialize(counted.where("n > 1 AND top IS NOT NULL").select("key", "top"), "warc-shared")
    other = F.when(F.col("page_id") != F.col("top"), F.col("top")).alias("refers_to")
    if shared.count() <= most_shared:
        return keyed.join(F.broadcast(shared), "key", "left").select("page_id", "url", "html", other)
    near = passed(keyed, "key", filter_of(shared, "key"))
    hits = near.where("passed").join(shared, "key", "left").select("page_id", "url", "html", other)
    return near.where("NOT passed").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")).unionByName(hits)


def write_archives(pages: DataFrame, path: str, sample: int = SAMPLE) -> DataFrame:
    """Write rows (page_id, url, html, refers_to) under path; returns (file, records), one row a file.

    The dictionary sees about `sample` pages, and never more than four times as many where many rows repeat an id.
    """
    short = pages.where(F.octet_length("html") <= SAMPLE_BYTES)
    n = short.count()
    share = int(min(1.0, sample / max(n, 1)) * (1 << 20))
    drawn = short.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < share).select("page_id", "url", "html").limit(4 * sample).collect()
    dictionary = train_dictionary([record(r.page_id, r.url, (r.html or "").encode(), None) for r in drawn])
    leading = dictionary_frame(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(path)
        fs.create_dir(root)
        name, n, out = f"{root}/{uuid.uuid4().hex}.warc.zst", 0, None
        codec = zstandard.ZstdCompressor(level=3, write_checksum=True, **_codec_options(dictionary))
        for b in small_batches(batches):
            for page, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out = fs.open_output_stream(name + ".part", compression=None)
                    out.write(leading)
                out.write(codec.compress(record(page, url, (html or "").encode(), refers, n)))
                n += 1
        if out is not None:
            out.close()
            fs.move(name + ".part", name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return materialize(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "file string, records long"), "warc-files")


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(files: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """Read the files that write_archives names: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload is null, its length and digest are those of the full payload. Damaged files raise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(path)
        for b in batches:
            for name, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_stream(name, compression=None) as f:
                    codec = zstandard.ZstdDecompressor(**_codec_options(read_dictionary(f)))
                    rows, n = [], 0
                    for raw in decompressed_frames(f, codec):
                        fields, payload = parse(raw)
                        n += 1
                        page, refers, revisit = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID"), fields["WARC-Type"] == "revisit"
                        rows.append((int(page) if page else None, fields.get("WARC-Target-URI"), payload if payloads and not revisit else None, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], int(refers) if refers else None))
                        if len(rows) == 500:
                            yield _batch(rows)
                            rows = []
                    if n != expected:
                        raise ValueError(f"{name} holds {n} records, not {expected}")
                    if rows:
                        yield _batch(rows)

    # As many tasks as a shuffle has: the few small rows that name files would be put into one task.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, "file").select("file", "records").mapInArrow(run, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write a record for each row (page_id, url, html) and read the archives back; columns as in read_archives.

    Null html is an empty payload. Of equal payloads of at least LEAST_SHARED bytes the one with the largest page_id is
    the response and the others revisit it; rows that repeat that page_id are responses too, and a row with a null
    page_id always is one. Rows that repeat a page_id take their own payload's verdict. Other columns are ignored; no rows give no files.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(with_references(pages), path), path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), t AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS top FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM t
"""
