"""Operator 6: web archive bundles in seekable Zstandard.

Each task writes one bundle: its WARC records are grouped into frames of about
``FRAME_BYTES``, every frame compressed by itself, and a seek table (compressed
and plain size of each frame) follows in a skippable frame at the end of the
file, as the Zstandard seekable format lays down. Any Zstandard tool
reads a bundle as one stream; a reader that wants one record needs the footer,
one frame and the record's place in it. The record index (``write``'s result)
maps ids to bundle, frame and place in the frame.

Records with equal payloads (same SHA-1 and length) of at least
``least_bytes``: the one with the smallest page_id is a ``response``, the others
are ``revisit`` records that refer to it and carry no payload. Finding them is one
grouped minimum and one join on the digest, which Spark splits where a digest is
very frequent.

Defined cases: NULL html is an empty payload; a NULL url leaves out the target;
a NULL page_id gets a record named ``null`` and is a response only if no row with
an id has its payload; rows that repeat a page_id get a record each, and are
all responses if that id is the smallest; an empty table writes no bundle and
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, saved, shared_folder, table
from .files import open_file, whole_file

FRAME_BYTES = 1 << 20
LEVEL = 3
# Fixed values of the Zstandard seekable format and of WARC 1.1
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = b"1970-01-01T00:00:00Z"  # the pages have no date of their own


def name_of(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page_id is None else b"%d" % page_id)


def id_of(name: bytes) -> int | None:
    text = name.removeprefix(b"<urn:page:").removesuffix(b">")
    return None if text == b"null" else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; the block is an HTTP message, without its body in a revisit."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + name_of(page_id), b"WARC-Date: " + NO_DATE]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
    head.append(b"WARC-Payload-Digest: sha1:" + digest)
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + name_of(refers_to)]
    else:
        block += payload
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[bytes, bytes], int, bytes, int]:
    """(WARC header, length its message names, body, end) of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    header = dict(x.split(b": ", 1) for x in lines[1:])
    block = data[stop + 4:stop + 4 + int(header[b"Content-Length"])]
    message, body = block.split(b"\r\n\r\n", 1)
    length = next(int(x.split(b": ", 1)[1]) for x in message.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return header, length, body, stop + 4 + len(block) + 4


class Bundle:
    """Writes records to a stream as independent frames and a seek table."""

    def __init__(self, out):
        import zstandard
        self.out, self.zip = out, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, place in it) of the record."""
        if self.filled and self.filled + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.sizes), self.filled
        self.open.append(data)
        self.filled += len(data)
        return place

    def flush(self) -> None:
        if self.open:
            packed = self.zip.compress(b"".join(self.open))
            self.out.write(packed)
            self.sizes.append((len(packed), self.filled))
            self.open, self.filled = [], 0

    def end(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


def seek_table(f) -> np.ndarray:
    """(start in the file, compressed size, plain size) of each frame, from the footer of an open bundle."""
    end = f.size()
    f.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    f.seek(end - 9 - 8 * n)
    sizes = np.frombuffer(f.read(8 * n), "<u4").reshape(n, 2).astype(np.int64)
    return np.column_stack([np.cumsum(sizes[:, 0]) - sizes[:, 0], sizes])


def frame(f, row: np.ndarray) -> bytes:
    import zstandard
    f.seek(int(row[0]))
    return zstandard.ZstdDecompressor().decompress(f.read(int(row[1])), max_output_size=int(row[2]))


INDEX = "page_id long, bundle int, frame int, place long, size long"


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as bundles below ``folder``; the record index, already saved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, ctx, bundle = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if bundle is None:
                ctx = whole_file(folder, f"bundle-{part:06d}.warc.zst")
                out = ctx.__enter__()
                bundle = Bundle(out)
            rows = []
            for page_id, url, html, sha, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(page_id, url, html, base64.b32encode(bytes.fromhex(sha)), first, revisit)
                rows.append((*bundle.add(data), len(data)))
            frames, places, sizes = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(rows), pa.int32()), pa.array(frames, pa.int32()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())],
                                             names=[x.split()[0] for x in INDEX.split(", ")])
        if bundle is not None:
            bundle.end()
            ctx.__exit__(None, None, None)

    ready(pages.sparkSession)
    body = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select("page_id", "url", body.alias("html"), F.sha1(body).alias("sha"), F.length(body).alias("n"))
    digests = pages.select("page_id", F.sha1(body).alias("sha"), F.length(body).alias("n"))
    firsts = digests.groupBy("sha", "n").agg(F.min("page_id").alias("first"))
    revisit = (F.col("n") >= least_bytes) & F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    rows = (own.join(firsts, ["sha", "n"]).select("page_id", "url", "html", "sha", "first", revisit.alias("revisit"))
            .sortWithinPartitions("page_id"))
    return saved(rows.mapInArrow(run, INDEX), "record-index")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle int, frame int, place long"


def read(spark: SparkSession, folder: str, bundles: list[int]) -> DataFrame:
    """Every record of the bundles, frame by frame; raises if a response's payload does not match its digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        for batch in batches:
            for part in batch.column(0).to_pylist():
                with open_file(folder, f"bundle-{part:06d}.warc.zst") as f:
                    for k, row in enumerate(seek_table(f)):
                        data, at, rows = frame(f, row), 0, []
                        while at < len(data):
                            header, length, body, end = parse(data, at)
                            kind, digest = header[b"WARC-Type"].decode(), header[b"WARC-Payload-Digest"].removeprefix(b"sha1:")
                            if kind == "response" and (len(body) != length or base64.b32encode(hashlib.sha1(body).digest()) != digest):
                                raise ValueError("a payload does not match its digest")
                            refers = header.get(b"WARC-Refers-To")
                            rows.append((id_of(header[b"WARC-Record-ID"]), length, digest.decode(), kind, None if refers is None else id_of(refers), part, k, at))
                            at = end
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                         names=[x.split()[0] for x in READ.split(", ")])

    ready(spark)
    if not bundles:
        return spark.createDataFrame([], READ)
    return spark.createDataFrame([(b,) for b in bundles], "bundle int").repartition(len(bundles)).mapInArrow(run, READ)


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, record_type, payload) of the records in ``index``, a part of ``write``'s result: each is read
    by one seek to its frame; records of one frame share it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, data = None, b""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held != (r["bundle"], r["frame"]):
                    held = r["bundle"], r["frame"]
                    with open_file(folder, f"bundle-{r['bundle']:06d}.warc.zst") as f:
                        data = frame(f, seek_table(f)[r["frame"]])
                header, _, body, _ = parse(data, r["place"])
                out.append((r["page_id"], header[b"WARC-Type"].decode(), body))
            ids, kinds, bodies = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(bodies, pa.binary())], names=["page_id", "record_type", "payload"])

    ready(index.sparkSession)
    return (index.repartitionByRange("bundle", "frame").sortWithinPartitions("bundle", "frame", "place")
            .mapInArrow(run, "page_id long, record_type string, payload binary"))


def op6_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages to bundles and back."""
    folder = shared_folder(spark, "warc")
    index = write(table(spark, sf_dir, "pages"), folder)
    bundles = sorted(r.bundle for r in index.select("bundle").distinct().collect())  # one a writing task
    return read(spark, folder, bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS sha FROM pages),
f AS (SELECT sha, n, min(page_id) AS first FROM p GROUP BY sha, n)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(sha, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p JOIN f USING (sha, n)"""
