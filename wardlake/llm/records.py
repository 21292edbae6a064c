"""Operator 9: token ids as length-delimited binary records.

A record file is a plain sequence of frames in the TFRecord layout::

    length  uint64 LE | masked CRC-32C of the length  uint32 LE
    data    bytes     | masked CRC-32C of the data    uint32 LE

with ``data`` = one byte (bytes per id, 2 or 4; plus 128 if the document has
no id), the document id (int64 LE, 0 if it has none) and the token ids (LE).
Beside each ``part-N.rec`` lies ``part-N.idx``: the byte offset of every frame
and the file's end as uint64 LE, so a shuffled reader seeks single records
without scanning.

Documents are range-partitioned and sorted by ``doc_id`` and then by a hash of their text; the task that
tokenizes a range also writes it, so each text is shuffled once and ids never
are. File N holds no greater ids than file N+1, and texts that share one id (or have none)
have an order of their own, the same in every run, and may lie in several files. Nothing is gathered but one row
a file.

Defined cases: a NULL text is empty (one record with the end id alone); NULL
doc_ids sort first and are kept; repeated rows give one record each; an empty
table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, ready, shared_folder, slices, table, worker_state
from .files import open_file, whole_file
from .tokens import encoder

LANE = 256          # bytes of a message that are checked side by side
MASK_DELTA = 0xA282EAD8  # fixed by the TFRecord layout
CASTAGNOLI = 0x82F63B78  # CRC-32C polynomial, reversed bits


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC tables for four bytes at once, and those that move a CRC past ``LANE`` zero bytes."""
    t = np.zeros((4, 256), np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ (CASTAGNOLI if c & 1 else 0)
        t[0, b] = c
    for k in range(1, 4):
        t[k] = (t[k - 1] >> 8) ^ t[0][t[k - 1] & 255]
    far = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(LANE):
        far = (far >> 8) ^ t[0][far & 255]
    return t, far.reshape(4, 256)


def crc32c(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of each message, computed over all messages at once.

    Inverting the first four bytes stands for the initial register of ones,
    and zero bytes before a message do not change a CRC that starts at zero;
    so every message becomes whole lanes, lanes are run side by side, and a
    message's lanes are then joined in order."""
    t, far = worker_state("crc32c", _tables)
    out = np.zeros(len(messages), np.uint32)
    short = [i for i, m in enumerate(messages) if len(m) < 4]
    for i in short:
        c = 0xFFFFFFFF
        for b in messages[i]:
            c = (c >> 8) ^ int(t[0][(c ^ b) & 255])
        out[i] = c ^ 0xFFFFFFFF
    long = [i for i, m in enumerate(messages) if len(m) >= 4]
    if not long:
        return out
    sizes = np.array([len(messages[i]) for i in long])
    lanes = -(-sizes // LANE)
    ends = np.cumsum(lanes) * LANE
    data = np.zeros(int(ends[-1]), np.uint8)
    for i, n, e in zip(long, sizes, ends, strict=True):
        data[e - n:e] = np.frombuffer(messages[i], np.uint8)
    first = ends - sizes
    for k in range(4):
        data[first + k] ^= 255
    words = data.view("<u4").reshape(-1, LANE // 4).T.copy()
    c = np.zeros(words.shape[1], np.uint32)
    for w in words:
        c ^= w
        c = t[3][c & 255] ^ t[2][(c >> 8) & 255] ^ t[1][(c >> 16) & 255] ^ t[0][c >> 24]
    start = np.cumsum(lanes) - lanes
    whole = c[start]
    for k in range(1, int(lanes.max())):
        more = np.flatnonzero(lanes > k)
        x = whole[more]
        whole[more] = far[0][x & 255] ^ far[1][(x >> 8) & 255] ^ far[2][(x >> 16) & 255] ^ far[3][x >> 24] ^ c[start[more] + k]
    out[long] = whole ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    hc, dc = masked(crc32c(heads)), masked(crc32c(payloads))
    return [h + int(a).to_bytes(4, "little") + p + int(b).to_bytes(4, "little")
            for h, a, p, b in zip(heads, hc, payloads, dc, strict=True)]


def unframe(buf: bytes, offsets: np.ndarray) -> list[bytes]:
    """The payloads of frames that begin at ``offsets`` in ``buf``; raises if a checksum is wrong."""
    heads, datas, sums = [], [], []
    for o in offsets.tolist():
        n = int.from_bytes(buf[o:o + 8], "little")
        heads.append(buf[o:o + 8])
        datas.append(buf[o + 12:o + 12 + n])
        sums.append((buf[o + 8:o + 12], buf[o + 12 + n:o + 16 + n]))
    hc, dc = masked(crc32c(heads)), masked(crc32c(datas))
    for (a, b), x, y in zip(sums, hc, dc, strict=True):
        if int.from_bytes(a, "little") != int(x) or int.from_bytes(b, "little") != int(y):
            raise ValueError("a record's checksum does not match")
    return datas


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """``ids``: little-endian uint32."""
    body = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids
    return struct.pack("<Bq", width | (128 if doc_id is None else 0), doc_id or 0) + body


def from_payload(data: bytes) -> tuple[int | None, bytes]:
    flag, doc_id = struct.unpack_from("<Bq", data)
    body = data[9:]
    if flag & 127 == 2:
        body = np.frombuffer(body, "<u2").astype("<u4").tobytes()
    return (None if flag & 128 else doc_id), body


WROTE = "part int, records long, ids long, bytes long"


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Tokenize ``docs(doc_id, text)``, append ``end_id`` to each and write the
    record and index files to ``folder``. Returns one row per file; the files
    are written when that DataFrame is computed."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 2 if max(enc.tok.get_vocab_size(), end_id + 1) <= 65536 else 4
        end = struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        offsets, at, n_ids, out, stack = [], 0, 0, None, ExitStack()
        with stack:
            for batch in slices(batches, uses="encoder:"):
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in blocks(texts):
                    ids = [x + end for x in enc.ids(texts[a:b])]
                    packed = frames([payload(d, x, width) for d, x in zip(doc_ids[a:b], ids, strict=True)])
                    if out is None:
                        out = stack.enter_context(whole_file(folder, f"part-{part:06d}.rec"))
                    for f in packed:
                        offsets.append(at)
                        at += len(f)
                    out.write(b"".join(packed))
                    n_ids += sum(map(len, ids)) // 4
        if out is not None:
            with whole_file(folder, f"part-{part:06d}.idx") as index:
                index.write(np.array([*offsets, at], "<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())] + [pa.array([x], pa.int64()) for x in (len(offsets), n_ids, at)],
                                             names=["part", "records", "ids", "bytes"])

    ready(docs.sparkSession)
    order = ("doc_id", F.xxhash64("text"))
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(write, WROTE))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, part int, record long"


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      names=[x.split()[0] for x in READ.split(", ")])


def read_records(spark: SparkSession, folder: str, files: list[tuple[int, int]]) -> DataFrame:
    """Read whole files back in order: a row per record with its place among all ids.
    ``files``: (part, ids before it), one entry a file."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(folder, f"part-{part:06d}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").astype(np.int64)
                with open_file(folder, f"part-{part:06d}.rec") as f:
                    a = 0
                    while a < len(index) - 1:  # about 8 MB at a time
                        b = max(a + 1, int(np.searchsorted(index, index[a] + (8 << 20), "right")) - 1)
                        f.seek(int(index[a]))
                        buf = f.read(int(index[b] - index[a]))
                        rows = []
                        for i, data in enumerate(unframe(buf, index[a:b] - index[a])):
                            doc_id, ids = from_payload(data)
                            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), part, a + i))
                            start += len(ids) // 4
                        yield _digest(rows)
                        a = b

    ready(spark)
    if not files:
        return spark.createDataFrame([], READ)
    return spark.createDataFrame(files, "part int, start long").repartition(len(files)).mapInArrow(read, READ)


def shuffled_reads(spark: SparkSession, folder: str, files: list[tuple[int, int]], seed: int) -> DataFrame:
    """Every record once, in an order drawn by ``seed``, fetched by seeking through
    the offset index (``files``: (part, records in it)). Columns: doc_id, ids (array)."""
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = []
            for part, record in zip(batch.column("part").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if part not in index:
                    with open_file(folder, f"part-{part:06d}.idx") as f:
                        index[part] = np.frombuffer(f.read(), "<u8").astype(np.int64)
                a, b = int(index[part][record]), int(index[part][record + 1])
                with open_file(folder, f"part-{part:06d}.rec") as f:
                    f.seek(a)
                    rows.append(from_payload(unframe(f.read(b - a), np.array([0]))[0]))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()),
                                              pa.array([np.frombuffer(x, "<u4").astype(np.int64) for _, x in rows], pa.list_(pa.int64()))],
                                             names=["doc_id", "ids"])

    ready(spark)
    each = spark.createDataFrame(files, "part int, records long").select(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1)).alias("record"))
    place = F.xxhash64(F.lit(seed), "part", "record")
    return each.repartitionByRange(place).sortWithinPartitions(place).select("part", "record").mapInArrow(fetch, "doc_id long, ids array<long>")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through ``byte_bpe_50k.json`` with end id 0 to record files and back."""
    import public_tokenizers
    folder = shared_folder(spark, "records")
    wrote = write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), 0)
    files, before = [], 0
    for r in sorted(wrote.collect()):  # one row a file
        files.append((r.part, before))
        before += r.ids
    return read_records(spark, folder, files)
