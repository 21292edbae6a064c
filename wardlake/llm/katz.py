"""Operator 5: language-model scores by Katz backoff with Good-Turing discounts.

Model of order n over words (A-Z lower-cased, cut at ASCII white space, one end
per text)::

    P_k(w | h) = d * c(h w) / c(h) * s(h)     if c(h w) > 0
                 a(h) * P_(k-1)(w | h')       otherwise, h' = h without its first word

Counts up to ``CUT`` are discounted by Good-Turing (Katz's formula over the
count-of-counts of that order; where that gives no number in (0, 1], the
absolute discount n1 / (n1 + 2 n2) is taken off instead). ``a(h)`` makes the
probabilities of each history sum to one exactly, over the known words, the
end and one unknown word: ``a(h) = (1 - sum P) / (1 - sum P_(k-1))`` over the
words seen after h. A history of which no count is discounted would leave nothing for
the others; it gives up half a count (``s(h) = c / (c + 1/2)``), else s(h) = 1.
At order 1 the unknown word has the mass that the discounts set free.

The corpus is worked in chunks of about ``CHUNK_TOKENS`` tokens (whole texts, words as 64-bit hashes), and
each chunk sends every distinct n-gram once, as a sorted run of 64-bit keys and
training counts, to the bucket of the key's range. A frequent n-gram is therefore
one entry a chunk, and no bucket can grow from one key. Buckets add up and keep the
n-gram tables (``kind``, ``bucket``: packed keys and counts), and each chunk's
answer goes to the answer table, partitioned by chunk: counts in the order the
keys were sent, and for each n-gram whether this chunk is the one to account for it in the
history's sums. A second exchange of the same form, by history, gives s(h) and a(h)
for each order from 2 on. Then every chunk scores its texts, recursively from the
lowest order up for all its tokens at once.

Chunks are cut again from the same scan in each pass; the number of keys is
checked against the answers. The driver sees count-of-counts only.

Defined cases: NULL and empty texts have one token, the end; rows with a NULL
doc_id are scored but not learned from; repeated rows count each; with nothing to
learn from every token has log10 probability 0 (the unknown word has all the mass);
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, ready, saved, shared_folder, table
from .files import open_folder
from .shingles import ODD, hash_words

ORDER = 2
CUT = 5
CHUNK_TOKENS = 2_000_000
BLOCK_CHARS, BLOCK_ROWS = 1 << 20, 2000   # texts that are cut into words at once
CHUNK_INPUT = 8 << 20    # bytes of a Parquet file that make about one chunk
END, START = np.uint64(0x9D5C2B0F1E37A648), np.uint64(0x41C6F2A97B30E5D8)

SENT = "kind int, bucket int, part long, n long, keys binary, values binary"
GATHERED = "kind int, bucket int, part long, n long, keys binary, counts binary, owner binary, stats array<long>"


# ------------------------------------------------------------------ packing
def _press(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    import zstandard
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())


def _unpress(data: bytes, kind: str, n: int) -> np.ndarray:
    import zstandard
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, n * size)), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as compressed differences."""
    return _press(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpress(data, "<u8", n), dtype=np.uint64)


# ------------------------------------------------------------------ chunks
class Chunk:
    """Texts of a chunk as one stream of words, with n-gram and history numbers per token.

    Kinds: 2 k - 1 for the k-grams, 2 k - 2 for the histories of order k >= 2 (all (k - 1)-grams and the
    start). ``keys`` of a kind are sorted 64-bit hashes, ``at`` numbers each token's key, ``counts`` has
    the learned tokens of each key."""

    def __init__(self, ids: list, learn: list[bool], held: list[bool], sizes: list[np.ndarray], hashes: list[np.ndarray], order: int):
        self.ids, self.held, self.order = ids, held, order
        self.sizes, w = np.concatenate(sizes), np.concatenate(hashes)
        first = np.cumsum(self.sizes) - self.sizes
        learned = np.repeat(np.array(learn, bool), self.sizes)
        words, own = np.unique(w, return_inverse=True)
        self.keys, self.at = {1: words}, {1: own.astype(np.int32)}
        for k in range(2, order + 1):
            before, at = self.keys[2 * k - 3], self.at[2 * k - 3]
            start = START + np.uint64(k)
            place = int(np.searchsorted(before, start))
            history = np.empty_like(at)
            history[1:] = at[:-1] + (at[:-1] >= place)
            history[first] = place
            self.keys[2 * k - 2], self.at[2 * k - 2] = np.insert(before, place, start), history
            gram = mix64(self.keys[2 * k - 2][history] * ODD[1] + mix64(w + ODD[2]) + np.uint64(k))
            self.keys[2 * k - 1], at = np.unique(gram, return_inverse=True)
            self.at[2 * k - 1] = at.astype(np.int32)
        self.counts = {kind: np.bincount(at[learned], minlength=len(self.keys[kind])) for kind, at in self.at.items()}

    def example(self, kind: int) -> np.ndarray:
        """A token of each key."""
        out = np.zeros(len(self.keys[kind]), np.int64)
        out[self.at[kind]] = np.arange(len(self.at[kind]))
        return out

    def cuts(self, kind: int, buckets: int) -> np.ndarray:
        """Where each bucket's range of keys ends."""
        edges = np.array([((b + 1) << 64) // buckets - 1 for b in range(buckets)], np.uint64)
        return np.searchsorted(self.keys[kind], edges, "right")

    def rows(self, part: int, buckets: int, kinds: list[int], values: dict[int, np.ndarray]) -> pa.RecordBatch:
        """A row per kind and bucket with the bucket's keys and ``values``."""
        out = []
        for kind in kinds:
            a = 0
            for bucket, b in enumerate(self.cuts(kind, buckets).tolist()):
                if b > a:
                    out.append((kind, bucket, part, b - a, pack_keys(self.keys[kind][a:b]), _press(values[kind][a:b].ravel())))
                a = b
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in SENT.split(", ")])


def with_ends(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of tokens of each text, hashes of all tokens): the words of each text and its end."""
    h, n = hash_words(texts)
    out = np.full(len(h) + len(n), END, np.uint64)
    place = np.ones(len(out), bool)
    place[np.cumsum(n + 1) - 1] = False
    out[place] = h
    return n + 1, out


def chunks(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[int, Chunk]]:
    """(part, chunk): consecutive whole texts of this task's rows (doc_id, text, learn, held), closed by the first
    text that fills it; texts go in by blocks that depend on the rows alone."""
    part, size, held = TaskContext.get().partitionId() << 24, 0, ([], [], [], [], [])
    rows: list[list] = [[], [], [], []]
    length = 0

    def flush() -> None:
        nonlocal size, length
        n, h = with_ends(rows[1])
        for x, v in zip(held[:3], (rows[0], rows[2], rows[3]), strict=True):
            x.extend(v)
        held[3].append(n)
        held[4].append(h)
        size += len(h)
        length = 0
        for x in rows:
            x.clear()

    for batch in batches:
        for row in (r for lo in range(0, batch.num_rows, 500) for r in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns), strict=True)):
            for x, v in zip(rows, row, strict=True):
                x.append(v)
            length += len(row[1]) if row[1] else 0
            if length >= BLOCK_CHARS or len(rows[0]) >= BLOCK_ROWS:
                flush()
                if size >= CHUNK_TOKENS:
                    yield part, Chunk(*held, order)
                    part, size, held = part + 1, 0, ([], [], [], [], [])
    if rows[0]:
        flush()
    if size:
        yield part, Chunk(*held, order)


# ------------------------------------------------------------------ tables
def answers(folder: str, part: int) -> list[dict]:
    """The rows of ``folder``'s partition ``part``, by kind and bucket."""
    import pyarrow.parquet as pq
    from pyarrow import fs
    system, path = open_folder(folder)
    found = system.get_file_info(fs.FileSelector(f"{path}/part={part}", allow_not_found=True))
    rows = [r for f in found if f.path.endswith(".parquet") for r in pq.ParquetFile(system.open_input_file(f.path)).read().to_pylist()]
    return sorted(rows, key=lambda r: (r["kind"], r["bucket"]))


def gather(rows: pd.DataFrame) -> pd.DataFrame:
    """All chunks' runs of one kind and bucket added up: the table's row (part -1) and each chunk's answer."""
    kind, bucket = int(rows["kind"].iloc[0]), int(rows["bucket"].iloc[0])
    rows = rows.sort_values("part")
    keys = np.concatenate([unpack_keys(k, n) for k, n in zip(rows["keys"], rows["n"], strict=True)])
    counts = np.concatenate([_unpress(v, "<i8", n) for v, n in zip(rows["values"], rows["n"], strict=True)])
    unique, first, at = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(at, counts, minlength=len(unique)).astype(np.int64)
    owner = np.zeros(len(keys), bool)
    owner[first] = True
    known = total > 0
    some = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)
    stats = [*some[1:CUT + 2].tolist(), int(known.sum()), int(total.sum())]
    out = [(kind, bucket, -1, int(known.sum()), pack_keys(unique[known]), _press(total[known]), b"", stats)]
    a = 0
    for part, n in zip(rows["part"], rows["n"], strict=True):
        out.append((kind, bucket, int(part), int(n), b"", _press(total[at[a:a + n]]), np.packbits(owner[a:a + n]).tobytes(), []))
        a += n
    return pd.DataFrame(out, columns=[x.split()[0] for x in GATHERED.split(", ")])


def gather_backoff(rows: pd.DataFrame) -> pd.DataFrame:
    """Per history: (sum of discounted probabilities, sum of lower-order ones, count) over all chunks to s(h) and a(h)."""
    kind, bucket = int(rows["kind"].iloc[0]), int(rows["bucket"].iloc[0])
    rows = rows.sort_values("part")
    keys = np.concatenate([unpack_keys(k, n) for k, n in zip(rows["keys"], rows["n"], strict=True)])
    values = np.concatenate([_unpress(v, "<f8", n * 3).reshape(n, 3) for v, n in zip(rows["values"], rows["n"], strict=True)])
    unique, at = np.unique(keys, return_inverse=True)
    seen, lower = (np.bincount(at, values[:, i], minlength=len(unique)) for i in (0, 1))
    count = np.zeros(len(unique))
    count[at] = values[:, 2]
    scale = np.where(seen > 1 - 1e-9, count / (count + 0.5), 1.0)
    left = 1 - lower
    weight = np.where(left > 1e-12, (1 - seen * scale) / np.maximum(left, 1e-12), 0.0)
    weight[count == 0] = 1.0  # a history never learned: the lower order as it is
    out, a = [], 0
    for part, n in zip(rows["part"], rows["n"], strict=True):
        own = at[a:a + n]
        out.append((kind, bucket, int(part), int(n), _press(np.column_stack([scale[own], weight[own]]).ravel())))
        a += n
    return pd.DataFrame(out, columns=["kind", "bucket", "part", "n", "values"])


# ------------------------------------------------------------------ the model
def discounts(n: list[int]) -> np.ndarray:
    """d_0..d_(CUT + 1) from the count-of-counts n_1..n_(CUT + 1); d of every count above CUT is 1."""
    d = np.ones(CUT + 2)
    n = [0, *n]
    common = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    plain = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    for r in range(1, CUT + 1):
        good = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        x = (good - common) / (1 - common) if common != 1 else 0.0
        d[r] = x if 0 < x <= 1 else (r - plain) / r
    return d


class Model:
    """What every task needs to know of the model: fixed in size."""

    def __init__(self, stats: dict[int, list[int]], order: int):
        self.order = order
        self.d = {k: discounts(stats.get(2 * k - 1, [0] * (CUT + 3))[:CUT + 1]) for k in range(1, order + 1)}
        one = stats.get(1, [0] * (CUT + 3))
        self.types, self.tokens = one[CUT + 1], one[CUT + 2]
        free = sum((1 - self.d[1][r]) * r * one[r - 1] for r in range(1, CUT + 1))
        self.scale = 1.0
        if self.tokens and free <= 0:
            self.scale = self.tokens / (self.tokens + 0.5)
        self.unknown = 1 - (self.tokens - free) * self.scale / self.tokens if self.tokens else 1.0

    def discounted(self, k: int, c: np.ndarray) -> np.ndarray:
        return self.d[k][np.minimum(c, CUT + 1)] * c

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounted(1, c) * self.scale / max(self.tokens, 1), self.unknown)


def told(chunk: Chunk, folder: str, part: int, kinds: list[int]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """(total counts, owner marks) per kind, in the order of the chunk's keys."""
    totals: dict[int, list] = {k: [] for k in kinds}
    owners: dict[int, list] = {k: [] for k in kinds}
    for r in answers(folder, part):
        totals[r["kind"]].append(_unpress(r["counts"], "<i8", r["n"]))
        owners[r["kind"]].append(np.unpackbits(np.frombuffer(r["owner"], np.uint8), count=r["n"]).astype(bool))
    out = {k: np.concatenate(v) for k, v in totals.items()}, {k: np.concatenate(v) for k, v in owners.items()}
    if any(len(out[0][k]) != len(chunk.keys[k]) for k in kinds):
        raise ValueError("the scan was cut in another way than before")
    return out


def probabilities(chunk: Chunk, part: int, model: Model, totals: dict[int, np.ndarray], weights: dict[int, str], upto: int) -> np.ndarray:
    """P of every token at order ``upto``, from order 1 up. ``weights``: folder of s(h) and a(h) by order."""
    p = model.unigram(totals[1])[chunk.at[1]]
    for k in range(2, upto + 1):
        own = [_unpress(r["values"], "<f8", 2 * r["n"]).reshape(-1, 2) for r in answers(weights[k], part)]
        scale, weight = np.concatenate(own).T
        h = chunk.at[2 * k - 2]
        c = totals[2 * k - 1][chunk.at[2 * k - 1]]
        seen = model.discounted(k, c) / np.maximum(totals[2 * k - 2][h], 1) * scale[h]
        p = np.where(c > 0, seen, weight[h] * p)
    return p


def by_part(df: DataFrame, label: str) -> str:
    """Write ``df`` as a table partitioned by chunk, a file for each; its folder."""
    folder = shared_folder(df.sparkSession, label)
    df.repartition("part").write.partitionBy("part").parquet(folder)
    return folder


def split_bytes(spark: SparkSession) -> int:
    """The most bytes of a file that one scan task reads, as the session has it."""
    text = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().removesuffix("b")
    unit = "kmgt".find(text[-1]) + 1
    return int(text.rstrip("kmgt")) << 10 * unit


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text, learn, held)`` by a model of the rows with ``learn``."""
    spark = ready(docs.sparkSession)
    docs = docs.select("doc_id", "text", "learn", "held")
    buckets = max(1, docs.rdd.getNumPartitions()) * max(1, split_bytes(spark) // CHUNK_INPUT)
    kinds = list(range(1, 2 * order))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk in chunks(batches, order):
            yield chunk.rows(part, buckets, kinds, {k: c.astype("<i8") for k, c in chunk.counts.items()})

    gathered = saved(docs.mapInArrow(send, SENT).groupBy("kind", "bucket").applyInPandas(gather, GATHERED), "ngram-tables")
    stats: dict[int, list[int]] = {}
    for r in gathered.where("part = -1").select("kind", F.posexplode("stats")).groupBy("kind", "pos").agg(F.sum("col").alias("n")).orderBy("kind", "pos").collect():
        stats.setdefault(r.kind, []).append(r.n)
    model = Model(stats, order)
    counts = by_part(gathered.where("part >= 0").select("kind", "bucket", "part", "n", "counts", "owner"), "ngram-answers")
    weights: dict[int, str] = {}
    for k in range(2, order + 1):
        def sums(batches: Iterator[pa.RecordBatch], k: int = k, weights: dict[int, str] = dict(weights)) -> Iterator[pa.RecordBatch]:
            for part, chunk in chunks(batches, order):
                totals, owner = told(chunk, counts, part, kinds)
                gram, history = 2 * k - 1, 2 * k - 2
                use = np.flatnonzero(owner[gram] & (totals[gram] > 0))
                at = chunk.example(gram)[use]        # a token that ends in this n-gram
                h = chunk.at[history][at]
                lower = probabilities(chunk, part, model, totals, weights, k - 1)[at]
                seen = model.discounted(k, totals[gram][use]) / np.maximum(totals[history][h], 1)
                n = len(chunk.keys[history])
                values = np.column_stack([np.bincount(h, seen, minlength=n), np.bincount(h, lower, minlength=n), totals[history]]).astype("<f8")
                yield chunk.rows(part, buckets, [history], {history: values})

        weights[k] = by_part(docs.mapInArrow(sums, SENT).groupBy("kind", "bucket").applyInPandas(
            gather_backoff, "kind int, bucket int, part long, n long, values binary"), f"backoff-{k}")

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk in chunks(batches, order):
            totals, _ = told(chunk, counts, part, kinds)
            doc = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
            c = totals[1][chunk.at[1]]
            base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            p = np.log10(probabilities(chunk, part, model, totals, weights, order))
            n = len(chunk.sizes)
            cols = (pa.array(chunk.ids, pa.int64()), pa.array(chunk.held, pa.bool_()), pa.array(chunk.sizes), pa.array(np.bincount(doc, c > 0, n).astype(np.int64)),
                    pa.array(np.full(n, model.tokens, np.int64)), pa.array(np.bincount(doc, base, n)), pa.array(np.bincount(doc, p, n)))
            yield pa.RecordBatch.from_arrays(list(cols), names=[x.split()[0] for x in SCORED.split(", ")])

    return docs.mapInArrow(evaluate, SCORED)


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those of fold 0 of ten are not learned from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    return score(table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(fold != 0, F.lit(False)).alias("learn"), F.coalesce(fold == 0, F.lit(False)).alias("held")))
