"""Operator 7: nearest neighbours through an inverted multi-index.

Vectors are scaled to length 1 and cut into two halves; each half has its own
codebook of K centroids, so K * K cells partition the vectors with only 2 K
centroids to compare. A query walks the cells by rising sum of its two
half-distances, with a heap over the two sorted centroid lists (the
multi-sequence algorithm), until the cells hold its share of all vectors.
The entries of those cells are reranked by their exact cosine.

The codebooks are fitted on a bounded sample (``SAMPLE`` vectors drawn by the
hash of their id); every vector is indexed. The share is measured, not
guessed: for ``TRIALS`` sampled vectors the true neighbours in the sample are
found by brute force, and the share is what it takes to reach the ``RECALL`` of
them. Clustered vectors need a small part of the index; vectors without
structure (the test tables hold such) need a large one, whatever the index.

Cells that share their first centroid lie together. Such a row of cells is
dealt into chunks of ``CHUNK`` entries, and queries into blocks of ``BLOCK``, so
one task never holds more than a chunk and a block, however crowded a cell is;
it returns each query's best only. The driver holds the codebooks and one count
per cell.

Defined cases: vectors that are NULL, zero, of another length than most of the
sample, or hold NULL or non-finite components take no part, nor do NULL ids; a
query's own row is every row of its id; repeated rows are candidates each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready, saved, table

SAMPLE = 8192
MOST_CENTROIDS = 256
PER_CELL = 16
RECALL = 0.95
TRIALS = 256
LEAST_CANDIDATES = 1000
CHUNK = 4096
BLOCK = 4096
TURNS = 12


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part (but for the check of their length)."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which leave a cosine as it is, so that no square overflows or vanishes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True, initial=0))[1])


def kmeans(x: np.ndarray, k: int, turns: int = TURNS) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows; an empty one takes the row farthest from its own."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(turns):
        d = distances(x, c)
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        far = np.argsort(-d[np.arange(len(x)), own], kind="stable")
        for spare, row in zip(np.flatnonzero(n == 0), far, strict=False):
            c[spare] = x[row]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0)


class Books(NamedTuple):
    """Codebooks of the two halves, the dimension, and the share of all vectors a query visits."""
    first: np.ndarray
    second: np.ndarray
    dim: int
    share: float

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return distances(x[:, :half], self.first), distances(x[:, half:], self.second)


def fit(vectors: DataFrame, k: int) -> Books:
    """Fit on a bounded sample of ``usable`` vectors; ``k``: neighbours that queries will ask for."""
    n = vectors.count()
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column("embedding").to_pylist()
    if not got:
        return Books(np.zeros((1, 0)), np.zeros((1, 0)), 0, 1.0)
    dim = int(np.bincount([len(v) for v in got]).argmax())
    x = unit(np.array([v for v in got if len(v) == dim], np.float64))
    size = max(1, min(MOST_CENTROIDS, len(x), int(np.ceil(np.sqrt(n / PER_CELL)))))
    half = max(1, dim // 2)
    books = Books(kmeans(x[:, :half], size), kmeans(x[:, half:], size) if dim > half else np.zeros((1, 0)), dim, 1.0)
    return books._replace(share=needed_share(books, x, k))


def needed_share(books: Books, x: np.ndarray, k: int) -> float:
    """The share of the sample ``x`` that a walk holds when it has met RECALL of the true neighbours."""
    if len(x) <= k + 1:
        return 1.0
    a, b = books.halves(x)
    cell = a.argmin(axis=1) * len(books.second) + b.argmin(axis=1)
    counts = np.bincount(cell, minlength=len(books.first) * len(books.second))
    tried = np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)
    near = x[tried] @ x.T
    near[np.arange(len(tried)), tried] = -np.inf
    true = np.argpartition(near, -k, axis=1)[:, -k:]
    held = []
    for i, own in zip(tried, true, strict=True):
        order = np.argsort((a[i][:, None] + b[i][None, :]).ravel(), kind="stable")
        upto = np.empty(len(order), np.int64)
        upto[order] = np.cumsum(counts[order])
        held += upto[cell[own]].tolist()
    return float(np.quantile(held, RECALL)) / len(x)


def index(vectors: DataFrame, books: Books) -> DataFrame:
    """(vec_id, embedding, i, j) of every usable vector: the centroids of its halves."""
    parts = tuple(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Books(*parts)
        for batch in batches:
            batch = batch.filter(pa.array([len(v) == own.dim for v in batch.column(1)], pa.bool_()))
            if not batch.num_rows:
                continue
            a, b = own.halves(unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, own.dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a.argmin(axis=1).astype(np.int32)), pa.array(b.argmin(axis=1).astype(np.int32))],
                                             names=["vec_id", "embedding", "i", "j"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id long, embedding {kind}, i int, j int")


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells by rising ``a[i] + b[j]`` until they hold ``enough`` entries; empty ones are passed over."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[oa], b[ob]
    heap, seen, out, held = [(sa[0] + sb[0], 0, 0)], np.zeros(len(a), np.int64), [], 0
    seen[:] = -1  # the last column opened in each row
    seen[0] = 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(oa[i]) * len(b) + int(ob[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        if j + 1 < len(b):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
    return out


def best(queries: np.ndarray, q_ids: np.ndarray, wanted: np.ndarray, entries: np.ndarray, e_ids: np.ndarray, cells: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, entry, cosine) of each query's ``k`` nearest entries but its own, among entries whose
    cell it wants (``wanted``: queries x cells); equal vectors get equal numbers."""
    queries, entries = scaled(queries), scaled(entries)
    qn, en = np.linalg.norm(queries, axis=1), np.linalg.norm(entries, axis=1)
    qu, eu = queries / qn[:, None], entries / en[:, None]
    by_cell = [(c, np.flatnonzero(cells == c)) for c in np.unique(cells)]
    out = []
    for lo in range(0, len(queries), 512):
        hi = min(lo + 512, len(queries))
        near = np.full((hi - lo, len(entries)), -np.inf)
        for c, members in by_cell:
            asking = np.flatnonzero(wanted[lo:hi, c])
            if len(asking):
                near[np.ix_(asking, members)] = qu[lo:hi][asking] @ eu[members].T
        near[q_ids[lo:hi, None] == e_ids[None, :]] = -np.inf
        edge = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
        for i in range(len(near)):
            some = np.flatnonzero((near[i] >= edge[i] - 1e-9) & (near[i] > -np.inf))
            exact = (entries[some] * queries[lo + i]).sum(axis=1) / (qn[lo + i] * en[some])
            order = np.lexsort((e_ids[some], -exact))[:k]
            out += [(int(q_ids[lo + i]), int(e_ids[some[o]]), float(exact[o])) for o in order]
    return out


def search(vectors: DataFrame, query_step: int = 50, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for every vector whose id is divisible by ``query_step``."""
    spark = ready(vectors.sparkSession)
    rows = usable(vectors)
    books = fit(rows, k)
    parts, width = tuple(books), len(books.second)
    cells = saved(index(rows, books), "vector-index")
    counts = np.zeros(len(books.first) * width, np.int64)
    for r in cells.groupBy("i", "j").count().collect():  # one row a cell, MOST_CENTROIDS ** 2 at most
        counts[r.i * width + r.j] = r["count"]
    enough = max(LEAST_CANDIDATES, int(np.ceil(books.share * counts.sum())))
    chunks = np.maximum(1, -(-counts.reshape(-1, width).sum(axis=1) // CHUNK))
    is_query = F.col("vec_id") % query_step == 0
    q_blocks = max(1, -(-cells.where(is_query).count() // BLOCK))
    kind = cells.schema["embedding"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy() % chunks[batch.column("i").to_numpy()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(place.astype(np.int32))], names=["vec_id", "embedding", "i", "j", "chunk"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Books(*parts)
        for batch in batches:
            a, b = own.halves(unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, own.dim)))
            for lo in range(0, len(a), 256):
                rows, i_s, wanted, chunk = [], [], [], []
                for q in range(lo, min(lo + 256, len(a))):
                    asked = np.zeros(len(counts), bool)
                    asked[walk(a[q], b[q], counts, enough)] = True
                    asked = asked.reshape(-1, width)
                    for i in np.flatnonzero(asked.any(axis=1)).tolist():
                        bits = np.packbits(asked[i]).tobytes()
                        for part in range(int(chunks[i])):
                            rows.append(q)
                            i_s.append(i)
                            wanted.append(bits)
                            chunk.append(part)
                took = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([took.column("vec_id"), took.column("embedding"), pa.array(i_s, pa.int32()), pa.array(wanted, pa.binary()), pa.array(chunk, pa.int32())],
                                                 names=["query_id", "query", "i", "wanted", "chunk"])

    def rerank(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        wanted = np.unpackbits(np.frombuffer(b"".join(asked["wanted"]), np.uint8).reshape(len(asked), -1), axis=1)
        got = best(np.stack(asked["query"]).astype(np.float64), asked["query_id"].to_numpy(), wanted,
                   np.stack(held["embedding"]).astype(np.float64), held["vec_id"].to_numpy(), held["j"].to_numpy(), k)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    block = F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")
    entries = (cells.select("vec_id", "embedding", "i", "j", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).alias("place"))
               .mapInArrow(deal, f"vec_id long, embedding {kind}, i int, j int, chunk int")
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    asked = (cells.where(is_query).select("vec_id", "embedding")
             .mapInArrow(visit, f"query_id long, query {kind}, i int, wanted binary, chunk int").withColumn("block", block))
    found = (asked.groupBy("i", "chunk", "block").cogroup(entries.groupBy("i", "chunk", "block"))
             .applyInPandas(rerank, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings"))
