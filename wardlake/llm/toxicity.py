"""Operator 10: toxicity by a linear classifier on character n-grams that are
scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of a text inside its words (a word
keeps one blank on either side; letters are lower-cased, other signs count as
blanks), hashed to ``BUCKETS``. From labelled rows,

* ``r = log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2))`` per bucket, with p of
  the P toxic and q of the Q other texts holding it;
* the ``FEATURES`` buckets with the strongest association (likelihood ratio)
  are kept and a logistic regression with an L2 penalty is fitted on the
  values ``r`` of those a text has.

A score is one table look-up per n-gram: the table (``BUCKETS`` numbers, of
fixed size) goes to every task, texts are read once, nothing is shuffled.

The classifier is fitted on at most ``SAMPLE`` labelled rows, drawn by the
hash of their doc_id (and of their place, where rows repeat doc_ids beyond that number). Counting and feature extraction run on Spark; the driver
gets ``FEATURES`` counts and, for each sampled row, the numbers of its kept
features.

Defined cases: NULL and empty texts have no feature and score the intercept's
probability; NULL labels and labels without a document are not used; a NULL
doc_id is scored and never used in learning; repeated rows count each; with
no labelled rows of either class every score is the share of toxic rows (0 if
there are none); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, mix64, ready, saved, slices, table, worker_state

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 20
FEATURES = 20_000
SAMPLE = 20_000
LEAST_TEXTS = 3
PENALTY = 1e-4
ROUNDS = 400
FIT_ROWS = 512
BLOCK_CHARS = 1 << 17        # characters whose n-grams are in memory at once


def _alphabet() -> np.ndarray:
    """Letters and digits of the first plane as they are, every other sign of it as a blank."""
    return np.array([c if chr(c).isalnum() else 32 for c in range(1 << 16)], np.uint32)


def text_grams(texts: list[str | None], kept: np.ndarray | None = None, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, bucket) of every n-gram inside a word, with repeats; only buckets with ``kept`` if given.
    ``buckets`` is a power of two."""
    alphabet = worker_state("alphabet", _alphabet)
    low = [f" {t.lower()} " if t else "" for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    plane = codes < 1 << 16
    codes = np.where(plane, alphabet[np.where(plane, codes, 0)], codes).astype(np.uint64)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    blank = np.concatenate([[0], np.cumsum(codes == 32)])
    at, found = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(sizes) + 1):
        if n > len(codes):
            break
        h = h[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:]
        if n in sizes:
            m = len(h)
            inner = blank[n - 1:n - 1 + m] == blank[1:m + 1]  # no blank but at the ends
            ok = np.flatnonzero(inner & (owner[:m] == owner[n - 1:]))
            own = (mix64(h[ok] + np.uint64(n)) & np.uint64(buckets - 1)).astype(np.int64)
            if kept is not None:                 # what has no weight goes before the sizes are joined
                use = np.flatnonzero(kept[own])
                ok, own = ok[use], own[use]
            at.append(owner[ok])
            found.append(own)
    if not at:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(at), np.concatenate(found)


def distinct_grams(texts: list[str | None], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, bucket), each pair once; only buckets with ``kept`` if given."""
    at, found = text_grams(texts, kept)
    key = np.unique(at.astype(np.int64) * BUCKETS + found)
    return key // BUCKETS, key % BUCKETS


@dataclass
class LinearModel:
    """``weight`` per bucket (already times its ratio, 0 where not kept) and the intercept."""
    weight: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        at, found = distinct_grams(texts, self.weight != 0)
        z = self.intercept + np.bincount(at, self.weight[found], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(parts: list[tuple[np.ndarray, np.ndarray]], values: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Logistic regression of sparse rows by full-batch Adam; deterministic. ``parts``: (number of each row's
    features, their columns) of consecutive blocks of rows; the value of a feature is ``values[col]``."""
    w, b = np.zeros(n), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        x, g, gb, a = w * values, np.zeros(n), 0.0, 0
        for size, cols in parts:                 # a block of rows at a time, so that memory stays small
            z, some = np.full(len(size), b), np.flatnonzero(size)
            if len(some):
                z[some] += np.add.reduceat(x[cols], (np.cumsum(size) - size)[some])
            e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[a:a + len(size)]) / len(y)
            g += np.bincount(cols, np.repeat(e, size), minlength=n)
            gb += e.sum()
            a += len(size)
        g = g * values + PENALTY * w
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * min(1.0, 3 * (1 - t / (ROUNDS + 1)))
        fix = np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def held_out(doc_id: Column | str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % folds == 0


def drawn(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The ``most`` rows with the least hashes of ``key`` (ties by ``order``). A threshold taken from the number of rows
    lets about ``most`` of them through, so that no task sorts more than these."""
    n = rows.count()
    if n <= most:
        return rows
    share = min(1.0, 1.1 * most / n + 200 / n)
    return rows.where(F.xxhash64(key) <= min(2 ** 63 - 1, int(share * 2 ** 64) - 2 ** 63)).orderBy(F.xxhash64(key), *order).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int | None) -> DataFrame:
    """At most ``most`` rows (doc_id, y, text) with a label, outside fold 0 of the doc_id's checksum; written once."""
    own = labels.select(F.col("doc_id").alias("labelled_id"), F.col(label).cast("int").alias("y")).where("labelled_id is not null and y is not null")
    if folds:
        own = own.where(~held_out("labelled_id", folds))
    chosen = drawn(own, "labelled_id", ["labelled_id", "y"], most)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))  # ``most`` labels at most
    sample = saved(joined.select("doc_id", "y", "text", F.monotonically_increasing_id().alias("at")), "labelled-sample")
    if sample.count() > most:                    # rows that repeat a doc_id
        sample = sample.join(F.broadcast(drawn(sample.select("at"), "at", ["at"], most)), "at", "left_semi")
    return sample.select("doc_id", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, folds: int | None = 5) -> LinearModel:
    """Fit on a bounded sample of ``labels(doc_id, label)`` joined to ``docs(doc_id, text)``."""
    spark = ready(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, most, folds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = np.zeros((2, BUCKETS), np.int64)
        total = np.zeros(2, np.int64)
        for batch in slices(batches):
            y, text = batch.column("y").to_numpy() > 0, batch.column("text").to_pylist()
            total += (int((~y).sum()), int(y.sum()))
            for a, b in blocks(text, BLOCK_CHARS):
                at, found = distinct_grams(text[a:b])
                pos = y[a:b][at]
                texts[1] += np.bincount(found[pos], minlength=BUCKETS)
                texts[0] += np.bincount(found[~pos], minlength=BUCKETS)
        some = np.flatnonzero(texts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(texts[0][some], total[0])), pa.array(np.append(texts[1][some], total[1]))],
                                         names=["bucket", "other", "toxic"])

    sums = sample.mapInArrow(count, "bucket long, other long, toxic long").groupBy("bucket").agg(
        F.sum("other").alias("q"), F.sum("toxic").alias("p")).cache()
    totals = [(r.q, r.p) for r in sums.where("bucket = -1").collect()]
    n_other, n_toxic = totals[0] if totals else (0, 0)
    if not n_other or not n_toxic:
        sums.unpersist()
        share = n_toxic / (n_other + n_toxic) if totals and (n_other + n_toxic) else 0.0
        return LinearModel(np.zeros(BUCKETS), 500.0 if share == 1 else -500.0)
    n = n_other + n_toxic

    def part(k: Column, rows: Column, cols: int) -> Column:
        return F.when(k > 0, k * F.log(k * n / (rows * cols))).otherwise(0.0)

    p, q = F.col("p"), F.col("q")
    strength = (part(p, p + q, n_toxic) + part(q, p + q, n_other)
                + part(n_toxic - p, n - p - q, n_toxic) + part(n_other - q, n - p - q, n_other))
    best = sums.where((F.col("bucket") >= 0) & (p + q >= LEAST_TEXTS) & (p + q < n)).orderBy(strength.desc(), "bucket").limit(FEATURES).toArrow()
    sums.unpersist()
    chosen, in_other, in_toxic = (best.column(c).to_numpy() for c in ("bucket", "q", "p"))
    ratio = np.log((in_toxic + 1) / (n_toxic + 2)) - np.log((in_other + 1) / (n_other + 2))
    number = np.full(BUCKETS, -1, np.int32)
    number[chosen] = np.arange(len(chosen), dtype=np.int32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = number >= 0
        for batch in slices(batches):
            text, out = batch.column("text").to_pylist(), []
            for a, b in blocks(text, BLOCK_CHARS):
                at, found = distinct_grams(text[a:b], kept)
                out += [x.tobytes() for x in np.split(number[found].astype("<u2"), np.searchsorted(at, np.arange(1, b - a)))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(out, pa.binary())], names=["y", "f"])

    if len(chosen) > 1 << 16:
        raise ValueError("columns are kept in 16 bits")
    rows = sample.mapInArrow(features, "y int, f binary").toArrow()  # ``most`` rows at most
    y = (rows.column("y").to_numpy() > 0).astype(float)
    found = (rows.column("f").slice(a, FIT_ROWS).to_pylist() for a in range(0, len(y), FIT_ROWS))
    parts = [(np.array([len(x) // 2 for x in f]), np.frombuffer(b"".join(f), "<u2")) for f in found]
    del rows
    w, b = fit_logistic(parts, ratio, y, len(chosen))
    weight = np.zeros(BUCKETS)
    weight[chosen] = w * ratio
    return LinearModel(weight, b)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: LinearModel, extra: tuple[str, ...] = ()) -> DataFrame:
    """``score`` and ``predicted`` of every row of ``docs(doc_id, text)``, with the columns ``extra`` kept."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.weight, model.intercept))  # BUCKETS numbers, whatever the corpus size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            s = np.concatenate([LinearModel(*shared.value).scores(texts[a:b]) for a, b in blocks(texts, BLOCK_CHARS)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=[*kept, "score", "predicted"])

    kept = list(dict.fromkeys((*extra, "text"))) if "text" in extra else list(extra)
    inner = docs.select(*dict.fromkeys((*kept, "text")))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in inner.select(*kept).schema]
    return inner.mapInArrow(run, ", ".join([*schema, "score double", "predicted int"]))


def without_toxic(docs: DataFrame, model: LinearModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, all columns as they are."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.weight, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            keep = [x < least for a, b in blocks(texts, BLOCK_CHARS) for x in LinearModel(*shared.value).scores(texts[a:b]).tolist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels of fold 0 are never read."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return (score(docs.select("doc_id", "text"), model, ("doc_id",))
            .select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted"))
