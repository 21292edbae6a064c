"""Operator 1: graded text quality by ordinal cumulative-link regression.

Ratings are grades 0..K-1. One weight vector over hashed features of the text
gives a position s; ordered thresholds t_1 < ... < t_(K-1) turn it into the
tail probabilities ``P(grade >= k) = 1 / (1 + exp(t_k - s))``, whose sum is the
expected grade. A text is selected if its tail probability at a chosen grade
reaches a chosen level.

Features, hashed into one table:

* the distinct character n-grams of words (as in ``toxicity.text_grams``), of
  those the ``FEATURES`` that are most associated with a grade;
* *shapes*: runs of lower-case, upper-case, digits and blanks count as one sign
  each, other signs as themselves; relative frequencies of 1 to 4 such signs;
* binned statistics: length, mean word length, distinct words, words that
  repeat the word before, distinct lines, upper-case words.

The model is fitted on at most ``SAMPLE`` rated rows drawn by the hash of
their doc_id, the rest as in ``toxicity``: extraction on Spark, one table look-up per
feature when scoring, no shuffle of texts.

Defined cases: NULL and empty texts have only their length bin; NULL ratings
and ratings without a document are not used; a NULL doc_id is scored and never
used in learning; repeated rows count each; with no ratings, or all of one
grade, every expected grade is that grade (0 if there are none); other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, mix64, ready, slices, table, worker_state
from .toxicity import BLOCK_CHARS, BUCKETS, FIT_ROWS, distinct_grams, held_out, labelled_sample

FEATURES = 20_000
SAMPLE = 20_000
LEAST_TEXTS = 3
SHAPES = 1 << 14            # buckets of shapes and statistics, after those of n-grams
SHAPE_SCALE = 10.0
PENALTY = 1e-5
ROUNDS = 300
LEAST_GRADE, LEAST_TAIL = 1, 0.5


def _classes() -> np.ndarray:
    out = np.arange(16, 16 + (1 << 16), dtype=np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if s.islower():
            out[c] = 1
        elif s.isupper():
            out[c] = 2
        elif s.isdigit():
            out[c] = 3
        elif s == "\n":
            out[c] = 4
        elif s.isspace():
            out[c] = 5
        elif s.isalpha():
            out[c] = 6
    return out


def shapes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 1 to 4 signs: (index of the text, bucket) of every shape with repeats, and what one counts in each text."""
    classes = worker_state("classes", _classes)
    size = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    cls = classes[np.minimum(codes, 65535)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    new = np.ones(len(cls), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (cls[1:] >= 16) | (owner[1:] != owner[:-1])
    seq, own = cls[new].astype(np.uint64), owner[new]
    h = np.zeros(len(seq), np.uint64)
    for n in range(1, 5):
        if n > len(seq):
            break
        h = h[:len(seq) - n + 1] * np.uint64(0x100000001B3) + seq[n - 1:]
        ok = np.flatnonzero(own[:len(h)] == own[n - 1:])
        o = own[ok]
        share = SHAPE_SCALE / np.maximum(np.bincount(o, minlength=len(texts)), 1)
        yield o, (mix64(h[ok] + np.uint64(n << 50)) & np.uint64(SHAPES - 1)).astype(np.int64), share


def statistics(texts: list[str]) -> np.ndarray:
    """Buckets of the binned statistics, a row per text."""
    stats = np.zeros((len(texts), 6), np.int64)
    for i, t in enumerate(texts):
        words, lines = t.split(), t.split("\n")
        n = len(words)
        length = min(15, n.bit_length())
        again = sum(map(str.__eq__, words, words[1:])) / n if n else 0.0
        upper = sum(map(str.isupper, words)) / n if n else 0.0
        stats[i] = (length, length * 16 + int(15 * len(set(words)) / n) if n else 0, min(15, int(40 * again)),
                    min(30, len(t) // n) if n else 31, int(15 * len(set(lines)) / len(lines)), min(15, int(30 * upper)))
    name = np.arange(stats.shape[1], dtype=np.int64) * 4096 + (1 << 40)
    return (mix64((stats + name).ravel()) & np.uint64(SHAPES - 1)).astype(np.int64).reshape(stats.shape)


def shape_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, bucket, value) of shapes and statistics, each bucket of a text once."""
    texts = [t or "" for t in texts]
    at, bucket, value = [], [], []
    for o, b, share in shapes(texts):
        at.append(o.astype(np.int64))
        bucket.append(b)
        value.append(share[o])
    stats = statistics(texts)
    at.append(np.repeat(np.arange(len(texts)), stats.shape[1]))
    bucket.append(stats.ravel())
    value.append(np.ones(stats.size))
    key, inverse = np.unique(np.concatenate(at) * SHAPES + np.concatenate(bucket), return_inverse=True)
    return key // SHAPES, key % SHAPES, np.bincount(inverse, np.concatenate(value))


def tails(position: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1..K-1, a column each."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - position[:, None], -500, 500)))


def positions(weight: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """s of each text: one pass over its n-grams and shapes. ``weight`` covers BUCKETS + SHAPES."""
    grams, own = weight[:BUCKETS], weight[BUCKETS:]
    at, found = distinct_grams(texts, grams != 0)
    s = np.bincount(at, grams[found], minlength=len(texts)).astype(float)
    texts = [t or "" for t in texts]
    for o, found, share in shapes(texts):
        s += np.bincount(o, own[found], minlength=len(texts)) * share
    return s + own[statistics(texts)].sum(axis=1)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, grades: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``fit_blocks`` of the features given as (row, column, value)."""
    m = len(grade)
    order = np.argsort(rows, kind="stable")
    rows, cols, values = rows[order], cols[order], values[order]
    edges = [*range(0, m, FIT_ROWS), m]
    at = np.searchsorted(rows, edges)
    return fit_blocks([(a, b, [(np.bincount(rows[x:y] - a, minlength=b - a), cols[x:y], values[x:y])])
                       for a, b, x, y in zip(edges, edges[1:], at, at[1:], strict=False)], grade, grades, n)


def fit_blocks(parts: list[tuple], grade: np.ndarray, grades: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the likelihood of the grades; deterministic.

    ``parts``: (a, b, features) of the rows a to b - 1, where features are (number of each row's, columns, values or
    None if all are 1), row by row. The thresholds are t_1 and the logarithms of the steps between them, so they stay ordered."""
    m = len(grade)
    above = np.clip([(grade >= k).mean() for k in range(1, grades)], 1e-4, 1 - 1e-4)
    first = -np.log(above / (1 - above))
    theta = np.concatenate([np.zeros(n), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    mom, var = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, ROUNDS + 1):
        w, steps = theta[:n], np.exp(theta[n + 1:])
        cuts = theta[n] + np.concatenate([[0.0], np.cumsum(steps)])
        gw, dcut = PENALTY * w, np.zeros(grades + 1)
        for a, b, own_features in parts:         # a block of rows at a time, so that memory stays small
            s, y, i = np.zeros(b - a), grade[a:b], np.arange(b - a)
            for size, c, v in own_features:
                some = np.flatnonzero(size)
                if len(some):
                    s[some] += np.add.reduceat(w[c] if v is None else w[c] * v, (np.cumsum(size) - size)[some])
            p = np.hstack([np.ones((b - a, 1)), tails(s, cuts), np.zeros((b - a, 1))])
            own = np.maximum(p[i, y] - p[i, y + 1], 1e-12)
            slope = p * (1 - p)                  # of a tail in s
            ds = -(slope[i, y] - slope[i, y + 1]) / own / m
            np.add.at(dcut, y, slope[i, y] / own / m)
            np.add.at(dcut, y + 1, -slope[i, y + 1] / own / m)
            for size, c, v in own_features:
                d = np.repeat(ds, size)
                gw += np.bincount(c, d if v is None else d * v, minlength=n)
        dcut = dcut[1:grades]
        after = np.cumsum(dcut[::-1])[::-1]
        g = np.concatenate([gw, after[:1], after[1:] * steps])
        mom, var = 0.9 * mom + 0.1 * g, 0.999 * var + 0.001 * g * g
        rate = 0.05 * min(1.0, 3 * (1 - t / (ROUNDS + 1)))
        theta = theta - rate * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t) * mom / (np.sqrt(var) + 1e-8)
    return theta[:n], theta[n] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n + 1:]))])


def fit(docs: DataFrame, ratings: DataFrame, grades: int, most: int = SAMPLE, folds: int | None = 5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from ``ratings(doc_id, grade)`` joined to ``docs(doc_id, text)``."""
    spark = ready(docs.sparkSession)
    sample = labelled_sample(docs, ratings.where(F.col("grade").between(0, grades - 1)), "grade", most, folds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, total = np.zeros((grades, BUCKETS), np.int64), np.zeros(grades, np.int64)
        for batch in slices(batches):
            y, text = batch.column("y").to_numpy(), batch.column("text").to_pylist()
            total += np.bincount(y, minlength=grades)
            for a, b in blocks(text, BLOCK_CHARS):
                at, found = distinct_grams(text[a:b])
                for k in range(grades):
                    texts[k] += np.bincount(found[y[a:b][at] == k], minlength=BUCKETS)
        some = np.flatnonzero(texts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), *(pa.array(np.append(texts[k][some], total[k])) for k in range(grades))],
                                         names=["bucket", *(f"g{k}" for k in range(grades))])

    names = [f"g{k}" for k in range(grades)]
    sums = (sample.mapInArrow(count, "bucket long, " + ", ".join(f"{c} long" for c in names))
            .groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).cache())
    total = next(([r[c] for c in names] for r in sums.where("bucket = -1").collect()), [0] * grades)
    if sum(x > 0 for x in total) < 2:
        sums.unpersist()
        only = int(np.argmax(total)) if any(total) else 0
        return np.zeros(BUCKETS + SHAPES), np.where(np.arange(1, grades) <= only, -500.0, 500.0)
    n, held = sum(total), sum((F.col(c) for c in names), F.lit(0))
    strength = F.lit(0.0)
    for k, c in enumerate(names):
        for part, rows in ((F.col(c), held), (F.lit(total[k]) - F.col(c), F.lit(n) - held)):
            strength = strength + F.when((part > 0) & (rows > 0), part * F.log(part * n / (rows * max(total[k], 1)))).otherwise(0.0)
    best = sums.where((F.col("bucket") >= 0) & (held >= LEAST_TEXTS) & (held < n)).orderBy(strength.desc(), "bucket").limit(FEATURES).select("bucket").toArrow()
    sums.unpersist()
    chosen = best.column("bucket").to_numpy().astype(np.int64)
    number = np.full(BUCKETS, -1, np.int32)
    number[chosen] = np.arange(len(chosen), dtype=np.int32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = number >= 0
        for batch in slices(batches):
            text, grams, cols, vals = batch.column("text").to_pylist(), [], [], []
            for a, b in blocks(text, BLOCK_CHARS):
                at, found = distinct_grams(text[a:b], kept)
                grams += [x.tobytes() for x in np.split(number[found].astype("<u2"), np.searchsorted(at, np.arange(1, b - a)))]
                at, found, value = shape_features(text[a:b])
                cut = np.searchsorted(at, np.arange(1, b - a))
                cols += [x.tobytes() for x in np.split((found + len(chosen)).astype("<u2"), cut)]
                vals += [x.tobytes() for x in np.split(value.astype("<f4"), cut)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(x, pa.binary()) for x in (grams, cols, vals))], names=["y", "grams", "cols", "vals"])

    if len(chosen) + SHAPES > 1 << 16:
        raise ValueError("columns are kept in 16 bits")
    got = sample.mapInArrow(features, "y int, grams binary, cols binary, vals binary").toArrow()  # ``most`` rows at most
    y = got.column("y").to_numpy().astype(np.int64)
    parts = []
    for a in range(0, len(y), FIT_ROWS):
        block = {c: got.column(c).slice(a, FIT_ROWS).to_pylist() for c in ("grams", "cols", "vals")}
        size = {c: np.array([len(x) // 2 for x in block[c]]) for c in ("grams", "cols")}
        data = {c: np.frombuffer(b"".join(x), "<f4" if c == "vals" else "<u2") for c, x in block.items()}
        parts.append((a, min(a + FIT_ROWS, len(y)), [(size["grams"], data["grams"], None), (size["cols"], data["cols"], data["vals"])]))
    del got
    w, cuts = fit_blocks(parts, y, grades, len(chosen) + SHAPES)
    weight = np.zeros(BUCKETS + SHAPES)
    weight[chosen] = w[:len(chosen)]
    weight[BUCKETS:] = w[len(chosen):]
    return weight, cuts


def grade(docs: DataFrame, weight: np.ndarray, thresholds: np.ndarray, extra: tuple[str, ...] = (),
          least_grade: int = LEAST_GRADE, least_tail: float = LEAST_TAIL) -> DataFrame:
    """``docs(doc_id, text)`` with ``expected_grade``, ``tail`` (P of at least ``least_grade``), ``tails`` and ``selected``; columns ``extra`` kept."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast((weight, thresholds))  # of fixed size, whatever the corpus
    kept = list(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts = shared.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            s = np.concatenate([positions(w, texts[a:b]) for a, b in blocks(texts, BLOCK_CHARS)]) if texts else np.zeros(0)
            p = tails(s, cuts)
            tail = p[:, least_grade - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p.sum(axis=1)), pa.array(tail), pa.array(list(p), pa.list_(pa.float64())), pa.array(tail >= least_tail)],
                                             names=[*kept, "expected_grade", "tail", "tails", "selected"])

    inner = docs.select(*dict.fromkeys((*kept, "text")))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in inner.select(*kept).schema]
    return inner.mapInArrow(run, ", ".join([*schema, "expected_grade double", "tail double", "tails array<double>", "selected boolean"]))


def selected(docs: DataFrame, weight: np.ndarray, thresholds: np.ndarray, least_grade: int = LEAST_GRADE, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of ``docs`` whose P(grade >= ``least_grade``) reaches ``least_tail``, all columns as they are."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast((weight, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts = shared.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            keep = [x >= least_tail for a, b in blocks(texts, BLOCK_CHARS) for x in tails(positions(w, texts[a:b]), cuts)[:, least_grade - 1].tolist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


GRADES = 3


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 low quality, 1 good text that is toxic, 2 good and not toxic (a NULL toxic mark: not)."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).cast("int").alias("grade"))


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every document; ratings of fold 0 are never read."""
    docs = table(spark, sf_dir, "documents")
    weight, cuts = fit(docs, ratings(table(spark, sf_dir, "labels")), GRADES)
    return (grade(docs.select("doc_id", "text"), weight, cuts, ("doc_id",))
            .select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "expected_grade",
                    F.col("tails")[0].alias("p_grade_1"), F.col("tails")[1].alias("p_grade_2"), "selected"))
