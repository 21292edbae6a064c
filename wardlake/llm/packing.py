"""Operator 2: packing pieces of documents into sequences by patterns.

1. *Pieces.* Every text is tokenized and cut into pieces of at most
   ``capacity`` ids (only longer documents are cut). The pieces are written
   once, each with its task's number and its rank among the task's pieces of
   the same length, so no later step needs to sort or number all of them.
2. *Plan.* The histogram of piece lengths has ``capacity`` entries whatever the
   corpus size; ``plan`` works on it alone. Lengths are rounded up to
   ``GRAIN``-token bins, all patterns of up to ``MOST_PARTS`` bins that fill a
   sequence are enumerated, and their repeat counts are fitted to the binned
   histogram by non-negative least squares. Counts are rounded down and the
   patterns filled with actual lengths, the longest of each bin first and the
   last place by best fit; what is left (residuals) goes by best fit
   decreasing into the room of the planned sequences or into new ones. All
   this is done for runs of equal sequences, not for single pieces: the plan
   has at most a few entries per length and pattern.
3. *Places.* Each piece finds its sequence by its length and its rank among
   all pieces of that length: the rank in its task plus the number of such
   pieces in earlier tasks (a running sum over tasks, a window per length).

No group of pieces is ever gathered; a length that a third of all pieces share
is only a number in the histogram.

Defined cases: a NULL text is empty and still has the end id; repeated rows
are packed each; a NULL doc_id is kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, ready, saved, slices, table
from .tokens import encoder

CAPACITY = 4096
GRAIN = 64
MOST_PARTS = 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of ``docs(doc_id, text)``; see the module text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part, seen = encoder(tokenizer), struct.pack("<I", end_id), TaskContext.get().partitionId(), {}
        for batch in slices(batches, uses="encoder:"):
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cols: list[list] = [[] for _ in range(7)]
            for a, b in blocks(texts):
                for doc_id, ids in zip(doc_ids[a:b], enc.ids(texts[a:b]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at:at + 4 * capacity]
                        n = len(own) // 4
                        rank = seen.get(n, 0)
                        seen[n] = rank + 1
                        for c, v in zip(cols, (doc_id, piece, at // 4, n, zlib.crc32(own), part, rank), strict=True):
                            c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=[x.split()[0] for x in PIECES.split(", ")])

    ready(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def patterns(total: int, parts: int, most: int | None = None) -> list[tuple[int, ...]]:
    """All ways to write ``total`` as a sum of at most ``parts`` numbers, largest first."""
    if total == 0:
        return [()]
    if parts == 0:
        return []
    top = min(total, most or total)
    return [(x, *rest) for x in range(top, 0, -1) if x * parts >= total for rest in patterns(total - x, parts - 1, x)]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """min |a x - b| with x >= 0, by the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= slack:
            break
        free[j] = True
        while True:
            cols = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[cols] = z
                break
            bad = z <= 1e-12
            step = np.min(x[cols][bad] / np.maximum(x[cols][bad] - z[bad], 1e-300), initial=1.0)
            x[cols] += step * (z - x[cols])
            free[cols[x[cols] <= 1e-10]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


class Stock:
    """Numbers of pieces left, by length; finds the longest length not above a bound."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, c in counts.items():
            self.n[length] = c

    def longest(self, below: int, above: int = 0) -> int:
        """The longest length in (above, below] with pieces left, or 0."""
        got = np.flatnonzero(self.n[above + 1:below + 1])
        return int(got[-1]) + above + 1 if len(got) else 0


def plan(counts: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN, most_parts: int = MOST_PARTS) -> list[tuple[int, list[int]]]:
    """Runs of equal sequences, (how many, the lengths in each), that hold exactly ``counts`` pieces of each length."""
    stock = Stock(counts, capacity)
    runs: list[tuple[int, list[int]]] = []
    if stock.n[capacity]:
        runs.append((int(stock.n[capacity]), [capacity]))
        stock.n[capacity] = 0
    n_bins = -(-capacity // grain)
    if not stock.n.any():
        return runs
    binned = np.zeros(n_bins + 1)
    np.add.at(binned, -(-np.arange(capacity + 1) // grain), stock.n)
    ways = [p for p in patterns(n_bins, most_parts) if all(binned[x] for x in p)]
    if ways:
        a = np.zeros((n_bins, len(ways)))
        for j, p in enumerate(ways):
            for x in p:
                a[x - 1, j] += 1
        weight = np.sqrt(np.arange(1, n_bins + 1))  # long pieces are harder to place later
        fit = nnls(a * weight[:, None], binned[1:] * weight)
        for j in np.argsort(-fit):
            left = int(fit[j])
            while left > 0:
                lengths, room, taken = [], capacity, {}
                for x in ways[j][:-1]:
                    spare = stock.n
                    got = next((g for g in range(min(x * grain, room), (x - 1) * grain, -1) if spare[g] > taken.get(g, 0)), 0)
                    if not got:
                        break
                    lengths.append(got)
                    taken[got] = taken.get(got, 0) + 1
                    room -= got
                else:
                    while room:  # the last place by best fit, and what still fits beside it
                        got = stock.longest(room)
                        while got and stock.n[got] <= taken.get(got, 0):
                            got = stock.longest(got - 1)
                        if not got:
                            break
                        lengths.append(got)
                        taken[got] = taken.get(got, 0) + 1
                        room -= got
                    if not taken:
                        break
                    times = min(left, *(int(stock.n[g]) // k for g, k in taken.items()))
                    runs.append((times, lengths))
                    for g, k in taken.items():
                        stock.n[g] -= times * k
                    left -= times
                    continue
                break
    return _best_fit(stock, runs, capacity)


def _best_fit(stock: Stock, runs: list[tuple[int, list[int]]], capacity: int) -> list[tuple[int, list[int]]]:
    """Residuals, longest first: each into the sequences with the least room that still hold it, else into new ones."""
    by_room: dict[int, list[list]] = {}
    for times, lengths in runs:
        by_room.setdefault(capacity - sum(lengths), []).append([times, lengths])
    for length in range(capacity, 0, -1):
        left = int(stock.n[length])
        for room in sorted(r for r in by_room if r >= length):
            while left and room >= length and by_room.get(room):
                times, lengths = by_room[room].pop()
                fill = room // length
                use = min(times, left // fill)
                if use == 0:
                    fill, use = left, 1
                if use < times:
                    by_room[room].append([times - use, lengths])
                by_room.setdefault(room - fill * length, []).append([use, lengths + [length] * fill])
                left -= use * fill
            if not left:
                break
        per = capacity // length
        if left // per:
            by_room.setdefault(capacity - per * length, []).append([left // per, [length] * per])
        if left % per:
            by_room.setdefault(capacity - left % per * length, []).append([1, [length] * (left % per)])
    return [(times, lengths) for room in sorted(by_room) for times, lengths in by_room[room]]


def places(runs: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: pieces of ``length`` with ranks from ``rank`` on lie
    in the sequences from ``sequence`` on, each at ``offset``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in runs:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "sequence", "offset"))}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of ``pieces`` (as ``cut_pieces`` makes them, and saved) its sequence and offset."""
    spark = pieces.sparkSession
    by_task = saved(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    at = places(plan(counts, capacity))
    key = at["length"] << np.int64(44) | at["rank"]
    before = by_task.select(F.col("part").alias("p"), F.col("length").alias("l"), (F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, length << np.int64(44) | rank, "right") - 1
            cols = [b.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at["sequence"][i] + rank - at["rank"][i]), pa.array(at["offset"][i])],
                                             names=[x.split()[0] for x in PLACED.split(", ")])

    ready(spark)
    joined = pieces.join(before, (pieces.part == before.p) & (pieces.length == before.l)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return joined.mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Cut and pack ``docs(doc_id, text)``: a row per piece with its sequence and offset."""
    return pack(saved(cut_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through ``word_bpe_49k.json`` with end id 1 into sequences of 4096."""
    import public_tokenizers
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
