"""Operator 13: spelling variants found by a sorted-list edit-distance scan.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. A sorted list of words is scanned for each of its words: the rows
of the edit matrix (three cells around the diagonal, as one edit leaves no
others) are kept for the current prefix, a list entry that shares its first k signs
with the entry before goes on from row k, and where a row has no cell of at
most one edit, all entries that share that prefix are skipped.

No list holds the whole vocabulary. Let m be the length of a pair's shorter
word. The edit lies either behind its first m // 2 signs, which both words then
share, or before its last m - m // 2, which they then share. So every word goes
to the lists of m = its length and its length - 1 by both shares. A list of more than
``MOST`` words is split in the same way again: what is not shared yet is halved, and
each word goes to both halves' lists. Every split leaves fewer free signs; with one free
sign a list is bounded by the alphabet. Of a pair's lists exactly one returns it
(the side of each split is told by the length of its common prefix).

``variants`` takes any table of words with counts; ``vocabulary`` counts the runs of
letters of texts on Spark, with partial sums, so a frequent word costs one row a task.

Defined cases: NULL and empty texts have no runs; a NULL doc_id counts as the text
``null``; a run of any length is one word; rows that repeat count each; NULL words
and words without signs are not in the result; a word given twice has the sum of its
counts; ties of a form go to the smallest word in code-point order; other columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, saved, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
SLIP = 31            # a run loses a sign where this divides its checksum
RATIO = 10
MOST = 100


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of the letter runs of ``docs(doc_id, text)``, one sign lost where ``slip`` divides the run's checksum."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("d"),
                       F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    low = runs.select("d", F.translate("run", UPPER, LOWER).alias("run"))
    summed = low.select("run", F.length("run").alias("size"), F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = summed.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# ------------------------------------------------------------------ the scan of one list
def common_prefix(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    return k


def scan(words: list[str], shared: list[int], first: int) -> list[int]:
    """Entries from ``first`` on of the sorted list ``words`` within one edit of the entry before ``first``.

    ``shared[j]``: length of the common prefix of entries j - 1 and j. A row is the cells left of, on and right of the
    diagonal, counted to 2 at most."""
    q = words[first - 1]
    size = len(q)
    at = [*q, "", ""]                     # no sign equals the empty text
    rows = [(2, 0, 1)]
    found, dead = [], -1                  # ``dead``: the length of a prefix that is more than one edit away
    for j in range(first, len(words)):
        k = shared[j]
        if dead >= 0:
            if k >= dead:
                continue
            dead = -1
        if j == first:
            k = 0
        del rows[k + 1:]
        left, mid, right = rows[-1]
        k = len(rows) - 1
        w = words[j]
        for i in range(k, len(w)):
            if i > size + 1:
                dead = i
                break
            sign = w[i]
            a = left if i and at[i - 1] == sign else left + 1
            if mid < a:
                a = mid + 1 if mid + 1 < a else a
            b = mid if i < size and at[i] == sign else mid + 1
            if right + 1 < b:
                b = right + 1
            if a + 1 < b:
                b = a + 1
            c = right if i + 1 < size and at[i + 1] == sign else right + 1
            if b + 1 < c:
                c = b + 1
            if i >= size:                 # columns beyond the query do not exist
                b = 2
            if i + 1 >= size:
                c = 2
            if a > 1 and b > 1 and c > 1:
                dead = i + 1
                break
            left, mid, right = a, b, c
            rows.append((a, b, c))
        else:
            d = size - len(w)
            if -1 <= d <= 1 and (left, mid, right)[d + 1] <= 1:
                found.append(j)
    return found


def near_in_list(words: list[str], shorter: int, most_shared: int) -> Iterator[tuple[int, int]]:
    """Pairs of entries of a sorted list whose shorter word has ``shorter`` signs and that share fewer than ``most_shared`` first signs."""
    shared = [0, *(common_prefix(a, b) for a, b in zip(words, words[1:]))]
    for i in range(len(words) - 1):
        for j in scan(words, shared, i + 1):
            if min(len(words[i]), len(words[j])) == shorter and common_prefix(words[i], words[j]) < most_shared:
                yield i, j


# ------------------------------------------------------------------ lists on Spark
def _halved(rows: DataFrame) -> DataFrame:
    """Each row to the lists of both halves of what its list does not share yet."""
    free = F.col("m") - F.col("head") - F.col("tail")
    half = F.floor(free / 2).cast("int")
    sides = F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail"), F.col("most")),
                    F.struct(F.col("head"), (F.col("tail") + free - half).alias("tail"), (F.col("head") + half).alias("most")))
    out = rows.select("word", "n", "size", "m", F.explode(sides).alias("x")).select("word", "n", "size", "m", "x.*")
    key = F.concat_ws(":", "m", "head", "tail", F.concat(F.substr("word", F.lit(1), F.col("head")), F.substr("word", F.col("size") - F.col("tail") + 1, F.col("tail"))))
    return out.withColumn("key", key)


def lists(words: DataFrame, most: int = MOST, least_length: int = 1) -> DataFrame:
    """(key, word, n, size, m, head, tail, most): every word in its lists, none of which holds more than ``most`` words
    unless one sign alone is free in it."""
    start = words.select("word", "n", F.length("word").alias("size"))
    open_rows = _halved(start.select("*", F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("m")).where(F.col("m") >= least_length)
                        .select("*", F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit(2**31 - 1).alias("most")))
    done, free = None, F.col("m") - F.col("head") - F.col("tail")
    while True:
        open_rows = saved(open_rows, "spelling-lists")
        large = saved(open_rows.where(free > 1).groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > most).select("key"), "spelling-large")
        if large.isEmpty():
            return open_rows if done is None else done.unionByName(open_rows)
        small = open_rows.join(large, "key", "left_anti").select(*open_rows.columns)
        done = small if done is None else done.unionByName(small)
        open_rows = _halved(open_rows.join(large, "key", "left_semi"))


PAIRS = "word string, other string, n long"


def near_pairs(words: DataFrame, most: int = MOST, least_length: int = 1) -> DataFrame:
    """Every ordered pair (word, other, n of the other) of near words in ``words(word, n)``, once."""
    ready(words.sparkSession)
    held = lists(words, most, least_length)
    middle = F.substr("word", F.col("head") + 1, F.col("size") - F.col("head") - F.col("tail"))   # what a list shares adds no edit
    rows = held.select("key", "word", "n", middle.alias("middle"), (F.col("m") - F.col("head") - F.col("tail")).alias("shorter"),
                       (F.col("most") - F.col("head")).alias("most")).repartition("key").sortWithinPartitions("key", "middle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if len(own) > 1:
                for i, j in near_in_list([r[3] for r in own], own[0][4], own[0][5]):
                    for a, b in ((i, j), (j, i)):
                        out[0].append(own[a][1])
                        out[1].append(own[b][1])
                        out[2].append(own[b][2])

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "other", "n"])
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and own[0][0] != row[0]:
                    close()
                    own.clear()
                own.append(row)
            if len(out[0]) > 5000:
                yield flush()
        close()
        yield flush()

    return rows.mapInArrow(run, PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``: pointers double in length until each is at its last word. A form's
    count exceeds its word's, so there are no circles."""
    links = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def variants(words: DataFrame, ratio: int = RATIO, most: int = MOST, least_length: int = 1) -> DataFrame:
    """For each of ``words(word, n)``: its form (the near word of largest n, if that is at least ``ratio`` times its own n),
    the root that forms lead to, its count, the number of near words, and the form's count."""
    words = saved(words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "spelling-words")
    near = near_pairs(words, most, least_length).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    best_n = -F.col("best.less")
    ok = F.coalesce(best_n >= ratio * F.col("n"), F.lit(False))
    told = saved(words.join(near, "word", "left").select(
        "word", F.when(ok, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(ok, best_n).alias("form_n")), "spelling-forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_sorted_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of all documents."""
    return variants(vocabulary(table(spark, sf_dir, "documents")), least_length=LEAST_LENGTH)
