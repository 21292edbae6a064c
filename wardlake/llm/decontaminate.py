"""Operator 4: benchmark decontamination with a generalised suffix automaton.

The word sequences of all benchmark items go into one suffix automaton (words
are numbered; each item starts again at the root, so no match spans two
items). A document's words are streamed through it, and after each word the
automaton tells the longest match that ends there. Where it reaches
``window`` words, the last ``window`` words occur in an item; an item shorter
than that counts as one window of its whole length. Words inside any such
window are *hit*.

Automaton states know which items hold their window, so the items of a hit come
with it. ``clean`` cuts the hit spans out of a text, or rejects the text when the
hit share reaches a limit.

Only stretches that can hold a window are streamed: runs of word pairs that all
occur in some item (found at once for a block of texts with array operations).

The benchmark is the stated query set: its items are dealt into blocks of about
``BLOCK_WORDS`` words, each block's automaton is built by a task and written to the shared
folder, and every block is held against all documents. A task has the automata of at most ``KEPT`` blocks
in memory and reads others from the folder as it needs them; nothing of the benchmark is
collected or broadcast. Usually one block holds all items.

Defined cases: NULL and empty texts have no words and are not hit; items
without words have no window; equal items each count; an item longer than a block is a block's
whole weight; NULL item_ids count as an item named ``null``; repeated rows are returned each; an empty benchmark hits
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, ready, saved, shared_folder, slices, table, worker_state
from .files import open_file, whole_file

WINDOW = 10
BLOCK_WORDS = 50_000
KEPT = 2
#: Word signs: digits, letters a-z (after lower-casing A-Z) and everything beyond ASCII.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, w) for name, w in items if w]
        self.names = [name for name, _ in items]
        ids = [[self.number.setdefault(x, len(self.number)) for x in w] for _, w in items]
        for w in ids:
            last = 0
            for c in w:
                last = self._extend(last, c)
        self.items: dict[int, set[int]] = {}   # by state: whose window of ``window`` words ends there
        self.short: dict[int, set[int]] = {}   # by state: shorter items that end there as a whole
        for k, w in enumerate(ids):
            state = size = 0
            for c in w:
                state, size = self.step(state, size, c)
                if size >= window:
                    self.items.setdefault(self.window_state(state), set()).add(k)
            if len(w) < window:
                self.short.setdefault(state, set()).add(k)
        self.shortest = min([window, *(len(w) for w in ids)])
        pairs = {a * len(self.number) + b for w in ids for a, b in zip(w, w[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.n_items = len(ids)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # the path is there from an earlier item
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], size + 1
        return 0, 0

    def window_state(self, state: int) -> int:
        """The state that holds the last ``window`` words of a match at least so long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Windows [a, b) in a run of word numbers, and the items they occur in."""
        spans, found = [], set()
        state = size = 0
        for at, c in enumerate(ids):
            state, size = self.step(state, size, c)
            if size >= self.window:
                spans.append((at + 1 - self.window, at + 1))
                found |= self.items.get(self.window_state(state), frozenset())
            if self.shortest < self.window:
                s = state
                while s > 0:  # shorter items that are a suffix of the match
                    if s in self.short and self.length[s] <= size:
                        spans.append((at + 1 - self.length[s], at + 1))
                        found |= self.short[s]
                    s = self.link[s]
        return spans, found


def _automaton(parts: dict) -> Automaton:
    a = Automaton.__new__(Automaton)
    a.__dict__.update(parts)
    return a


def scan(texts: list[str | None], a: Automaton) -> list[tuple[int, np.ndarray, set[int]]]:
    """For each text: number of words, mask of hit words (empty if none is), items."""
    tokens = [words(t) for t in texts]
    sizes = np.array([len(w) for w in tokens], np.int64)
    out = [(int(n), np.zeros(0, bool), set()) for n in sizes]
    if not a.n_items or not sizes.sum():
        return out
    get = a.number.get
    flat = np.array([get(w, -1) for own in tokens for w in own], np.int64)
    ends = np.cumsum(sizes)
    if a.shortest < 2:
        linked = flat[1:] >= 0
    else:
        code = flat[:-1] * len(a.number) + flat[1:]
        at = np.searchsorted(a.pairs, code)
        linked = (flat[:-1] >= 0) & (flat[1:] >= 0) & (a.pairs[np.minimum(at, len(a.pairs) - 1)] == code) if len(a.pairs) else np.zeros(len(code), bool)
    linked[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(flat))] - 1] = False  # not over a text's end
    edge = np.diff(np.concatenate([[0], linked.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    if a.shortest < 2:  # single known words are runs too
        starts, stops = np.flatnonzero(flat >= 0), np.flatnonzero(flat >= 0) + 1
        joined = np.concatenate([[True], (starts[1:] != stops[:-1]) | np.isin(starts[1:], ends)]) if len(starts) else np.zeros(0, bool)
        starts, stops = starts[joined], stops[np.concatenate([joined[1:], [True]])] if len(starts) else stops
    long = stops - starts >= a.shortest
    for s, e in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
        spans, found = a.hits(flat[s:e].tolist())
        if spans:
            i = int(np.searchsorted(ends, s, "right"))
            n, mask, items = out[i]
            if not len(mask):
                mask = np.zeros(n, bool)
                out[i] = (n, mask, items)
            base = s - int(ends[i] - sizes[i])
            for x, y in spans:
                mask[base + x:base + y] = True
            items |= found
    return out


def built(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> tuple[str, int]:
    """(folder, number of blocks): the automata of ``benchmark(item_id, text)``, one file a block, written by tasks."""
    spark = ready(benchmark.sparkSession)
    folder = shared_folder(spark, "automata")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=["item", "text", "size"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    sized = saved(items.mapInArrow(count, "item string, text string, size long").withColumn("row", F.monotonically_increasing_id()), "items")
    blocks_needed = math.ceil((sized.agg(F.sum("size")).first()[0] or 0) / block_words)
    if not blocks_needed:
        return folder, 0
    dealt = sized.select("item", "text", F.pmod(F.xxhash64("row"), F.lit(blocks_needed)).alias("block"))  # equal items too are spread

    def build(block: pa.Table) -> pa.Table:
        number = block.column("block")[0].as_py()
        pairs = zip(block.column("item").to_pylist(), block.column("text").to_pylist(), strict=True)
        with whole_file(folder, f"{number}.automaton") as out:
            out.write(pickle.dumps(Automaton([(name, words(text)) for name, text in pairs], window).__dict__))
        return pa.table({"block": pa.array([number], pa.int64())})

    made = {r.block for r in dealt.groupBy("block").applyInArrow(build, "block long").collect()}   # numbers of blocks alone
    for number in set(range(blocks_needed)) - made:                                               # that got no item
        with whole_file(folder, f"{number}.automaton") as out:
            out.write(pickle.dumps(Automaton([], window).__dict__))
    return folder, blocks_needed


def loaded(folder: str, number: int) -> Automaton:
    """A block's automaton; the worker keeps the last ``KEPT``."""
    kept = worker_state("automata", dict, large=True)
    if (folder, number) not in kept:
        while len(kept) >= KEPT:
            kept.pop(next(iter(kept)))
        with open_file(folder, f"{number}.automaton") as f:
            kept[folder, number] = pickle.loads(f.read())
    return _automaton(kept[folder, number])


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: words, hit words, and the items of ``benchmark(item_id, text)`` it holds windows of."""
    folder, number = built(benchmark, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _rows_at_once(number), "automata"):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in blocks(texts, _chars_at_once(number)):
                rows = []
                for n, mask, items in _scan_all(texts[lo:hi], folder, number):
                    hit = int(mask.sum())
                    rows.append((n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids[lo:hi], *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))],
                                                 names=[x.split()[0] for x in REPORT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, REPORT)


def _rows_at_once(number: int) -> int:
    return 500 if number <= KEPT else 5_000          # automata that are read again and again serve more rows a time


def _chars_at_once(number: int) -> int:
    return 1 << 18 if number <= KEPT else 1 << 22


def _scan_all(texts: list[str | None], folder: str, number: int) -> list[tuple[int, np.ndarray, list[str]]]:
    """``scan`` over every block of items; items by name."""
    out = None
    for k in range(number):
        a = loaded(folder, k)
        got = [(n, mask, [a.names[i] for i in items]) for n, mask, items in scan(texts, a)]
        if out is None:
            out = got
        else:
            out = [(n, (m | m2) if len(m) and len(m2) else (m if len(m) else m2), i + i2) for (n, m, i), (_, m2, i2) in zip(out, got, strict=True)]
    return out if out is not None else [(len(words(t)), np.zeros(0, bool), []) for t in texts]


def without_hits(text: str, mask: np.ndarray) -> str:
    """``text`` without its hit words and the signs between two hit words; one blank stands for each cut."""
    raw = text.encode("utf-8", "surrogatepass")
    sign = np.frombuffer(raw.translate(TO_WORDS), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], sign.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    parts, at = [], 0
    for a, b in zip(np.flatnonzero(runs == 1).tolist(), np.flatnonzero(runs == -1).tolist(), strict=True):
        parts.append(raw[at:first[a]])
        at = int(last[b - 1])
    parts.append(raw[at:])
    return b" ".join(p.strip(b" ") for p in parts).strip(b" ").decode("utf-8", "surrogatepass") if len(parts) > 1 else text


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with hit spans removed from ``text``; a text of which ``most_share`` or more of the words are hit
    is left out. All columns stay; ``n_chars``, if there, is counted anew for changed texts."""
    folder, number = built(benchmark, window, block_words)
    names = docs.columns
    has_count = "n_chars" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _rows_at_once(number), "automata"):
            texts = batch.column("text").to_pylist()
            counts = batch.column("n_chars").to_pylist() if has_count else []
            keep, new = [], list(texts)
            for lo, hi in blocks(texts, _chars_at_once(number)):
                for i, (n, mask, _) in enumerate(_scan_all(texts[lo:hi], folder, number), lo):
                    hit = int(mask.sum())
                    keep.append(not hit or hit < most_share * n)
                    if hit and keep[-1]:
                        new[i] = without_hits(texts[i], mask)
                        if has_count:
                            counts[i] = len(new[i])
            cols = [pa.array(new, batch.schema.field("text").type) if c == "text" else
                    pa.array(counts, batch.schema.field(c).type) if c == "n_chars" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of ten words."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
