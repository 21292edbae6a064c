"""Operator 3: near-duplicate documents by fast similarity sketches, banding and exact verification.

1. *Sets and sketches.* Each text becomes its set of word shingles, a fast
   similarity sketch of ``BANDS * ROWS`` coordinates (``shingles.sketch``) and
   one key per band. Two sets of similarity 0.8 share no key with probability
   ``(1 - 0.8 ** ROWS) ** BANDS``, about 5e-6.
2. *Classes.* Documents with equal sets are one class, named after its smallest
   doc_id; only classes go on. Copies are never paired.
3. *Pivots.* Every bucket (classes that share a key) links its members to its
   smallest class; these pairs, one per member and pivot, are verified on the
   full sets, and the confirmed links give components.
4. *The rest.* A pair inside a bucket that neither touches the pivot nor lies
   in one component is still open. Only buckets with such pairs go on, once per
   set of members. A bucket is dealt into chunks of ``CHUNK`` members by hash and
   every two chunks meet in one task, which compares all open pairs on the
   full sets and reports only the links that join components. So no pair is
   left untested, none is emitted, and a large bucket is spread over many tasks.
5. Links of both steps give the components; each is named after its smallest doc_id.

Texts are read twice: once for the sketches, once for the candidates. What is
kept between steps is written to the shared folder.

Defined cases: a text without words (or NULL) has an empty set and is linked
with nothing; a NULL doc_id takes no part in linking, its component_id is NULL and
it is kept; rows that repeat a doc_id are one document (its texts share their
links) and each row is returned; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, ready, saved, slices, table
from .components import components
from .shingles import band_keys, shingle_sets, sketch

ROWS, BANDS = 6, 40
CHUNK = 512
#: A side of at most this many ids (8 bytes each) is broadcast after its rows were counted; a larger one is joined by a shuffle.
BROADCAST_IDS = 4_000_000


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, keys) of every row; digest and keys are NULL for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in slices(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in blocks(texts, 1 << 19):
                sets = shingle_sets(texts[a:b], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for i, k in zip(full, band_keys(sketch([sets[i] for i in full], ROWS * BANDS), ROWS), strict=True):
                        keys[i] = k.view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    ids[a:b], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "keys"])

    ready(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose full sets are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = None, None
        for batch in slices(batches, 200):
            a, ta = batch.column(0).to_pylist(), batch.column(2)
            ok = []
            for i, other in enumerate(shingle_sets(batch.column(3).to_pylist(), width)):
                if (a[i], text := ta[i].as_py()) != name:  # sorted by a: its set is made once a text
                    name, own = (a[i], text), shingle_sets([text], width)[0]
                ok.append(alike(own, other, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ready(pairs.sparkSession)
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


def open_links(group: pd.DataFrame, width: int, percent: int) -> pd.DataFrame:
    """Links between components among the members of two chunks (or one) of a bucket, as few as join them."""
    first = group.drop_duplicates(["node", "text"]).sort_values("node")  # every text of a repeated doc_id
    node, comp, chunk, pivot = (first[c].to_numpy() for c in ("node", "component", "chunk", "pivot"))
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    sets = [x for lo in range(0, len(first), 200) for x in shingle_sets(first["text"].iloc[lo:lo + 200].tolist(), width)]
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(size) - size
    mark = np.zeros(flat.max() + 1, np.int32)
    found = []
    root = {c: c for c in comp.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for x in np.flatnonzero((chunk == i) & (node != pivot)):
        own = flat[starts[x]:starts[x] + size[x]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        near = np.flatnonzero((100 * common >= percent * (size + size[x] - common)) & (comp != comp[x]) & (chunk == j) & (node != pivot))
        for y in near.tolist():
            a, b = top(int(comp[x])), top(int(comp[y]))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((int(comp[x]), int(comp[y])))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs(doc_id, text)``: documents
    whose shingle sets have a Jaccard similarity of ``percent`` hundredths or more are linked."""
    spark = ready(docs.sparkSession)
    base = saved(sketched(docs, width), "sketches")
    linked = base.where("doc_id is not null and n_shingles > 0")
    classes = linked.groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("node"))
    members = saved(linked.join(classes, ["n_shingles", "digest"])
                    .select("doc_id", "n_shingles", "node", F.when(F.col("doc_id") == F.col("node"), F.col("keys")).alias("keys")), "members")
    bands = members.where("keys is not null").select(F.explode("keys").alias("key"), "node")
    buckets = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("*").alias("n")).where("pivot <> last")
    shared = saved(bands.join(buckets.select("key", "pivot", "n"), "key"), "buckets")
    candidates = saved(shared.select("node").distinct(), "candidates")
    if candidates.count() <= BROADCAST_IDS:
        candidates = F.broadcast(candidates)
    texts = saved(docs.select(F.col("doc_id").alias("node"), "text").join(candidates, "node", "left_semi"), "candidate-texts")
    pairs = shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = saved(verified(pairs, texts, width, percent), "links")
    first = saved(components(links), "components")

    labelled = saved(shared.join(first, "node", "left").select("key", "node", "pivot", "n", F.coalesce("component", "node").alias("component")), "labelled")
    other = F.when(F.col("node") != F.col("pivot"), F.col("component"))
    mixed = (labelled.groupBy("key").agg(F.min(other).alias("low"), F.max(other).alias("high"), F.count("*").alias("n"),
                                         F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who"), F.min("pivot").alias("p"))
             .where("low <> high").groupBy("n", "who", "p").agg(F.min("key").alias("key")).select("key"))
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = (labelled.join(mixed, "key").withColumn("chunk", F.pmod(F.xxhash64("node"), parts).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
             .select("key", "node", "pivot", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")))
    schema = "a long, b long"
    more = saved(dealt.join(texts, "node").groupBy("key", "i", "j").applyInPandas(lambda g: open_links(g, width, percent), schema).distinct(), "more-links")
    final = first
    if not more.isEmpty():
        final = components(links.union(more))
    named = saved(final, "classes")
    done = (members.join(named, members.node == named.node, "left")
            .select("doc_id", "n_shingles", F.coalesce("component", members.node).alias("component_id")))
    rest = base.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return done.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the kept one of its group, all columns as they are."""
    gone = saved(near_duplicates(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct(), "copies")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs.doc_id == gone.gone_id, "left_anti")


def op3_fast_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 4-word shingles, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
