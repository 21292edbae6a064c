"""Operator 12: Merkle manifest of a dataset with proofs by pointer jumping.

Rows are the leaves of one binary hash tree per group; the group's root is its
*subroot*; the subroots, by group, are the leaves of the tree of the whole
dataset. A node is the digest of its two children's digests as hex text, a node
without a neighbour the digest of the one below it.

* ``leaves``: digests are made where a row is read; only they go on, never a text.
* ``places``: rows are range-partitioned by (group, order) and numbered by partition and
  row; a small table (a row for each group of each partition) turns that into the
  place in the group. No group is in one task.
* ``climb``: ``HEIGHT`` levels at a time, blocks of ``2 ** HEIGHT`` neighbouring
  nodes are hashed up in one task call each; every node keeps its first *segment*, the sibling on
  the way to its parent.
* ``proofs``: in round k a node at a level that 2 ** (k + 1) divides joins the segment of
  its ancestor 2 ** k levels up, so segments double until the leaves reach the root. The
  ancestors' rows are few; from 2 ** (k + 1) > ``HEIGHT`` levels on, each is first copied
  down to the blocks of ``2 ** HEIGHT`` nodes below it, so that no join key has more
  than ``2 ** HEIGHT`` rows, however large the tree.

A segment is a run of steps: byte 0 for no sibling, 1 and the sibling's digest if that is on the
left, 2 and the digest if it is on the right.

Defined cases: NULL fields are hashed as ``-``; a NULL group is a group of its own, before
all others; rows with equal order go by their digest, equal rows in any order (they have equal
digests, each its own proof); a NULL doc_id comes first and, as no checksum
divides, is never tampered with; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready, saved, table

HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7


def digest(columns: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if NULL, else its number of UTF-8 bytes, ``:`` and itself."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(field, columns)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, grp, leaf, changed): the digest of each row, and of the row with n_chars + 1 where ``TAMPERED`` divides
    the checksum of its doc_id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    changed = [F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS]
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"),
                       digest([F.col(c) for c in FIELDS]).alias("leaf"), F.when(hit, digest(changed)).alias("changed"))


def places(rows: DataFrame, group: list[str], order: list[str], names: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``place``, from 0 by ``order`` in the group, ``held``, the number of the group's rows, and what
    ``names`` has for the group."""
    dealt = saved(saved(rows, "merkle-rows").withColumn("tie", F.monotonically_increasing_id())
                  .repartitionByRange(*group, *order, "tie").sortWithinPartitions(*group, *order, "tie")
                  .withColumn("row", F.monotonically_increasing_id()).drop("tie"), "merkle-order")
    dealt = dealt.withColumn("part", F.shiftright("row", 33))
    runs = dealt.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("size"), F.min("row").alias("first"))
    whole = Window.partitionBy(*group)
    runs = runs.withColumn("held", F.sum("size").over(whole)).withColumn("before", F.sum("size").over(whole.orderBy("part")) - F.col("size"))
    extra = [c for c in names.columns if c not in group] if names is not None else []
    if names is not None:
        runs = runs.join(names, group)
    return (dealt.join(runs, [*group, "part"])
            .select(*rows.columns, (F.col("before") + F.col("row") - F.col("first")).alias("place"), "held", *extra))


# ------------------------------------------------------------------ the trees
NODES = "tree long, level int, place long, held long, digest binary, segment binary, doc_id {0}, changed binary"


def _on_level(held: Column, level: Column) -> Column:
    """The number of nodes on a level of a tree of ``held`` leaves."""
    return F.ceil(held / F.pow(F.lit(2.0), level)).cast("long")


def _climber(height: int):
    """Hash a block of neighbours up ``height`` levels, or to the tree's root: a row with its first segment for every
    node below the top, and one without for the top."""
    def climb(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        tree, level, held, at = (block.column(c)[0].as_py() for c in ("tree", "level", "held", "place"))
        nodes, out, bottom = block.column("digest").to_pylist(), [], level
        while level < bottom + height and held > 1 << level:
            above = []
            for i in range(0, len(nodes), 2):
                pair = nodes[i:i + 2]
                out.append((level, at + i, None if level else pair[0], b"\x02" + pair[1] if len(pair) == 2 else b"\x00"))
                if len(pair) == 2:
                    out.append((level, at + i + 1, None if level else pair[1], b"\x01" + pair[0]))
                above.append(hashlib.sha256("".join(x.hex() for x in pair).encode()).digest())
            nodes, at, level = above, at // 2, level + 1
        out += [(level, at + i, x, None) for i, x in enumerate(nodes)]
        n = len(out)
        levels, places_, digests, segments = (list(x) for x in zip(*out, strict=True))

        def kept(c: str) -> pa.Array:      # the columns of leaves, which are the first rows
            x, kind = block.column(c), block.schema.field(c).type
            return pa.nulls(n, kind) if bottom else pa.concat_arrays([*x.chunks, pa.nulls(n - len(x), kind)])

        return pa.table({"tree": pa.array([tree] * n, pa.int64()), "level": pa.array(levels, pa.int32()), "place": pa.array(places_, pa.int64()),
                         "held": pa.array([held] * n, pa.int64()), "digest": pa.array(digests, pa.binary()),
                         "segment": pa.array(segments, pa.binary()), "doc_id": kept("doc_id"), "changed": kept("changed")})
    return climb


def climb(bottom: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, inner nodes, roots) of the trees over ``bottom(tree, place, held, digest, doc_id, changed)``; leaves and
    inner nodes with their first segments."""
    ready(bottom.sparkSession)
    schema = NODES.format(bottom.schema["doc_id"].dataType.simpleString())
    at, inner, roots, bottom_nodes = bottom.withColumn("level", F.lit(0)), None, None, None
    while True:
        done = saved(at.withColumn("block", F.shiftright("place", height)).groupBy("tree", "block").applyInArrow(_climber(height), schema), "merkle-nodes")
        bottom_nodes = done.where("level = 0") if bottom_nodes is None else bottom_nodes
        own, tops = done.where("segment is not null and level > 0"), done.where("segment is null")
        last = _on_level(F.col("held"), F.col("level")) <= 1
        inner, roots = (own, tops.where(last)) if inner is None else (inner.unionByName(own), roots.unionByName(tops.where(last)))
        at = tops.where(~last)
        if at.isEmpty():
            return bottom_nodes.withColumn("segment", F.coalesce("segment", F.lit(b""))), inner, roots


# ------------------------------------------------------------------ pointer jumping
def _copied_down(high: DataFrame, to: int, height: int, top: int) -> DataFrame:
    """Rows of nodes on levels above ``to``, once for each node below them on level ``to`` (all a whole number of levels
    apart that the loop reaches; ``top`` is the highest)."""
    level = top
    while level > to:
        by = min(height, level - to)
        here = F.col("level") == level
        below = F.when(here, F.sequence(F.lit(0), F.lit((1 << by) - 1))).otherwise(F.array(F.lit(0)))
        high = (high.withColumn("below", F.explode(below))
                .withColumn("place", F.when(here, F.col("place") * (1 << by) + F.col("below")).otherwise(F.col("place")))
                .withColumn("level", F.when(here, F.lit(level - by)).otherwise(F.col("level"))).drop("below")
                .where(F.col("place") < F.greatest(F.lit(1), _on_level(F.col("held"), F.col("level")))))
        level -= by
    return high


def _jumped(low: DataFrame, high: DataFrame, level: int, jump: int, height: int) -> DataFrame:
    """Nodes ``low`` on ``level`` with the segments of their ancestors ``jump`` levels up added to theirs."""
    near = min(jump, height)
    above = _copied_down(high.where(F.col("level") == level + jump).select("tree", "level", "place", "held", "segment"), level + near, height, level + jump)
    above = above.select("tree", F.col("place").alias("near"), F.col("segment").alias("further"))
    return (low.withColumn("near", F.shiftright("place", near)).join(above, ["tree", "near"], "left")
            .withColumn("segment", F.concat("segment", F.coalesce("further", F.lit(b"")))).drop("near", "further"))


def proofs(bottom_nodes: DataFrame, inner: DataFrame, depth: int, height: int = HEIGHT) -> DataFrame:
    """``bottom_nodes`` with the whole segment from the leaf to the root of its tree; no tree is more than ``depth`` levels high."""
    inner, jump = inner.select("tree", "level", "place", "held", "segment"), 1
    while jump < depth:
        bottom_nodes = _jumped(bottom_nodes, inner, 0, jump, height)
        levels = range(2 * jump, depth, 2 * jump)
        doubled = [_jumped(inner.where(F.col("level") == x), inner, x, jump, height) for x in levels]
        if doubled:
            together = doubled[0]
            for x in doubled[1:]:
                together = together.unionByName(x)
            inner = saved(together, "merkle-jump")
        jump *= 2
    return bottom_nodes


def depth_of(roots: DataFrame) -> int:
    return roots.agg(F.max("level")).first()[0] or 0


# ------------------------------------------------------------------ the manifest
def folded(segment: bytes, node: bytes) -> tuple[bytes, list[bytes]]:
    """The root that ``node`` and the siblings of a segment give, and the siblings."""
    at, siblings = 0, []
    while at < len(segment):
        side = segment[at]
        if side:
            other = segment[at + 1:at + 33]
            siblings.append(other)
            text = other.hex() + node.hex() if side == 1 else node.hex() + other.hex()
            at += 33
        else:
            text = node.hex()
            at += 1
        node = hashlib.sha256(text.encode()).digest()
    return node, siblings


MANIFEST = "doc_id {0}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row per row of ``docs(doc_id, source, lang, n_chars, text)``: its leaf, the roots, its proof and what the proof gives."""
    ready(docs.sparkSession)
    rows = leaves(docs)
    trees = places(rows.select("grp").distinct(), [], ["grp"]).select("grp", F.col("place").alias("tree"))
    placed = places(rows, ["grp"], ["doc_id", "leaf"], trees).select("tree", "place", "held", F.col("leaf").alias("digest"), "doc_id", "changed")
    bottom_nodes, inner, roots = climb(placed, height)
    depth = depth_of(roots)
    upper = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(roots.count()).cast("long").alias("held"), "digest", "doc_id", "changed")
    subroots, upper_inner, whole = climb(upper, height)
    found = whole.select("digest").head(1)                       # one row: the root of the dataset
    root = bytes(found[0][0]) if found else b""
    tails = proofs(subroots, upper_inner, depth_of(whole), height).select(F.col("place").alias("tree"), F.col("digest").alias("subroot"), F.col("segment").alias("tail"))
    top = height * max(1, -(-depth // height))
    start = F.greatest(F.lit(1), F.ceil(F.col("level") / height)).cast("int") * height
    ends = _copied_down(roots.select("tree", "held", start.alias("level"), F.lit(0).cast("long").alias("place")).join(tails, "tree"), height, height, top)
    proved = (proofs(bottom_nodes, inner, depth, height).withColumn("near", F.shiftright("place", height))
              .join(ends.select("tree", F.col("place").alias("near"), "subroot", "tail"), ["tree", "near"])
              .select("doc_id", "digest", "changed", F.concat("segment", "tail").alias("segment"), "subroot"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for leaf, changed, segment, subroot in zip(*(batch.column(c).to_pylist() for c in ("digest", "changed", "segment", "subroot")), strict=True):
                end, siblings = folded(segment, changed or leaf)
                out.append((leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256("".join(x.hex() for x in siblings).encode()).hexdigest(), end.hex(), end == root))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.string()) for c in cols[:5]), pa.array(cols[5], pa.bool_())],
                                             names=[x.split()[0] for x in MANIFEST.split(", ")])

    return proved.mapInArrow(fold, MANIFEST.format(docs.schema["doc_id"].dataType.simpleString()))


def op12_jumped_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, a tree per language."""
    return manifest(table(spark, sf_dir, "documents"))


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


#: Both trees level by level, then every leaf's way up; the checksum is worked out bit by bit.
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('(n_chars + 1)')} AS changed,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST((ascii(substr(CAST(doc_id AS VARCHAR), CAST(p AS INT), 1)) >> CAST(b AS INT)) & 1 AS BIGINT)
                                        FOR b IN range(8)] FOR p IN range(1, strlen(CAST(doc_id AS VARCHAR)) + 1)])),
             lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % {TAMPERED} = 0 AS hit
  FROM documents),
bottom AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY grp) AS held FROM d),
low AS (
  SELECT grp, 0 AS level, place, held, leaf AS node FROM bottom
  UNION ALL
  SELECT grp, level + 1, place // 2, (any_value(held) + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM low WHERE held > 1 GROUP BY grp, level, place // 2),
tops AS (SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS held FROM low WHERE held = 1),
high AS (
  SELECT 0 AS level, place, held, subroot AS node FROM tops
  UNION ALL
  SELECT level + 1, place // 2, (any_value(held) + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM high WHERE held > 1 GROUP BY level, place // 2),
way AS (
  SELECT grp, 0 AS level, place, place AS start, held, CAST('' AS VARCHAR) AS proof, CASE WHEN hit THEN changed ELSE leaf END AS node FROM bottom
  UNION ALL
  SELECT w.grp, w.level + 1, w.place // 2, w.start, (w.held + 1) // 2, w.proof || coalesce(s.node, ''),
         sha256(CASE WHEN w.place % 2 = 1 THEN s.node || w.node ELSE w.node || coalesce(s.node, '') END)
  FROM way w LEFT JOIN low s ON s.grp = w.grp AND s.level = w.level AND s.place = xor(w.place, 1) WHERE w.held > 1),
up AS (
  SELECT w.grp, w.start, 0 AS level, t.place, t.held, w.proof, w.node, t.subroot FROM way w JOIN tops t ON t.grp = w.grp WHERE w.held = 1
  UNION ALL
  SELECT u.grp, u.start, u.level + 1, u.place // 2, (u.held + 1) // 2, u.proof || coalesce(s.node, ''),
         sha256(CASE WHEN u.place % 2 = 1 THEN s.node || u.node ELSE u.node || coalesce(s.node, '') END), u.subroot
  FROM up u LEFT JOIN high s ON s.level = u.level AND s.place = xor(u.place, 1) WHERE u.held > 1)
SELECT b.doc_id, b.leaf, u.subroot, h.node AS root, sha256(u.proof) AS proof_sha256, u.node AS folded_root, u.node = h.node AS verified
FROM up u JOIN bottom b ON b.grp = u.grp AND b.place = u.start JOIN high h ON h.held = 1 WHERE u.held = 1"""
