"""Operator 8 [native]: preference pairs as one prompt and two masked completions.

A pair has a chosen and a rejected conversation. Their longest common prefix of
turns is rendered once, as the prompt; what follows in each becomes that side's
completion. The result has a row per rendered turn, ordered within a part by
``turn``, ``role`` and ``rendered``; an example is the prompt rows followed by
one side's rows. ``mask_start`` and ``mask_end`` bound the characters of a
rendered turn that a model is trained on: the content and end mark of
assistant turns in completions, nothing elsewhere.

Turns are matched by their number, without gathering a conversation anywhere:
both sides meet in one aggregation by (pair, turn, role, text), which tells the
sides a turn is on; the first turn that is not on both is a grouped minimum per
pair, joined back. A conversation that holds a third of all rows is spread by
its turns, and its join is one that Spark splits.

Only DataFrame functions are used.

Defined cases: rows with a NULL pair or conversation id are left out; a NULL turn comes before
all others, a NULL role is ``unknown``, a NULL text is empty; repeated rows
count once; several different rows of one turn number belong to that turn, in
the order of role and text; two equal conversations give a prompt and no
completions; a pair that has only one side has no preference: its turns are the
part ``unpaired`` and are not trained on; a side whose turns all belong to the prompt gives
no rows of its part, and one without an assistant turn in its completion gives rows without a
mask; other columns are ignored; empty tables give no rows. ``<|`` inside a text is rendered as
``< |`` so that no text can hold a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FIRST = -(1 << 63)


def tidy(turns: DataFrame, key: str) -> DataFrame:
    return turns.where(F.col(key).isNotNull()).select(
        F.col(key).alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))


def preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """``pair_id, part, turn, role, rendered, mask_start, mask_end`` from the turns
    (``key``, turn, role, text) of the chosen and the rejected conversations."""
    return from_sides(tidy(chosen, key).withColumn("c", F.lit(1)).withColumn("r", F.lit(0)).union(
        tidy(rejected, key).withColumn("c", F.lit(0)).withColumn("r", F.lit(1))))


def from_sides(sides: DataFrame) -> DataFrame:
    """``preferences`` of tidy turns with marks of the sides they are on: ``c`` and ``r``, 0 or 1."""
    turns = sides.groupBy("pair_id", "turn", "role", "text").agg(F.max("c").alias("c"), F.max("r").alias("r"))
    pairs = turns.groupBy(F.col("pair_id").alias("p")).agg(
        F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("first"), (F.max("c") + F.max("r") == 2).alias("both"))
    common = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    parts = (F.when(~F.col("both"), F.array(F.lit("unpaired"))).when(common, F.array(F.lit("prompt"))).otherwise(F.array_compact(F.array(
        F.when(F.col("c") == 1, F.lit("chosen")), F.when(F.col("r") == 1, F.lit("rejected"))))))
    trained = F.col("part").isin("chosen", "rejected") & (F.col("role") == "assistant")
    return (turns.join(pairs, turns.pair_id == pairs.p)
            .select("pair_id", F.explode(parts).alias("part"), "turn", "role", rendered(F.col("role"), F.col("text")).alias("rendered"))
            .withColumn("mask_start", F.when(trained, F.length("role") + 13).otherwise(0).cast("long"))
            .withColumn("mask_end", F.when(trained, F.length("rendered") - 1).otherwise(0).cast("long")))


def neighbour_endings(conversations: DataFrame) -> DataFrame:
    """Sides for ``from_sides`` from plain conversations, every one of them chosen, with all its turns: its rejected side leaves it at
    its last answer (at its first turn, if it has no answer) and goes on with the turns of that number and later ones of its
    neighbour, the conversation whose id differs in the lowest bit. Without a neighbour there is no rejected side."""
    own = F.col("pair_id").bitwiseAND(F.lit(1))
    turns = tidy(conversations, "conv_id").withColumn("two", F.shiftright("pair_id", 1))
    leaves = turns.groupBy(F.col("two").alias("t")).agg(*[
        F.coalesce(F.max(F.when((own == x) & (F.col("role") == "assistant"), F.col("turn"))), F.min(F.when(own == x, F.col("turn")))).alias(f"leave_{x}")
        for x in (0, 1)])
    here = F.when(own == 0, F.col("leave_0")).otherwise(F.col("leave_1"))
    there = F.when(own == 0, F.col("leave_1")).otherwise(F.col("leave_0"))
    kept = F.coalesce((F.col("turn") < here) & there.isNotNull(), F.lit(False)).cast("int")
    on = F.array_compact(F.array(
        F.struct(F.col("pair_id"), F.lit(1).alias("c"), kept.alias("r")),
        F.when(F.col("turn") >= there, F.struct(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.lit(0).alias("c"), F.lit(1).alias("r")))))
    return (turns.join(leaves, turns.two == leaves.t).select(F.explode(on).alias("on"), "turn", "role", "text")
            .select("on.pair_id", "turn", "role", "text", "on.c", "on.r"))


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, with all their turns, as preference pairs."""
    return from_sides(neighbour_endings(table(spark, sf_dir, "conversations")))


OP8_SQL = """
WITH t AS (SELECT conv_id AS pair_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, 'unknown') AS role,
                  coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT pair_id, coalesce(max(turn) FILTER (role = 'assistant'), min(turn)) AS leaves FROM t GROUP BY pair_id),
p AS (SELECT l.pair_id, l.leaves, o.pair_id AS other FROM l JOIN l o ON o.pair_id = xor(l.pair_id, CAST(1 AS BIGINT))),
s AS (SELECT pair_id, turn, role, text, 1 AS c, 0 AS r FROM t
      UNION ALL SELECT pair_id, turn, role, text, 0, 1 FROM t JOIN p USING (pair_id) WHERE turn < leaves
      UNION ALL SELECT p.pair_id, turn, role, text, 0, 1 FROM t JOIN p ON p.other = t.pair_id WHERE turn >= leaves),
e AS (SELECT pair_id, turn, role, text, max(c) AS c, max(r) AS r FROM s GROUP BY ALL),
f AS (SELECT pair_id, min(CASE WHEN c <> r THEN turn END) AS first, max(c) + max(r) = 2 AS both_sides FROM e GROUP BY pair_id),
g AS (SELECT e.*, unnest(CASE WHEN NOT both_sides THEN ['unpaired'] WHEN first IS NULL OR turn < first THEN ['prompt']
             ELSE list_filter([CASE WHEN c = 1 THEN 'chosen' END, CASE WHEN r = 1 THEN 'rejected' END], lambda x: x IS NOT NULL) END) AS part
      FROM e JOIN f USING (pair_id)),
h AS (SELECT pair_id, part, turn, role,
             '<|im_start|>' || role || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS rendered FROM g)
SELECT *, CAST(CASE WHEN part IN ('chosen', 'rejected') AND role = 'assistant' THEN length(role) + 13 ELSE 0 END AS BIGINT) AS mask_start,
       CAST(CASE WHEN part IN ('chosen', 'rejected') AND role = 'assistant' THEN length(rendered) - 1 ELSE 0 END AS BIGINT) AS mask_end
FROM h"""
