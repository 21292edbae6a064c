"""Stock ledger: replay restock / dispense requests per drug in order.

The rule is order-dependent: a dispense larger than what is on hand is
refused and leaves the balance unchanged, so every later outcome depends on
every earlier refusal. A running sum cannot express it.

One plan for drugs of any size:

1. One left join brings each request its drug (none for unknown and NULL ids, which are spread
   over all tasks). Requests are range-partitioned by (drug, order): a drug with many
   requests spans several partitions, a small one lies inside one. Each
   partition is replayed in one pass (``mapInArrow``), every drug from its opening stock, and
   written once to the shared checkpoint folder.
2. A drug that continues from an earlier partition may have started from a wrong balance. So
   each partition also leaves the *transfer function* of its first drug: the balance at
   its end for every balance at its start (``operators.transfer``).
3. Neighbouring functions are composed, ``FAN`` at a time, level by level (``entries``); on the way down
   every block of partitions gets its true entry balance and hands it to its
   members. With n partitions that is about 2 log n / log FAN rounds, whatever the requests are.
4. Partitions entered with another balance than assumed are replayed from their
   true entry, in parallel; all other rows are final after the first pass.

Quantities are exact integer thousandths.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import js_decimal_text
from ..schemas import MOVEMENT_TYPES, QTY
from ..session import ship_package, shared_table
from .transfer import MOST_RUNS, compose, constant, evaluate, transfer

# Fixed texts of refusals
REASON_QTY = "quantity must be greater than 0"
REASON_TYPE = "type must be restock or dispense"
REASON_UNKNOWN = "No drug with id "

FAN = 32             # functions composed by one task call
SPREAD = 1024        # parts of the requests without a drug id in the join


def signed_step() -> Column:
    """What a request adds to the balance in thousandths (negative: takes from it); 0 if it is refused whatever is on hand."""
    q = (F.col("quantity") * F.lit(1000)).cast("long")
    return (F.when((q > 0) & (F.col("type") == MOVEMENT_TYPES[0]), q).when((q > 0) & (F.col("type") == MOVEMENT_TYPES[1]), -q)
            .otherwise(F.lit(0).cast("long")))


def refusal(known: Column, accepted: Column, step: Column, after: Column, name: Column, unit: Column) -> Column:
    """Why a request was refused (NULL if it was not). Checks run in the application's order: drug exists, type, quantity > 0,
    enough on hand."""
    on_hand = js_decimal_text((after.cast("decimal(20,0)") / 1000).cast("decimal(20,3)"))
    return (F.when(~known, F.concat(F.lit(REASON_UNKNOWN), F.coalesce(F.col("drug_id").cast("string"), F.lit("null"))))
            .when(accepted, F.lit(None).cast("string"))
            .when(~F.coalesce(F.col("type").isin(*MOVEMENT_TYPES), F.lit(False)), F.lit(REASON_TYPE))
            .when(step == 0, F.lit(REASON_QTY))
            .otherwise(F.concat(F.lit("Only "), on_hand, F.lit(" "), F.coalesce(F.nullif(unit, F.lit("")), F.lit("unit(s)")),
                                F.lit(" of "), F.coalesce(name, F.lit("null")), F.lit(" in stock"))))


def replay(steps: list[int], start: int) -> tuple[list[bool], list[int]]:
    """(accepted, balance after) of each step from balance ``start``."""
    accepted, after, bal = [], [], start
    for s in steps:
        ok = s > 0 or (s < 0 and bal + s >= 0)
        if ok:
            bal += s
        accepted.append(ok)
        after.append(bal)
    return accepted, after


RUNS = T.ArrayType(T.LongType())
FUNCTION = T.StructType([T.StructField(c, RUNS) for c in ("begin", "origin", "value", "period")])
ARROW_FUNCTION = pa.struct([(c, pa.list_(pa.int64())) for c in ("begin", "origin", "value", "period")])


def _packed(runs: list[tuple[int, int, int, int]]) -> dict:
    return dict(zip(("begin", "origin", "value", "period"), map(list, zip(*runs, strict=True)), strict=True))


def _runs(f) -> list[tuple[int, int, int, int]]:
    return list(zip(*([int(x) for x in f[c]] for c in ("begin", "origin", "value", "period")), strict=True))


OUTCOME = (("accepted", pa.bool_()), ("_after", pa.int64()))
PASS = (*OUTCOME, ("_part", pa.int32()), ("_first", pa.bool_()), ("_piece", pa.int32()), ("_fn", ARROW_FUNCTION))


def _first_pass(keys: Sequence[str], kept: Sequence[str], most: int):
    """Replay a sorted partition, every drug from its opening stock; the last rows are the transfer functions of its first
    drug, and the end balance of its last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, schema, last_key, first_key, bal = TaskContext.get().partitionId(), None, None, None, None
        first_steps, in_first = [], True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            schema = schema or pa.schema([*(batch.schema.field(c).with_nullable(True) for c in kept), *(pa.field(*f) for f in PASS)])
            cols = [batch.column(k) for k in keys]
            key0 = tuple(c[0].as_py() for c in cols)
            new = np.zeros(n, bool)
            new[0] = key0 != last_key
            for c in cols:
                if n > 1:
                    differs = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
                    both = pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, n - 1))).to_numpy(zero_copy_only=False)
                    new[1:] |= differs & ~both
            last_key = tuple(c[n - 1].as_py() for c in cols)
            if first_key is None:
                first_key = key0
            steps, opens = batch.column("_s").to_pylist(), batch.column("_open")
            starts = np.flatnonzero(new).tolist()
            accepted, after = [], []
            for a, b in zip([*([] if starts[:1] == [0] else [0]), *starts], [*(starts[1:] if starts[:1] == [0] else starts), n], strict=True):
                if new[a]:
                    bal = opens[a].as_py()
                if bal is None:
                    accepted += [False] * (b - a)
                    after += [None] * (b - a)
                else:
                    ok, got = replay(steps[a:b], bal)
                    accepted += ok
                    after += got
                    bal = got[-1]
            own = n if not in_first else next((x for x in starts if x or first_key != key0), n)
            if in_first:
                first_steps.append(np.array(steps[:own], np.int64))
                in_first = own == n
                first = np.arange(n) < own
            else:
                first = np.zeros(n, bool)
            if key0 == first_key and first[:1].any():
                first_open = opens[0].as_py() if new[0] else first_open
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(accepted, pa.bool_()), pa.array(after, pa.int64()), pa.array([part] * n, pa.int32()),
                 pa.array(first), pa.nulls(n, pa.int32()), pa.nulls(n, ARROW_FUNCTION)], schema=schema)
        if schema is None:
            return
        ends = []
        if first_open is not None:
            ends += [(first_key, i, f) for i, f in enumerate(transfer(np.concatenate(first_steps).tolist(), most))]
        if last_key != first_key and bal is not None:
            ends.append((last_key, 0, constant(bal)))
        if ends:
            out = []
            for f in schema:
                if f.name in keys:
                    out.append(pa.array([k[keys.index(f.name)] for k, _, _ in ends], f.type))
                elif f.name in ("_part", "_piece", "_fn"):
                    out.append(pa.array([{"_part": part, "_piece": i, "_fn": _packed(fn)}[f.name] for _, i, fn in ends], f.type))
                else:
                    out.append(pa.nulls(len(ends), f.type))
            yield pa.RecordBatch.from_arrays(out, schema=schema)
    return run


def _replay_entries(kept: Sequence[str]):
    """Replay partitions' first drugs, sorted by (partition, order), from ``_entry``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bal = None, None
        for batch in batches:
            parts = batch.column("_part").to_numpy()
            steps, entry = batch.column("_s").to_pylist(), batch.column("_entry")
            accepted, after, n = [], [], len(parts)
            edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), n] if n else [0]
            for a, b in zip(edges, edges[1:]):
                if parts[a] != last:
                    last, bal = parts[a], entry[a].as_py()
                ok, got = replay(steps[a:b], bal)
                accepted += ok
                after += got
                bal = got[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(accepted, pa.bool_()), pa.array(after, pa.int64())],
                                             schema=pa.schema([*(batch.schema.field(c).with_nullable(True) for c in kept), *(pa.field(*f) for f in OUTCOME)]))
    return run


# ------------------------------------------------------------------ entry balances by composed functions
def _loose(fields) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields])


def entries(functions: DataFrame, keys: Sequence[str], fan: int = FAN, most: int = MOST_RUNS) -> DataFrame:
    """(keys, _part, _entry): the true balance at the start of every partition but the first of a drug.

    ``functions(keys, _open, _part, _piece, _fn)``: transfer functions in order of (_part, _piece). Upwards, ``fan`` neighbouring
    blocks become one row a level (more, if the function they make would have over ``most`` runs); downwards a block
    evaluates its members' functions one after another from its own entry."""
    key_fields = [functions.schema[k] for k in keys]
    up_schema = _loose([*key_fields, T.StructField("_block", T.LongType()), T.StructField("_part", T.IntegerType()), T.StructField("_piece", T.IntegerType()),
                        T.StructField("_open", T.LongType()), T.StructField("_fn", FUNCTION)])
    down_schema = _loose([*key_fields, T.StructField("_block", T.LongType()), T.StructField("_entry", T.LongType())])

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_part", "_piece"])
        rows, held = [], None
        for part, piece, f in zip(pdf["_part"], pdf["_piece"], pdf["_fn"], strict=True):
            f = _runs(f)
            both = compose(held, f, most) if held is not None else None
            if both is None:
                rows.append([part, piece, f])
            else:
                rows[-1][2] = both
            held = rows[-1][2]
        out = pd.DataFrame({"_part": [r[0] for r in rows], "_piece": [r[1] for r in rows], "_fn": [_packed(r[2]) for r in rows]})
        for c in (*keys, "_block", "_open"):
            out[c] = pdf[c].iat[0]
        return out[up_schema.fieldNames()]

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_part", "_piece"])
        x, out, seen = int(pdf["_entry"].iat[0]), [], None
        for block, f in zip(pdf["_block"], pdf["_fn"], strict=True):
            if block != seen:
                out.append((block, x))
                seen = block
            x = evaluate(_runs(f), x)
        got = pd.DataFrame(out, columns=["_block", "_entry"])
        for k in keys:
            got[k] = pdf[k].iat[0]
        return got[down_schema.fieldNames()]

    levels = [functions.withColumn("_block", F.col("_part").cast("long"))]
    top = functions.agg(F.max("_part")).first()[0] or 0
    while top >= fan:                           # a level up for each factor of ``fan`` in the number of partitions
        above = levels[-1].withColumn("_block", F.floor(F.col("_block") / fan)).select(*up_schema.fieldNames())
        levels.append(shared_table(above.groupBy(*keys, "_block").applyInPandas(up, up_schema), "ledger-functions"))
        top //= fan
    here = None
    for level in reversed(levels):
        rows = level.withColumn("_up", F.floor(F.col("_block") / fan))
        if here is None:
            rows = rows.withColumn("_entry", F.col("_open"))
        else:
            rows = rows.join(here.select(*keys, F.col("_block").alias("_up"), "_entry"), [*keys, "_up"])
        here = shared_table(rows.select(*keys, "_up", "_block", "_part", "_piece", "_fn", "_entry").groupBy(*keys, "_up").applyInPandas(down, down_schema), "ledger-entries")
    first = functions.groupBy(*keys).agg(F.min("_part").alias("_min"))
    return (here.join(first, list(keys)).where(F.col("_block") > F.col("_min"))
            .select(*keys, F.col("_block").cast("int").alias("_part"), "_entry"))


def stock_ledger_apply(drugs: DataFrame, requests: DataFrame, order: Sequence[str],
                       tenant: Sequence[str] = (), fan: int = FAN, most: int = MOST_RUNS) -> DataFrame:
    """Every request with ``accepted``, ``reason`` (NULL when accepted) and
    ``balance_after`` (stock after the request; NULL for an unknown drug).

    ``order`` names the request columns that give the total order within a
    drug (they must be unique per drug for a deterministic replay). The first
    pass is written to the shared checkpoint folder when this is called."""
    ship_package(requests.sparkSession)
    keys, kept = [*tenant, "drug_id"], requests.columns
    info = drugs.where(F.col("quantity_on_hand").isNotNull()).select(
        *tenant, F.col("id").alias("drug_id"), (F.col("quantity_on_hand") * F.lit(1000)).cast("long").alias("_open"),
        F.col("name").alias("_name"), F.col("unit").alias("_unit"), F.lit(0).alias("_spread"))
    spread = F.when(F.col("drug_id").isNull(), F.pmod(F.xxhash64(*order), F.lit(SPREAD)).cast("int") + 1).otherwise(0)
    joined = requests.withColumn("_spread", spread).join(info, [*keys, "_spread"], "left").withColumn("_s", signed_step())
    carried = [*kept, "_s", "_open", "_name", "_unit"]
    schema = _loose([*(joined.schema[c] for c in carried), T.StructField("accepted", T.BooleanType()), T.StructField("_after", T.LongType()),
                     T.StructField("_part", T.IntegerType()), T.StructField("_first", T.BooleanType()), T.StructField("_piece", T.IntegerType()),
                     T.StructField("_fn", FUNCTION)])
    passed = shared_table(joined.select(*carried).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
                          .mapInArrow(_first_pass(keys, carried, most), schema), "ledger-pass")
    rows = passed.where(F.col("_part").isNotNull() & F.col("_fn").isNull())
    functions = passed.where(F.col("_fn").isNotNull()).select(*keys, "_part", "_piece", "_fn").join(info.select(*keys, "_open"), keys)
    spans = functions.groupBy(*keys).agg(F.count_distinct("_part").alias("_n")).where("_n > 1").select(*keys)
    functions = shared_table(functions.join(spans, keys, "left_semi"), "ledger-spans")
    done = [*carried, "accepted", "_after"]
    out = rows
    if not functions.isEmpty():
        wrong = shared_table(entries(functions, keys, fan, most).join(info.select(*keys, "_open"), keys).where("_entry <> _open").drop("_open"), "ledger-wrong")
        again = (rows.where("_first").drop("accepted", "_after").join(wrong, [*keys, "_part"]).select(*carried, "_part", "_entry")
                 .repartition("_part").sortWithinPartitions("_part", *order)
                 .mapInArrow(_replay_entries(carried), _loose(schema[c] for c in done)))
        final = rows.join(wrong.select(*keys, "_part", F.lit(True).alias("_first")), [*keys, "_part", "_first"], "left_anti")
        out = final.select(*done).union(again)
    reason = refusal(F.col("_open").isNotNull(), F.col("accepted"), F.col("_s"), F.col("_after"), F.col("_name"), F.col("_unit"))
    return out.select(*kept, "accepted", reason.alias("reason"), (F.col("_after").cast("decimal(20,0)") / 1000).cast(QTY).alias("balance_after"))


def accepted_movements(ledger: DataFrame) -> DataFrame:
    """The movement log the replay writes: accepted requests only."""
    return ledger.where(F.col("accepted")).drop("accepted", "reason")


def stock_on_hand(drugs: DataFrame, ledger: DataFrame, order: Sequence[str], tenant: Sequence[str] = ()) -> DataFrame:
    """Final quantity per drug: balance after its last request, or the
    opening stock when it had none. Partial-aggregated max over the order key."""
    last = (ledger.where(F.col("balance_after").isNotNull())
            .groupBy(*tenant, "drug_id")
            .agg(F.max(F.struct(*[F.col(c) for c in order], F.col("balance_after"))).alias("_last")))
    d = drugs.select(*tenant, F.col("id").alias("drug_id"), "name", F.col("quantity_on_hand").alias("opening"))
    return (d.join(last, [*tenant, "drug_id"], "left")
            .select(*tenant, "drug_id", "name", "opening",
                    F.coalesce(F.col("_last.balance_after"), F.col("opening")).alias("quantity_on_hand")))


def stock_expiry_replace(drugs: DataFrame, ledger: DataFrame, order: Sequence[str],
                         tenant: Sequence[str] = ()) -> DataFrame:
    """A restock that carries an expiry date replaces the stored one (the
    latest such restock wins); a blank expiry keeps what is stored."""
    newest = (ledger.where(F.col("accepted") & (F.col("type") == "restock") & F.col("expiry_date").isNotNull())
              .groupBy(*tenant, "drug_id")
              .agg(F.max(F.struct(*[F.col(c) for c in order], F.col("expiry_date"))).alias("_new")))
    d = drugs.select(*tenant, F.col("id").alias("drug_id"), F.col("expiry_date").alias("old_expiry_date"))
    return (d.join(newest, [*tenant, "drug_id"], "left")
            .select(*tenant, "drug_id", "old_expiry_date",
                    F.coalesce(F.col("_new.expiry_date"), F.col("old_expiry_date")).alias("expiry_date")))


def stock_reconcile(opening: DataFrame, movements: DataFrame, stored: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Every drug's opening stock plus the signed sum of its logged movements, against the stored
    quantity; ``balanced`` is false where the log does not explain what is stored.
    ``opening`` and ``stored``: drugs (id, quantity_on_hand) before and after; ``movements``: the log."""
    signed = F.when(F.col("type") == "restock", F.col("quantity")).otherwise(-F.col("quantity"))
    net = movements.groupBy(*tenant, "drug_id").agg(F.sum(signed).alias("net_movement"), F.count(F.lit(1)).alias("accepted_count"))
    now = stored.select(*tenant, F.col("id").alias("drug_id"), F.col("quantity_on_hand").alias("stored"))
    d = opening.select(*tenant, F.col("id").alias("drug_id"), F.col("quantity_on_hand").alias("opening"))
    kind = "decimal(20,3)"
    return (d.join(now, [*tenant, "drug_id"], "left").join(net, [*tenant, "drug_id"], "left")
            .select(*tenant, "drug_id", "opening", F.coalesce("net_movement", F.lit(0)).cast(kind).alias("net_movement"),
                    F.coalesce("accepted_count", F.lit(0)).alias("accepted_count"), F.col("stored").alias("quantity_on_hand"),
                    (F.col("opening").cast(kind) + F.coalesce("net_movement", F.lit(0)).cast(kind)).eqNullSafe(F.col("stored").cast(kind)).alias("balanced")))
