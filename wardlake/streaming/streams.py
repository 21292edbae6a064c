"""Structured Streaming forms of the operations that arrive one at a time.

* ``stream_stock_ledger``: requests replayed per (clinic, drug) with the
  balance kept in state across micro-batches (``transformWithStateInPandas``).
  Rows of one micro-batch are sorted by the order key inside the function, many drugs in a call.
* ``stream_quota``: assistant messages admitted with a count per clinic
  and open local day in state; closed days leave it.
* ``run_daily_income``: income of every day, each day once when it is closed, and the rows that came too late.
* ``stream_daily_income``: the same as an event-time window with Spark's own watermark (rows later than it are
  dropped, days it has not passed stay open), for complete mode.

Batch and stream agree when the requests/messages of one key arrive in order
across micro-batches (the file source hands files over in arrival order).
Memory per key and micro-batch is that micro-batch's rows of the key; the
state itself is a few numbers. ``run_available_now`` drives a query to the
end of its input and returns the sink as a DataFrame.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import refusal, replay, signed_step
from ..schemas import AI_DAILY_LIMIT, QTY
from ..session import checkpoint_dir, ship_package


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Exact texts of days and instants in the rows that travel as JSON.
ROW_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


# ------------------------------------------------------------------ runner
def run_available_now(df: DataFrame, name: str, mode: str = "append", base: str | None = None, arrivals: Iterable = (None,)) -> DataFrame:
    """Run a streaming query over everything available, then stop; with ``arrivals``, once after each of its steps, which bring
    new rows: a run goes on where the one before it stopped.

    The sink is parquet under the session's checkpoint folder (shared storage
    on a cluster). Each micro-batch overwrites its own ``batch=<id>`` folder,
    so a batch replayed after a failure replaces its earlier attempt instead
    of adding rows (exactly-once output with the checkpointed offsets).
    Complete mode rewrites the whole result each micro-batch. Returns the
    sink read back as a batch DataFrame. ``base``: a folder of its own for sink and checkpoint, to go on from."""
    spark = df.sparkSession
    base = base or f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, epoch: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{out}/batch=0")
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    for _ in arrivals:
        q = (df.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(out).select(*df.columns)


# ------------------------------------------------------------------ stock ledger
#: Drugs are dealt to so many groups; a call of the processor replays a trigger's rows of one group.
GROUPS = 2048
LAST = 2**63 - 1


def _sortable(c: Column, kind: T.DataType) -> Column:
    """An order column as a whole number where its values are exact ones (NULL: the largest, as NULLs come last), else as it is."""
    if isinstance(kind, T.IntegralType):
        n = c.cast("long")
    elif isinstance(kind, T.TimestampType):
        n = F.unix_micros(c)
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        n = (c * F.lit(10 ** kind.scale)).cast("long")
    else:
        return c
    return F.coalesce(n, F.lit(LAST))


def _columns(balances: dict[tuple, int]) -> tuple:
    return (*map(list, zip(*balances, strict=True)), list(balances.values()))


def in_order(pdf: pd.DataFrame, drug: Sequence[str], by: Sequence[str]) -> pd.DataFrame:
    """Rows sorted by (drug, by). Two order columns tell most rows of a drug apart; the others are looked at for the rest alone."""
    first = [*drug, *by[:2]]
    out = pdf.sort_values(first)
    tied = out.duplicated(first, keep=False).to_numpy()
    if tied.any():
        place = out.index.to_numpy().copy()
        place[tied] = out[tied].sort_values([*drug, *by]).index.to_numpy()
        out = pdf.loc[place]
    return out


def stream_stock_ledger(requests: DataFrame, drugs: DataFrame, order: Sequence[str],
                        tenant: Sequence[str] = (), groups: int = GROUPS) -> DataFrame:
    """Streaming replay of stock requests; same output columns as the batch
    ledger (all request columns, accepted, reason, balance_after). ``drugs`` is
    static: the opening stock is read when a drug is first seen, later batches use state.

    State (``transformWithStateInPandas``, RocksDB) is one number for each (clinic, drug), the balance. Drugs are dealt to ``groups``
    groups by a hash (fixed while a checkpoint is used), so that one call replays many drugs: a trigger reads the balances of the groups it has requests
    for and appends those of the drugs it has requests for; a group's list is written anew when half of it is outdated.
    Requests for drugs that are not known (or NULL) are refused by the join with
    ``drugs`` and leave nothing in state, so a drug that is added later is
    known from then on. Columns that the replay does not use travel as one JSON text and come back as they were. A trigger's
    requests of one group are sorted together; ``maxFilesPerTrigger`` (``stream_table``) bounds a trigger's rows."""
    from pyspark.sql.streaming import StatefulProcessor
    spark = requests.sparkSession
    ship_package(spark)
    spark.conf.set(STATE_STORE, ROCKSDB)
    d = drugs.where(F.col("quantity_on_hand").isNotNull()).select(
        *tenant, F.col("id").alias("drug_id"), (F.col("quantity_on_hand") * F.lit(1000)).cast("long").alias("_open"), F.col("name").alias("_name"), F.col("unit").alias("_unit"))
    keys, kept = [*tenant, "drug_id"], requests.columns
    r = requests.join(d, keys, "left").withColumn("_s", signed_step())
    row = F.to_json(F.struct(*kept, "_name", "_unit"), ROW_TEXT)
    known = r.where(F.col("_open").isNotNull()).select(
        F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias("in_group"), *[F.col(k).alias(f"in_key_{i}") for i, k in enumerate(keys)],
        F.col("_s").alias("in_step"), F.col("_open").alias("in_open"), row.alias("in_row"), F.struct(*order).cast("string").alias("in_tie"),
        *[_sortable(F.col(c), r.schema[c].dataType).alias(f"in_{i}") for i, c in enumerate(order)])   # names with a leading underscore do not reach the processor
    lost = r.where(F.col("_open").isNull()).select(*kept, "_name", "_unit", "_s", F.lit(False).alias("accepted"), F.lit(None).cast("long").alias("_after"), F.lit(False).alias("_known"))
    drug, by = [f"in_key_{i}" for i in range(len(keys))], [*(f"in_{i}" for i in range(len(order))), "in_tie"]
    balances = T.StructType([*(T.StructField(k, T.ArrayType(known.schema[k].dataType)) for k in drug), T.StructField("milli", T.ArrayType(T.LongType()))])

    class Balance(StatefulProcessor):
        """A group's drugs: their balances are all that is kept."""

        def init(self, handle) -> None:
            self.balances = handle.getListState("balances", balances)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            pdf = in_order(pd.concat(list(rows), ignore_index=True), drug, by)
            held, told = {}, 0
            for chunk in self.balances.get() if self.balances.exists() else ():
                *names, milli = chunk
                held.update(zip(zip(*names, strict=True), milli, strict=True))
                told += len(milli)
            names, steps, opens = list(zip(*(pdf[k].tolist() for k in drug), strict=True)), pdf["in_step"].tolist(), pdf["in_open"].tolist()
            accepted, after, new, a = [], [], {}, 0
            for name, same in groupby(names):
                b = a + sum(1 for _ in same)
                ok, got = replay(steps[a:b], held.get(name, opens[a]))
                accepted += ok
                after += got
                new[name] = got[-1]
                a = b
            whole = held | new
            if told + len(new) > 2 * len(whole):         # as many outdated balances as there are drugs
                self.balances.put([_columns(whole)])
            else:
                self.balances.appendValue(_columns(new))
            yield pd.DataFrame({"_row": pdf["in_row"].to_numpy(), "_s": pdf["in_step"].to_numpy(), "accepted": accepted, "_after": after})

        def close(self) -> None:
            pass

    folded = known.groupBy("in_group").transformWithStateInPandas(
        Balance(), "_row string, _s long, accepted boolean, _after long", "Append", "None")
    back = T.StructType([*requests.schema.fields, T.StructField("_name", T.StringType()), T.StructField("_unit", T.StringType())])
    told = folded.select(F.from_json("_row", back, ROW_TEXT).alias("r"), "_s", "accepted", "_after").select("r.*", "_s", "accepted", "_after", F.lit(True).alias("_known"))
    reason = refusal(F.col("_known"), F.col("accepted"), F.col("_s"), F.col("_after"), F.col("_name"), F.col("_unit"))
    return told.unionByName(lost).select(*kept, "accepted", reason.alias("reason"), (F.col("_after").cast("decimal(20,0)") / 1000).cast(QTY).alias("balance_after"))


# ------------------------------------------------------------------ assistant quota
OPEN_DAYS = 2
REASON_LIMIT = "daily limit reached"
REASON_CLOSED = "day is closed"


def stream_quota(messages: DataFrame, tz: str = "UTC", limit: int = AI_DAILY_LIMIT,
                 tenant: Sequence[str] = ("clinic_id",), open_days: int = OPEN_DAYS) -> DataFrame:
    """Streaming admission (message_id, day, admitted, ``reason`` of a refusal): the first ``limit`` messages of each clinic and
    local day, by (sent_at, message_id) within a trigger and by arrival between triggers.

    State per clinic (``transformWithStateInPandas``, RocksDB): a map from open day to its count, and the newest day
    seen. A clinic's newest ``open_days`` days are open; when a newer one comes, older ones leave the map, so the state never has
    more than ``open_days`` rows a clinic. A message for a day that an earlier trigger closed is refused with a reason; it
    neither resets nor uses another day's quota. A NULL time has no day and is refused as closed."""
    from pyspark.sql.streaming import StatefulProcessor
    spark = messages.sparkSession
    ship_package(spark)
    spark.conf.set(STATE_STORE, ROCKSDB)
    m = messages.withColumn("day", F.to_date(F.from_utc_timestamp(F.col("sent_at"), tz)))
    narrow = m.select(*tenant, "message_id", "sent_at", F.coalesce(F.unix_date("day"), F.lit(-2**31)).alias("day_no"))
    kinds = [f"{c} {m.schema[c].dataType.simpleString()}" for c in (*tenant, "message_id")]

    class DayCounts(StatefulProcessor):
        """A clinic's open days and how many messages each has admitted."""

        def init(self, handle) -> None:
            self.counts = handle.getMapState("counts", "day int", "n long")
            self.newest = handle.getValueState("newest", "day int")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(list(rows), ignore_index=True).sort_values(["day_no", "sent_at", "message_id"], kind="mergesort")
            before = self.newest.get()[0] if self.newest.exists() else None
            least = -2**31 + 1 if before is None else before - open_days + 1
            after = max(int(pdf["day_no"].max()), least if before is None else before)
            admitted, why = [], []
            for day, n in pdf.groupby("day_no", sort=True).size().items():
                if day < least:
                    admitted += [False] * n
                    why += [REASON_CLOSED] * n
                    continue
                used = self.counts.getValue((int(day),))[0] if self.counts.containsKey((int(day),)) else 0
                free = min(n, max(0, limit - used))
                admitted += [True] * free + [False] * (n - free)
                why += [None] * free + [REASON_LIMIT] * (n - free)
                if day > after - open_days:
                    self.counts.updateValue((int(day),), (used + free,))
            for (day,) in [tuple(k) for k in self.counts.keys()]:
                if day <= after - open_days:
                    self.counts.removeKey((day,))
            self.newest.update((after,))
            yield pd.DataFrame({**{c: pdf[c].to_numpy() for c in (*tenant, "message_id", "day_no")}, "admitted": admitted, "reason": pd.array(why, dtype="string")})

        def close(self) -> None:
            pass

    out = narrow.groupBy(*tenant).transformWithStateInPandas(
        DayCounts(), ", ".join([*kinds, "day_no int", "admitted boolean", "reason string"]), "Append", "None")
    return out.select(*tenant, "message_id", F.when(F.col("day_no") > -2**31, F.date_from_unix_date("day_no")).alias("day"), "admitted", "reason")


# ------------------------------------------------------------------ daily income
def stream_daily_income(visits: DataFrame, watermark: str = "1 day", tenant: Sequence[str] = ()) -> DataFrame:
    """Income and visit count per visit day (one-day tumbling event-time
    window), per clinic when a tenant key is given. The event time is the
    visit date as a TIMESTAMP (a watermark needs TIMESTAMP, not
    TIMESTAMP_NTZ). Use complete mode to see every day, append mode to get
    each day once the watermark has closed it."""
    v = visits.select(*tenant, F.col("visit_date").cast("timestamp").alias("event_time"), "payment_amount")
    return (v.withWatermark("event_time", watermark)
            .groupBy(*tenant, F.window("event_time", "1 day"))
            .agg(F.sum("payment_amount").alias("income"), F.count(F.lit(1)).alias("visits"))
            .select(*tenant, F.to_date(F.col("window.start")).alias("day"), "income", "visits"))


def run_daily_income(visits: DataFrame, name: str, delay_days: int = 1, tenant: Sequence[str] = (), arrivals: Iterable = (None,)) -> tuple[DataFrame, DataFrame]:
    """(days, late): income and visits of every day of the input, each day exactly once, and the rows that came too late.

    Runs over everything available, once after each step of ``arrivals`` (as ``run_available_now``). After each micro-batch the days more than ``delay_days`` before the newest day seen are closed and
    come out; at the end of the input the rest are. A row for a day that an earlier batch closed, or without a
    date, is not added to anything: it is returned in ``late`` with its columns and the ``batch`` that brought it.

    Between batches the only state is a row per (tenant, day, batch) of partial sums and a row per batch of the newest day,
    as Parquet below the checkpoint folder. A batch writes folders of its own number from its rows and earlier batches'
    folders alone, so a batch repeated after a failure replaces its first attempt."""
    spark = visits.sparkSession
    base = f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    kinds = [f"{c} {visits.schema[c].dataType.simpleString()}" for c in tenant]
    sums = ", ".join([*kinds, "day date", "income decimal(28,2)", "visits long", "batch long"])

    def parts(kind: str, schema: str, before: int) -> DataFrame:
        """What batches before ``before`` have written."""
        if not before:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*(f"{base}/{kind}/batch={i}" for i in range(before))).drop("batch")

    def closed_before(batch: int):
        newest = parts("clock", "day date, batch long", batch).agg(F.max("day")).first()[0]
        return None if newest is None else newest - dt.timedelta(days=delay_days)

    def finish(start, end, batches: int, folder: str) -> None:
        """Days in [start, end) come out, from the partial sums of the batches so far."""
        days = parts("sums", sums, batches)
        if start is not None:
            days = days.where(F.col("day") >= F.lit(start))
        if end is not None:
            days = days.where(F.col("day") < F.lit(end))
        days.groupBy(*tenant, "day").agg(F.sum("income").cast("decimal(28,2)").alias("income"), F.sum("visits").alias("visits")).write.mode("overwrite").parquet(f"{base}/days/{folder}")

    def write(batch: DataFrame, number: int) -> None:
        closed = closed_before(number)
        rows = batch.withColumn("_late", F.lit(False) if closed is None else F.col("visit_date") < F.lit(closed))
        good = F.col("visit_date").isNotNull() & ~F.col("_late")
        rows.where(~F.coalesce(good, F.lit(False))).drop("_late").write.mode("overwrite").parquet(f"{base}/late/batch={number}")
        (rows.where(good).groupBy(*tenant, F.col("visit_date").alias("day")).agg(F.sum("payment_amount").cast("decimal(28,2)").alias("income"), F.count(F.lit(1)).alias("visits"))
         .write.mode("overwrite").parquet(f"{base}/sums/batch={number}"))
        batch.agg(F.max("visit_date").alias("day")).write.mode("overwrite").parquet(f"{base}/clock/batch={number}")
        now = closed_before(number + 1)
        if now is not None:
            finish(closed, now, number + 1, f"batch={number}")

    done = 0
    for _ in arrivals:
        q = (visits.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
        done = max([done, *(1 + p["batchId"] for p in q.recentProgress if p["numInputRows"])])
    finish(closed_before(done), None, done, "end")
    late = spark.createDataFrame([], T.StructType([*visits.schema.fields, T.StructField("batch", T.IntegerType())]))
    if done:
        late = spark.read.schema(late.schema).parquet(f"{base}/late")
    return spark.read.option("recursiveFileLookup", True).schema(sums.removesuffix(", batch long")).parquet(f"{base}/days"), late
