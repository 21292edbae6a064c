"""Latest order per (client, medication), refills due, bar scaling.

"Latest per key" is an aggregate, not a window: ``max(struct(entry_date,
id, ...))`` orders lexicographically, so the newest row (id breaks date ties)
wins, and Spark combines it map-side before the shuffle. A client who holds
a third of all history rows then costs one row per map task downstream,
where a ``row_number`` window would sort that whole group in one task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import REFILL_WINDOW_DAYS
from .joins import refillable_orders

def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` tuple per ``keys`` (NULL keys form a group)."""
    payload = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in payload])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in (*order, *payload)])


def latest_order_per_medication(history: DataFrame, clients: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Newest refillable order per (client, medication); older ones are superseded.
    A NULL medication is its own group."""
    h = history.where((F.col("entry_type") == "Order") & F.col("day_supply").isNotNull())
    latest = latest_per_key(h, [*tenant, "client_id", "medication"], ["entry_date", "id"])
    return refillable_orders(latest, clients, tenant)


def refills_due(history: DataFrame, clients: DataFrame, as_of: dt.date, window_days: int = REFILL_WINDOW_DAYS,
                tenant: Sequence[str] = ()) -> DataFrame:
    """Active clients whose latest order of a medication is due within
    ``window_days`` (overdue is negative and kept), not yet reminded.

    Order matters: the latest order is chosen first, then the status and
    reminder filters apply, so a reminded newest order still hides older ones."""
    latest = latest_order_per_medication(history, clients, tenant)
    due = F.date_add(F.col("entry_date"), F.col("day_supply").cast("int"))
    return (latest.where((F.col("client_status") == "Active") & F.col("reminder_sent_at").isNull())
            .withColumn("due_date", due)
            .withColumn("days_until_due", F.datediff(F.col("due_date"), F.lit(as_of)))
            .where(F.col("days_until_due") <= window_days))


def trend_bar_scale(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Bar height in percent of the largest value of its set:
    max(4, round(100 * v / max(1, max(v)))), plus the short month name as the
    bar label when the set has a ``month`` column. The maximum per set is
    a window over the set's bars (a chart holds a few months)."""
    base = df.withColumn("_max", F.max(F.col(value)).over(Window.partitionBy(*(group or [F.lit(1)]))))
    top_col = F.col("_max")
    pct = F.floor(F.col(value).cast("double") * 100.0 / F.greatest(F.lit(1.0), top_col.cast("double")) + 0.5)
    out = base.withColumn("height_pct", F.greatest(F.lit(4), pct.cast("int")))
    if "month" in out.columns:                      # bar label: short month name of a 'yyyy-MM' label
        out = out.withColumn("label", F.date_format(F.to_date(F.col("month"), "yyyy-MM"), "MMM"))
    out = out.drop("_max")
    order = [c for c in (*group, "month_index") if c in out.columns]
    return out.orderBy(*order) if "month_index" in order else out
