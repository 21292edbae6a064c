"""Registered streaming queries: each runs the stream over the bound driver
tables to the end of its input (availableNow) and returns the sink. The
oracle is the batch answer, since batch and stream must agree."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..streaming import streams
from . import catalog
from .catalog import LEDGER_ORDER, dbl, query, tables

ARRIVALS = 4


def arriving(df: DataFrame, time: str, parts: int = ARRIVALS) -> tuple[DataFrame, Iterator[int]]:
    """``df`` as a stream of ``parts`` micro-batches, and their arrivals: each step of the iterator writes the rows of the next span of time,
    by all tasks, where the stream finds them; a run after each step takes them as one micro-batch. Every row is in one of them."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    ends = df.agg(F.min(time).cast("timestamp").cast("double").alias("a"), F.max(time).cast("timestamp").cast("double").alias("b")).first()
    at = F.coalesce(F.floor((F.col(time).cast("timestamp").cast("double") - (ends.a or 0)) / max(((ends.b or 0) - (ends.a or 0)) / parts, 1e-9)), F.lit(0))

    def arrivals() -> Iterator[int]:
        for k in range(parts):
            df.where(F.least(at, F.lit(parts - 1)) == k).write.parquet(f"{folder}/part={k}")
            yield k

    return spark.readStream.schema(df.schema).parquet(f"{folder}/part=*"), arrivals()


_LEDGER_SQL = catalog.REGISTRY["stock_ledger_apply"][1]
_QUOTA_SQL_BODY = """
SELECT clinic_id, message_id, day, n <= 100 AS admitted, CASE WHEN n > 100 THEN 'daily limit reached' END AS reason
FROM (SELECT clinic_id, message_id, CAST(sent_at + INTERVAL 1 HOUR AS DATE) AS day,
             row_number() OVER (PARTITION BY clinic_id, CAST(sent_at + INTERVAL 1 HOUR AS DATE) ORDER BY sent_at, message_id) AS n
      FROM assistant_messages)"""


@query("stream_daily_income", """
SELECT visit_date AS day, CAST(sum(payment_amount) AS DOUBLE) AS income, count(*) AS visits
FROM visits GROUP BY visit_date""")
def q_stream_daily_income(spark, sf):
    """Every day of the input, over several micro-batches."""
    visits, arrivals = arriving(tables(spark, sf)["visits"], "visit_date")
    days, _ = streams.run_daily_income(visits, "daily_income", arrivals=arrivals)
    return days.select("day", dbl("income"), "visits")


@query("stream_stock_ledger", sql=_LEDGER_SQL)
def q_stream_stock_ledger(spark, sf):
    t = tables(spark, sf)
    requests, arrivals = arriving(t["stock_requests"], "requested_at")
    out = streams.run_available_now(streams.stream_stock_ledger(requests, t["drugs"], LEDGER_ORDER), "stock_ledger", arrivals=arrivals)
    return out.select("drug_id", "src_order", "src_line", "src_flag", "type", dbl("quantity"), "created_by_staff_id", "accepted", "reason",
                      dbl("balance_after"))


@query("stream_quota", _QUOTA_SQL_BODY)
def q_stream_quota(spark, sf):
    messages, arrivals = arriving(tables(spark, sf)["assistant_messages"], "sent_at")
    s = streams.stream_quota(messages, tz="+01:00", limit=100)
    return streams.run_available_now(s, "quota", arrivals=arrivals).select("clinic_id", "message_id", "day", "admitted", "reason")
