"""Set operations: the dashboard's "needs attention" list (a bag union)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import js_decimal_text
from ..schemas import EXPIRY_HORIZON_DAYS
from .search import expiring_soon, low_stock


def needs_attention(drugs: DataFrame, as_of: dt.date, horizon_days: int = EXPIRY_HORIZON_DAYS,
                    tenant: Sequence[str] = ()) -> DataFrame:
    """Low-stock rows then expiring rows, each with reason and detail text. A
    drug that is both appears twice (UNION ALL); the count is the row count."""
    unit = F.coalesce(F.nullif(F.col("unit"), F.lit("")), F.lit("unit(s)"))
    low = low_stock(drugs, tenant).select(
        *tenant, F.lit(1).alias("section"), F.col("id").alias("drug_id"), "name",
        F.lit("Low Stock").alias("reason"),
        F.concat(js_decimal_text(F.col("quantity_on_hand")), F.lit(" "), unit, F.lit(" left (reorder at "),
                 js_decimal_text(F.col("reorder_level")), F.lit(")")).alias("detail"))
    soon = expiring_soon(drugs, as_of, horizon_days, tenant).select(
        *tenant, F.lit(2).alias("section"), F.col("id").alias("drug_id"), "name",
        F.lit("Expiring Soon").alias("reason"),
        F.concat(F.lit("Expires "), F.col("expiry_date").cast("string")).alias("detail"))
    return low.unionByName(soon)
