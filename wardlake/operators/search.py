"""Projection, filter and search lists (screens' lists, re-aimed to batches).

Lists with a ``cap`` (the screens use ``schemas.LIST_CAP``) get an id tie-break so the cap is
deterministic. With a tenant key the cap applies per clinic through
``row_number() <= cap`` over the clinic window, which Spark plans as a
partial top-N before the shuffle (no whole clinic is gathered in one task).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import like_ascii
from ..schemas import EXPIRY_HORIZON_DAYS


def top_rows(df: DataFrame, order: Sequence[Column], cap: int | None, tenant: Sequence[str] = ()) -> DataFrame:
    """First ``cap`` rows by ``order`` (per tenant when given). ``cap=None`` keeps all rows."""
    if cap is None:
        return df.orderBy(*[F.col(t) for t in tenant], *order)
    if not tenant:
        return df.orderBy(*order).limit(cap)
    w = Window.partitionBy(*tenant).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def _matches(cols: Sequence[str], term: str | None) -> Column | None:
    if term is None or not term.strip():
        return None
    cond = None
    for c in cols:
        m = like_ascii(F.col(c), term)
        cond = m if cond is None else (cond | m)
    return cond


def search_patients(patients: DataFrame, term: str | None = None, cap: int | None = None,
                    tenant: Sequence[str] = ()) -> DataFrame:
    """Substring match on first name, last name or phone; blank term lists all.
    Ordered by last name, first name (then id)."""
    cond = _matches(("first_name", "last_name", "phone"), term)
    df = patients if cond is None else patients.where(cond)
    return top_rows(df, [F.col("last_name"), F.col("first_name"), F.col("id")], cap, tenant)


def search_drugs(drugs: DataFrame, term: str | None = None, cap: int | None = None,
                 tenant: Sequence[str] = ()) -> DataFrame:
    cond = _matches(("name",), term)
    df = drugs if cond is None else drugs.where(cond)
    return top_rows(df, [F.col("name"), F.col("id")], cap, tenant)


def search_clients(clients: DataFrame, term: str | None = None, cap: int | None = None,
                   tenant: Sequence[str] = ()) -> DataFrame:
    cond = _matches(("name", "phone"), term)
    df = clients if cond is None else clients.where(cond)
    return top_rows(df, [F.col("name"), F.col("id")], cap, tenant)


def full_listing(df: DataFrame, order: Sequence[str], tenant: Sequence[str] = ()) -> DataFrame:
    """Unlimited, ordered listing (exports)."""
    return top_rows(df, [F.col(c) for c in order] + [F.col("id")], None, tenant)


def staff_directory(staff: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Staff without any credential column, by name."""
    cols = [*tenant, "id", "name", "role", "username", "active"]
    if "created_at" in staff.columns:
        cols.append("created_at")
    return staff.select(*cols).orderBy(*[F.col(t) for t in tenant], "name", "id")


def lookup_by_keys(df: DataFrame, keys: DataFrame, key: str = "id", tenant: Sequence[str] = ()) -> DataFrame:
    """Records whose key is in ``keys`` (a batch of lookups); semi join keeps
    each record once however often it is asked for."""
    return df.join(keys.select(*tenant, key).distinct(), [*tenant, key], "left_semi")


def lookup_staff_by_username(staff: DataFrame, usernames: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Username lookups are trimmed and lower-cased like stored usernames."""
    keys = usernames.select(*tenant, F.lower(F.trim(F.col("username"))).alias("username"))
    return lookup_by_keys(staff, keys, "username", tenant)


def low_stock(drugs: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """On hand at or below the reorder level (inclusive), by name."""
    return (drugs.where(F.col("quantity_on_hand") <= F.col("reorder_level"))
            .orderBy(*[F.col(t) for t in tenant], "name", "id"))


def expiring_soon(drugs: DataFrame, as_of: dt.date, horizon_days: int = EXPIRY_HORIZON_DAYS,
                  tenant: Sequence[str] = ()) -> DataFrame:
    """Known expiry on or before as_of + horizon. Already expired drugs count."""
    limit = as_of + dt.timedelta(days=horizon_days)
    return (drugs.where(F.col("expiry_date").isNotNull() & (F.col("expiry_date") <= F.lit(limit)))
            .orderBy(*[F.col(t) for t in tenant], "expiry_date", "id"))


def drug_flags(drugs: DataFrame, as_of: dt.date, horizon_days: int = EXPIRY_HORIZON_DAYS) -> DataFrame:
    """Every drug with its low-stock and expiring-soon flags."""
    limit = as_of + dt.timedelta(days=horizon_days)
    return drugs.select(
        "*",
        (F.col("quantity_on_hand") <= F.col("reorder_level")).alias("is_low"),
        F.coalesce(F.col("expiry_date") <= F.lit(limit), F.lit(False)).alias("is_expiring"),
    )
