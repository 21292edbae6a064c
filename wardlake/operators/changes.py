"""UPDATE / UPSERT as set operations: a batch of changes against a table.

"Last change wins" is ``max(struct(seq, value...))`` per key, an aggregate
Spark combines map-side, so a key changed a million times costs one row per
map task before the shuffle. The result is joined back to the base table and
unchanged rows pass through.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import col_add_months_overflow, js_trim, present
from ..schemas import (AI_DAILY_LIMIT, APPOINTMENT_STATUSES, CLIENT_STATUSES, PLAN_MONTHS, PLAN_PRICES, PLANS,
                       SECRET_SETTING_KEYS, TRIMMED_SETTING_KEYS)


def latest_change(changes: DataFrame, keys: Sequence[str], cols: Sequence[str], seq: str = "seq") -> DataFrame:
    """Per key, the values of the change with the greatest ``seq``."""
    best = F.max(F.struct(F.col(seq), *[F.col(c) for c in cols])).alias("_c")
    return changes.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_c.{c}").alias(c) for c in cols])


def apply_latest(base: DataFrame, changes: DataFrame, cols: Sequence[str], key: str = "id",
                 tenant: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """Base rows with the latest change applied to ``cols``; changes for keys
    not in the base are ignored."""
    latest = latest_change(changes, [*tenant, key], cols, seq)
    renamed = latest.select(*tenant, key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = base.join(renamed, [*tenant, key], "left")
    out = j.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                     for c in base.columns])
    return out


def settings_upsert(current: DataFrame, changes: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Last value per key wins over the stored value. A change without a
    value (an absent form field), or a blank value for a secret key, leaves the
    stored value alone; values typed into the settings forms are trimmed. ``current`` may lack ``seq`` (it then loses to any change)."""
    cur = current if "seq" in current.columns else current.withColumn("seq", F.lit(-1))
    changes = changes.withColumn("value", F.when(F.col("key").isin(*TRIMMED_SETTING_KEYS), js_trim(F.col("value"))).otherwise(F.col("value")))
    keep = F.col("value").isNotNull() & ~(F.col("key").isin(*SECRET_SETTING_KEYS) & ~present(F.col("value")))
    both = cur.select(*tenant, "key", "value", F.col("seq").cast("long").alias("seq")).unionByName(
        changes.where(keep).select(*tenant, "key", "value", F.col("seq").cast("long").alias("seq")))
    return latest_change(both, [*tenant, "key"], ["value"])


def settings_pivot(settings: DataFrame, keys: Sequence[str], tenant: Sequence[str] = ("clinic_id",)) -> DataFrame:
    """One row per clinic present in ``settings`` (latest values, one row per
    key), one column per requested key (NULL when unset). Conditional
    aggregation over a fixed key list: one pass, partial-aggregated, and a
    clinic without any of the keys still gets its row."""
    return settings.groupBy(*tenant).agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def apply_appointment_status(appointments: DataFrame, changes: DataFrame,
                             tenant: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(updated appointments, rejected changes with ``reason``). Any status may
    follow any other; the last valid change per appointment wins."""
    valid = F.coalesce(F.col("status").isin(*APPOINTMENT_STATUSES), F.lit(False))
    unknown = changes.where(valid).join(appointments.select(*tenant, "id"), [*tenant, "id"], "left_anti")
    rejected = (changes.where(~valid).withColumn("reason", F.lit("status must be one of: " + ", ".join(APPOINTMENT_STATUSES)))
                .unionByName(unknown.withColumn("reason", F.concat(F.lit("No appointment with id "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))))
    return apply_latest(appointments, changes.where(valid), ["status"], tenant=tenant), rejected


def apply_client_status(clients: DataFrame, changes: DataFrame,
                        tenant: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Active/Inactive only (others rejected); an unknown id is a silent no-op."""
    valid = F.coalesce(F.col("status").isin(*CLIENT_STATUSES), F.lit(False))
    bad = changes.where(~valid).withColumn("reason", F.lit("status must be Active or Inactive"))
    return apply_latest(clients, changes.where(valid), ["status"], tenant=tenant), bad


def apply_staff_active(staff: DataFrame, changes: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Activate / deactivate accounts (truthy -> 1); accounts are never deleted."""
    c = changes.withColumn("active", F.when(F.coalesce(F.col("active").cast("boolean"), F.lit(False)), 1).otherwise(0))
    return apply_latest(staff, c, ["active"], tenant=tenant)


def apply_reminders_sent(history: DataFrame, marks: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Stamp ``reminder_sent_at`` on the marked history rows (latest mark wins)."""
    m = marks.select(*tenant, "id", F.col("sent_at").alias("reminder_sent_at"),
                     F.col("sent_at").alias("seq"))
    return apply_latest(history, m, ["reminder_sent_at"], tenant=tenant)


def license_apply(current: DataFrame, feed: DataFrame, tenant: Sequence[str] = ("clinic_id",)) -> DataFrame:
    """Clinics whose feed entry changes something: the date differs, or a plan
    is given and differs. A feed row without a plan keeps the current plan.
    ``current``: tenant, licenseExpiresAt, licensePlan; ``feed``: tenant,
    expires_at, plan."""
    j = feed.join(current, list(tenant), "left")
    date_changed = ~F.col("expires_at").eqNullSafe(F.col("licenseExpiresAt"))
    plan_changed = F.col("plan").isNotNull() & ~F.col("plan").eqNullSafe(F.col("licensePlan"))
    return (j.where(date_changed | plan_changed)
            .select(*tenant, F.col("expires_at").alias("licenseExpiresAt"),
                    F.coalesce(F.col("plan"), F.col("licensePlan")).alias("licensePlan"),
                    date_changed.alias("expires_changed"), plan_changed.alias("plan_changed")))


def license_renewal_dates(clinics: DataFrame, as_of: dt.date) -> DataFrame:
    """Quote of every plan for every clinic, both first purchase and renewal:
    buy runs from as_of; renew extends from the later of the current date and
    as_of (renewing early loses nothing). Month steps overflow like the
    application's (Aug 31 + 6 months = Mar 3). ``clinics``: clinic_id,
    licenseExpiresAt (text)."""
    prices = F.array(*[F.struct(F.lit(p).alias("plan"), F.lit(m).alias("mode"),
                                F.lit(PLAN_MONTHS[p]).alias("months"), F.lit(PLAN_PRICES[(p, m)]).alias("price"))
                       for p in PLANS for m in ("buy", "renew")])
    today = F.lit(as_of)
    current = F.try_to_date(F.col("licenseExpiresAt"), "yyyy-MM-dd")
    base = F.when(F.col("mode") == "buy", today).otherwise(
        F.when(current >= today, current).otherwise(today))
    # The price list is a fixed four-entry literal, exploded next to each clinic.
    return (clinics.select("*", F.inline(prices))
            .withColumn("new_expires_at", col_add_months_overflow(base, F.col("months")))
            .select("clinic_id", "plan", "mode", "price", "new_expires_at"))


def eligible_messages(messages: DataFrame, settings: DataFrame, tenant: Sequence[str] = ("clinic_id",)) -> DataFrame:
    """Messages of clinics that may use the assistant: on the 10-month plan, with an API key. Others
    are refused before any quota is used."""
    s = settings_pivot(settings, ["licensePlan", "aiApiKey"], tenant)
    ok = s.where((F.col("licensePlan") == "10month") & (F.coalesce(F.col("aiApiKey"), F.lit("")) != "")).select(*tenant)
    return messages.join(ok, list(tenant), "left_semi")


def ai_quota_admission(messages: DataFrame, tz: str = "UTC", limit: int = AI_DAILY_LIMIT,
                       used: DataFrame | None = None, tenant: Sequence[str] = ("clinic_id",)) -> DataFrame:
    """The first ``limit`` messages per clinic per local day are admitted
    (ordered by sent_at, then message_id); refused ones use no quota.
    ``used`` (tenant, day, used) carries messages already counted that day.

    Plan: ``row_number() <= limit`` over (clinic, day) lets Spark keep at most
    ``limit`` rows per group in each map task before the shuffle, so a hot
    clinic-day never gathers all its messages in one task. The admitted ids
    are then matched back to the batch with one left join on (clinic, day,
    message), a key that spreads even a hot clinic-day over all partitions."""
    from pyspark.sql import Window
    m = messages.withColumn("day", F.to_date(F.from_utc_timestamp(F.col("sent_at"), tz)))
    w = Window.partitionBy(*tenant, "day").orderBy("sent_at", "message_id")
    top = m.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    if used is not None:
        top = (top.join(used, [*tenant, "day"], "left")
               .where(F.col("_rn") <= F.lit(limit) - F.coalesce(F.col("used"), F.lit(0)))
               .drop("used"))
    ids = top.select(*tenant, "day", "message_id", F.lit(True).alias("_adm"))
    return (m.join(ids, [*tenant, "day", "message_id"], "left")
            .withColumn("admitted", F.coalesce(F.col("_adm"), F.lit(False))).drop("_adm"))
