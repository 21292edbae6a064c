"""Composite reports: dashboard, trends bundle, assistant context, sync status.

Each composite is built from the single-purpose operators. One-row reports
are one aggregation over a tagged union of their inputs, never a join of
one-row results.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import js_decimal_text
from ..operators import aggregates as agg
from ..operators.changes import settings_pivot
from ..operators.search import expiring_soon, low_stock
from ..operators.setops import needs_attention
from ..functions.semantics import week_start
from ..schemas import EXPIRY_HORIZON_DAYS, SECRET_SETTING_KEYS


def _dashboard_parts(tables: dict[str, DataFrame], as_of: dt.date, appointments_as_of: dt.date | None,
                     tenant: Sequence[str], horizon_days: int, with_outstanding: bool) -> DataFrame:
    """The dashboard's inputs as one tagged row set (``_part``): one row per
    patient seen this week (p), Scheduled appointment today (a), drug (d), top
    complaint (t) and, optionally, open balance (o). One aggregation over it
    gives every number, so no one-row results are joined together."""
    v, d = tables["visits"], tables["drugs"]
    ws = week_start(as_of)
    today = F.col("visit_date") == F.lit(as_of)
    money, none_i, none_b = "decimal(28,2)", F.lit(None).cast("long"), F.lit(None).cast("boolean")

    def part(df, tag, i=None, m=None, low=None, exp=None):
        return df.select(*tenant, F.lit(tag).alias("_part"), (i if i is not None else none_i).cast("long").alias("_i"),
                         (m if m is not None else F.lit(None)).cast(money).alias("_m"),
                         (low if low is not None else none_b).alias("_low"),
                         (exp if exp is not None else none_b).alias("_exp"))

    per_patient = (v.where(F.col("visit_date") >= F.lit(ws)).groupBy(*tenant, "patient_id")
                   .agg(F.max(today.cast("int")).alias("_seen_today"),
                        F.sum(F.when(today, F.col("payment_amount"))).alias("_paid_today")))
    appts = tables["appointments"].where((F.col("status") == "Scheduled")
                                         & (F.col("appointment_date") == F.lit(appointments_as_of or as_of)))
    limit = as_of + dt.timedelta(days=horizon_days)
    parts = [
        part(per_patient, "p", i=F.col("_seen_today"), m=F.col("_paid_today")),
        part(appts, "a"),
        part(d, "d", low=F.col("quantity_on_hand") <= F.col("reorder_level"),
             exp=F.col("expiry_date").isNotNull() & (F.col("expiry_date") <= F.lit(limit))),
        part(agg.top_illnesses_week(v, as_of, tenant=tenant), "t"),
    ]
    if with_outstanding:
        o = v.where(F.col("charge_amount") > F.col("payment_amount")).join(
            tables["patients"].select(*tenant, F.col("id").alias("patient_id")), [*tenant, "patient_id"], "left_semi")
        parts.append(part(o, "o", m=F.col("charge_amount") - F.col("payment_amount")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _count(tag: str, cond=None):
    c = F.col("_part") == tag
    return F.count_if(c if cond is None else (c & F.coalesce(cond, F.lit(False))))


def _sum(tag: str, col: str, dtype: str):
    return F.coalesce(F.sum(F.when(F.col("_part") == tag, F.col(col))), F.lit(0).cast(dtype))


def dashboard_summary(tables: dict[str, DataFrame], as_of: dt.date, appointments_as_of: dt.date | None = None,
                      tenant: Sequence[str] = (), horizon_days: int = EXPIRY_HORIZON_DAYS,
                      clinics: DataFrame | None = None) -> DataFrame:
    """One row (per clinic): patients today / this week, income today,
    Scheduled appointments today, and the sizes of the top-complaints, low-stock,
    expiring and needs-attention lists (the lists come from
    :func:`dashboard_lists`). One aggregation over the tagged inputs
    (:func:`_dashboard_parts`); distinct patients are reduced to one row per
    (clinic, patient) first. Without a tenant the result is always one row; with ``clinics``
    every clinic has its row."""
    parts = _dashboard_parts(tables, as_of, appointments_as_of, tenant, horizon_days, with_outstanding=False)
    return agg.fill_clinics(parts.groupBy(*tenant).agg(*_dashboard_columns()), clinics, tenant)


def _dashboard_columns():
    low, soon = _count("d", F.col("_low")), _count("d", F.col("_exp"))
    return [_sum("p", "_i", "bigint").alias("patients_today"), _count("p").alias("patients_week"),
            _sum("p", "_m", "decimal(28,2)").alias("income_today"), _count("a").alias("appointments_today"),
            _count("t").alias("top_illness_count"), low.alias("low_stock_count"),
            soon.alias("expiring_soon_count"), (low + soon).alias("needs_attention_count")]


def dashboard_lists(tables: dict[str, DataFrame], as_of: dt.date, tenant: Sequence[str] = ()) -> dict[str, DataFrame]:
    v, d = tables["visits"], tables["drugs"]
    return {
        "top_illnesses_week": agg.top_illnesses_week(v, as_of, tenant=tenant),
        "low_stock": low_stock(d, tenant),
        "expiring_soon": expiring_soon(d, as_of, tenant=tenant),
        "needs_attention": needs_attention(d, as_of, tenant=tenant),
    }


def stamp_tenant(facts: DataFrame, owners: DataFrame, fk: str, tenant: str = "clinic_id") -> DataFrame:
    """Give facts the tenant key of the record they belong to (e.g. visits get
    the clinic of their patient); a fact of an unknown owner keeps a NULL tenant. Data that already carries the key needs none."""
    return facts.join(owners.select(F.col("id").alias(fk), tenant), fk, "left")


def plan_clinics(settings: DataFrame, plan: str = "10month", tenant: Sequence[str] = ("clinic_id",)) -> DataFrame:
    s = settings_pivot(settings, ["licensePlan"], tenant)
    return s.where(F.col("licensePlan") == plan).select(*tenant)


def trends_bundle(tables: dict[str, DataFrame], settings: DataFrame, as_of: dt.date, now: dt.datetime, tz: str,
                  tenant: Sequence[str] = ("clinic_id",)) -> dict[str, DataFrame]:
    """Six-month visit trend, new patients per month and top complaints, only
    for clinics on the 10-month plan (a semi join on the settings)."""
    clinics = plan_clinics(settings, tenant=tenant)
    visits = tables["visits"].join(clinics, list(tenant), "left_semi")
    patients = tables["patients"].join(clinics, list(tenant), "left_semi")
    return {
        "visits": agg.monthly_visit_trends(visits, as_of, tenant=tenant, clinics=clinics),
        "new_patients": agg.new_patients_by_month(patients, now, tz, tenant=tenant, clinics=clinics),
        "top_illnesses": agg.top_illnesses_6m(visits, as_of, tenant=tenant),
    }


def assistant_context(tables: dict[str, DataFrame], as_of: dt.date, appointments_as_of: dt.date | None = None,
                      tenant: Sequence[str] = (), horizon_days: int = EXPIRY_HORIZON_DAYS,
                      clinics: DataFrame | None = None) -> DataFrame:
    """The eight-number snapshot given to the assistant, as a JSON document:
    the dashboard numbers plus open balances, from one aggregation."""
    parts = _dashboard_parts(tables, as_of, appointments_as_of, tenant, horizon_days, with_outstanding=True)
    j = parts.groupBy(*tenant).agg(*_dashboard_columns(), _count("o").alias("outstanding_count"),
                                   _sum("o", "_m", "decimal(28,2)").alias("outstanding_total"))
    j = agg.fill_clinics(j, clinics, tenant)
    fields = (("patientsSeenToday", "patients_today"), ("patientsSeenThisWeek", "patients_week"),
              ("incomeToday", "income_today"), ("appointmentsToday", "appointments_today"),
              ("lowStockDrugCount", "low_stock_count"), ("expiringSoonDrugCount", "expiring_soon_count"),
              ("outstandingBalanceCount", "outstanding_count"), ("outstandingBalanceTotal", "outstanding_total"))
    return j.select(*tenant, json_numbers(j, fields).alias("context_json"))


def json_numbers(df: DataFrame, fields: Sequence[tuple[str, str]]) -> Column:
    """A flat JSON object of numbers printed as JSON.stringify prints them
    (exact decimals without trailing zeros, never exponent form)."""
    types = dict(df.dtypes)
    parts = []
    for i, (key, col) in enumerate(fields):
        c = F.col(col)
        text = js_decimal_text(c) if types[col].startswith("decimal") else c.cast("string")
        parts += [F.lit(("{" if i == 0 else ",") + f'"{key}":'), F.coalesce(text, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


STATUS_KEYS = ("refillRemindersEnabled", "smsUsername", "smsApiKey", "smsSenderId", "lastCloudSyncAt",
               "lastCloudSyncError", "lastBackupAt", "lastBackupError", "lastManualBackupAt", "aiAssistantName",
               "aiApiKey", "cloudSyncToken", "licensePlan")


def sync_status(settings: DataFrame, tenant: Sequence[str] = ("clinic_id",)) -> DataFrame:
    """Per clinic: reminder and sync flags, backup status, assistant flags.
    Secrets are reduced to has-value booleans and never emitted."""
    s = settings_pivot(settings, STATUS_KEYS, tenant)
    has = {k: F.coalesce(F.col(k), F.lit("")) != "" for k in SECRET_SETTING_KEYS}
    return s.select(
        *tenant,
        (F.coalesce(F.col("refillRemindersEnabled"), F.lit("")) == "1").alias("reminders_enabled"),
        F.coalesce(F.col("smsUsername"), F.lit("")).alias("sms_username"),
        has["smsApiKey"].alias("has_sms_api_key"),
        F.coalesce(F.col("smsSenderId"), F.lit("")).alias("sms_sender_id"),
        F.col("lastCloudSyncAt").alias("last_sync_at"), F.col("lastCloudSyncError").alias("last_sync_error"),
        F.col("lastBackupAt").alias("last_backup_at"), F.col("lastBackupError").alias("last_backup_error"),
        F.col("lastManualBackupAt").alias("last_manual_backup_at"),
        F.col("aiAssistantName").alias("assistant_name"), has["aiApiKey"].alias("has_ai_api_key"),
        has["cloudSyncToken"].alias("has_sync_token"),
        (F.coalesce(F.col("licensePlan"), F.lit("")) == "10month").alias("assistant_eligible"))
