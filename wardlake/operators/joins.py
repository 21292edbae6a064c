"""Equi-joins on integer ids (inner and left outer), newest-first listings.

Join strategy is left to Catalyst and AQE: the staff side is small per clinic
but grows with the number of clinics, so it is not hinted; AQE turns the join
into a broadcast at run time when the measured side is under
``spark.sql.adaptive.autoBroadcastJoinThreshold``, and splits skewed
partitions of the fact side otherwise.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _staff_names(staff: DataFrame, tenant: Sequence[str], key: str = "created_by_staff_id") -> DataFrame:
    return staff.select(*tenant, F.col("id").alias(key), F.col("name").alias("recorded_by_name"))


def with_author_name(df: DataFrame, staff: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Left join the author's name; an unknown or missing author gives NULL."""
    return df.join(_staff_names(staff, tenant), [*tenant, "created_by_staff_id"], "left")


def visit_history(visits: DataFrame, staff: DataFrame, patient_keys: DataFrame | None = None,
                  tenant: Sequence[str] = ()) -> DataFrame:
    """Visits (of the given patients, or all) with ``recorded_by_name``,
    newest first per patient (visit_date, id descending)."""
    v = visits if patient_keys is None else visits.join(
        patient_keys.select(*tenant, F.col("id").alias("patient_id")).distinct(), [*tenant, "patient_id"], "left_semi")
    return (with_author_name(v, staff, tenant)
            .orderBy(*tenant, "patient_id", F.desc("visit_date"), F.desc("id")))


def visits_enriched(visits: DataFrame, patients: DataFrame, staff: DataFrame,
                    tenant: Sequence[str] = ()) -> DataFrame:
    """visits JOIN patients (names) LEFT JOIN staff (author); no order of its own."""
    p = patients.select(*tenant, F.col("id").alias("patient_id"), "first_name", "last_name")
    return with_author_name(visits.join(p, [*tenant, "patient_id"], "inner"), staff, tenant)


def outstanding_balances(visits: DataFrame, patients: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Visits charged more than paid, with the balance and the patient's name,
    newest first. The filter runs before the join."""
    v = (visits.where(F.col("charge_amount") > F.col("payment_amount"))
         .select(*tenant, F.col("id").alias("visit_id"), "visit_date", "charge_amount", "payment_amount",
                 (F.col("charge_amount") - F.col("payment_amount")).alias("balance"), "patient_id"))
    p = patients.select(*tenant, F.col("id").alias("patient_id"), "first_name", "last_name")
    return v.join(p, [*tenant, "patient_id"], "inner").orderBy(*tenant, F.desc("visit_date"), F.desc("visit_id"))


def movement_history(movements: DataFrame, staff: DataFrame, drug_keys: DataFrame | None = None,
                     tenant: Sequence[str] = ()) -> DataFrame:
    """Movements with author name and signed quantity (dispense negative),
    newest first (created_at, id)."""
    m = movements if drug_keys is None else movements.join(
        drug_keys.select(*tenant, F.col("id").alias("drug_id")).distinct(), [*tenant, "drug_id"], "left_semi")
    signed = F.when(F.col("type") == "dispense", -F.col("quantity")).otherwise(F.col("quantity"))
    return (with_author_name(m, staff, tenant).withColumn("signed_quantity", signed)
            .orderBy(*tenant, "drug_id", F.desc("created_at"), F.desc("id")))


def patient_appointments(appointments: DataFrame, patient_keys: DataFrame | None = None,
                         tenant: Sequence[str] = ()) -> DataFrame:
    a = appointments if patient_keys is None else appointments.join(
        patient_keys.select(*tenant, F.col("id").alias("patient_id")).distinct(), [*tenant, "patient_id"], "left_semi")
    return a.orderBy(*tenant, "patient_id", F.desc("appointment_date"), F.desc("appointment_time"), F.desc("id"))


def upcoming_appointments(appointments: DataFrame, patients: DataFrame, as_of: dt.date,
                          tenant: Sequence[str] = ()) -> DataFrame:
    """Scheduled appointments on or after as_of with patient name and phone,
    by date then time."""
    a = appointments.where((F.col("status") == "Scheduled") & (F.col("appointment_date") >= F.lit(as_of)))
    p = patients.select(*tenant, F.col("id").alias("patient_id"), "first_name", "last_name", "phone")
    return a.join(p, [*tenant, "patient_id"], "inner").orderBy(*tenant, "appointment_date", "appointment_time", "id")


def client_history(history: DataFrame, staff: DataFrame, client_keys: DataFrame | None = None,
                   tenant: Sequence[str] = ()) -> DataFrame:
    h = history if client_keys is None else history.join(
        client_keys.select(*tenant, F.col("id").alias("client_id")).distinct(), [*tenant, "client_id"], "left_semi")
    return with_author_name(h, staff, tenant).orderBy(*tenant, "client_id", F.desc("entry_date"), F.desc("id"))


def refillable_orders(history: DataFrame, clients: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Order entries with a day supply, joined to their client (name, phone, status)."""
    h = history.where((F.col("entry_type") == "Order") & F.col("day_supply").isNotNull())
    c = clients.select(*tenant, F.col("id").alias("client_id"), F.col("name").alias("client_name"),
                       F.col("phone").alias("client_phone"), F.col("status").alias("client_status"))
    return h.join(c, [*tenant, "client_id"], "inner")


def attribution_coverage(tables: dict[str, DataFrame], staff: DataFrame, tenant: Sequence[str] = ()) -> DataFrame:
    """Per table: records, records with an author stamp, and records whose
    author is a known staff member. Records are first counted per author
    (partial aggregation), so the join sees one row per author, however many
    records a busy author has."""
    known = staff.select(*tenant, F.col("id").alias("created_by_staff_id"), F.lit(True).alias("_known"))
    parts = []
    for name, df in tables.items():
        per_author = df.groupBy(*tenant, "created_by_staff_id").agg(F.count(F.lit(1)).alias("_n"))
        j = per_author.join(known, [*tenant, "created_by_staff_id"], "left")
        parts.append(j.groupBy(*tenant).agg(
            F.sum("_n").alias("records"),
            F.coalesce(F.sum(F.when(F.col("created_by_staff_id").isNotNull(), F.col("_n"))), F.lit(0)).alias("with_author"),
            F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0)).alias("with_known_author"),
        ).withColumn("table_name", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
