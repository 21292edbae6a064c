"""Registered queries, part two: ingest, changes, license, labels, exports,
composite reports and multi-clinic (tenant) runs. Same contract as
``catalog.py``: every query reads the bound driver tables in full."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import aggregates as agg
from ..operators import changes, ingest, refills, setops
from ..schemas import SECRET_SETTING_KEYS
from ..sources import sinks, stored
from ..sources.license import license_feed
from . import reports
from .catalog import REGISTRY, dbl, query, tables
from ..sources.driver import AS_OF_CLINIC, AS_OF_EVENTS, BINDINGS, NOW_CLINIC

_SECRETS_SQL = ", ".join(f"'{k}'" for k in SECRET_SETTING_KEYS)
PRESENT = "coalesce(regexp_matches({0}, '[^\\s]'), false)"


def _p(c: str) -> str:
    return PRESENT.format(c)


def _outcome(df, *cols):
    return df.select(*cols, (F.size("reasons") == 0).alias("accepted"),
                     F.try_element_at("reasons", F.lit(1)).alias("reason"))


_DATE = "CAST(TRY_STRPTIME(NULLIF({0}, ''), '%Y-%m-%d') AS DATE)"
_AUTHOR = ("CASE WHEN {0} IS NULL OR {0} = '' OR TRY_CAST({0} AS BIGINT) = 0 THEN NULL "
           "ELSE TRY_CAST({0} AS BIGINT) END")


def _d(c):
    return _DATE.format(c)


def _bad_date(c):
    return f"({_p(c)} AND {_d(c)} IS NULL)"


_NUM = r"(CASE WHEN regexp_full_match(trim({0}), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN trim({0}) END)"


def _n(c: str) -> str:
    return _NUM.format(c)


def _too_large(c: str, kind: str) -> str:
    return f"({_n(c)} IS NOT NULL AND TRY_CAST({_n(c)} AS {kind}) IS NULL)"


# ------------------------------------------------------------------ ingest
@query("ingest_patients", f"""
SELECT row_key, trim(first_name) AS first_name, trim(last_name) AS last_name, {_d('date_of_birth')} AS date_of_birth,
       NULLIF(gender, '') AS gender, NULLIF(phone, '') AS phone, {_AUTHOR.format('created_by_staff_id')} AS created_by_staff_id,
       reason IS NULL AS accepted, reason
FROM (SELECT *, CASE WHEN NOT {_p('first_name')} THEN 'firstName is required'
                     WHEN NOT {_p('last_name')} THEN 'lastName is required'
                     WHEN {_bad_date('date_of_birth')} THEN 'dateOfBirth is not a date' END AS reason
      FROM incoming_patients)""")
def q_ingest_patients(spark, sf):
    r = ingest.ingest_patients(tables(spark, sf)["incoming_patients"])
    return _outcome(r, "row_key", "first_name", "last_name", "date_of_birth", "gender", "phone", "created_by_staff_id")


@query("ingest_visits", f"""
SELECT row_key, pid AS patient_id, {_d('visit_date')} AS visit_date,
       TRY_CAST({_n('temperature_c')} AS DOUBLE) AS temperature_c, TRY_CAST({_n('pulse_bpm')} AS DOUBLE) AS pulse_bpm,
       TRY_CAST({_n('weight_kg')} AS DOUBLE) AS weight_kg,
       CAST(CASE WHEN charge_amount IS NULL OR charge_amount = '' THEN paid
                 ELSE coalesce(TRY_CAST({_n('charge_amount')} AS DECIMAL(18,2)), 0) END AS DOUBLE) AS charge_amount,
       CAST(paid AS DOUBLE) AS payment_amount, NULLIF(payment_method, '') AS payment_method,
       reason IS NULL AS accepted, reason
FROM (SELECT b.*, CASE WHEN b.pid IS NULL OR b.pid = 0 THEN 'patientId is required'
                       WHEN NOT {_p('b.visit_date')} THEN 'visitDate is required'
                       WHEN NOT b.known THEN 'No patient with id ' || b.patient_id
                       WHEN {_bad_date('b.visit_date')} THEN 'visitDate is not a date'
                       WHEN {_too_large('b.payment_amount', 'DECIMAL(18,2)')} THEN 'paymentAmount is too large'
                       WHEN {_too_large('b.charge_amount', 'DECIMAL(18,2)')} THEN 'chargeAmount is too large' END AS reason
      FROM (SELECT i.*, TRY_CAST(i.patient_id AS BIGINT) AS pid, p.id IS NOT NULL AS known,
                   coalesce(TRY_CAST({_n('i.payment_amount')} AS DECIMAL(18,2)), 0) AS paid
            FROM incoming_visits i LEFT JOIN patients p ON p.id = TRY_CAST(i.patient_id AS BIGINT)) b)""")
def q_ingest_visits(spark, sf):
    t = tables(spark, sf)
    r = ingest.ingest_visits(t["incoming_visits"], t["patients"])
    return _outcome(r, "row_key", "patient_id", "visit_date", "temperature_c", "pulse_bpm", "weight_kg",
                    dbl("charge_amount"), dbl("payment_amount"), "payment_method")


@query("ingest_drugs", f"""
SELECT row_key, trim(name) AS name, NULLIF(unit, '') AS unit,
       CAST(coalesce(TRY_CAST({_n('quantity_on_hand')} AS DECIMAL(18,3)), 0) AS DOUBLE) AS quantity_on_hand,
       CAST(coalesce(TRY_CAST({_n('reorder_level')} AS DECIMAL(18,3)), 0) AS DOUBLE) AS reorder_level,
       {_d('expiry_date')} AS expiry_date, reason IS NULL AS accepted, reason
FROM (SELECT *, CASE WHEN NOT {_p('name')} THEN 'name is required'
                     WHEN {_bad_date('expiry_date')} THEN 'expiryDate is not a date'
                     WHEN {_too_large('quantity_on_hand', 'DECIMAL(18,3)')} THEN 'quantityOnHand is too large'
                     WHEN {_too_large('reorder_level', 'DECIMAL(18,3)')} THEN 'reorderLevel is too large' END AS reason
      FROM incoming_drugs)""")
def q_ingest_drugs(spark, sf):
    r = ingest.ingest_drugs(tables(spark, sf)["incoming_drugs"])
    return _outcome(r, "row_key", "name", "unit", dbl("quantity_on_hand"), dbl("reorder_level"), "expiry_date")


@query("ingest_appointments", f"""
SELECT row_key, pid AS patient_id, {_d('appointment_date')} AS appointment_date,
       NULLIF(appointment_time, '') AS appointment_time, 'Scheduled' AS status, why IS NULL AS accepted, why AS reason
FROM (SELECT b.*, CASE WHEN b.pid IS NULL OR b.pid = 0 THEN 'patientId is required'
                       WHEN NOT {_p('b.appointment_date')} THEN 'appointmentDate is required'
                       WHEN NOT b.known THEN 'No patient with id ' || b.patient_id
                       WHEN {_bad_date('b.appointment_date')} THEN 'appointmentDate is not a date' END AS why
      FROM (SELECT i.*, TRY_CAST(i.patient_id AS BIGINT) AS pid, p.id IS NOT NULL AS known
            FROM incoming_appointments i LEFT JOIN patients p ON p.id = TRY_CAST(i.patient_id AS BIGINT)) b)""")
def q_ingest_appointments(spark, sf):
    t = tables(spark, sf)
    r = ingest.ingest_appointments(t["incoming_appointments"], t["patients"])
    return _outcome(r, "row_key", "patient_id", "appointment_date", "appointment_time", "status")


@query("ingest_staff", f"""
SELECT row_key, trim(name) AS name, trim(role) AS role, u AS username, reason IS NULL AS accepted, reason
FROM (SELECT b.*, CASE WHEN NOT {_p('b.name')} THEN 'name is required'
                       WHEN NOT {_p('b.role')} THEN 'role is required'
                       WHEN NOT {_p('b.username')} THEN 'username is required'
                       WHEN NOT {_p('b.password')} THEN 'password is required'
                       WHEN b.u IN (SELECT username FROM staff) OR b.row_key <> f.first_key
                         THEN 'Username "' || b.username || '" is already taken' END AS reason
      FROM (SELECT *, lower(trim(username)) AS u FROM incoming_staff) b
      LEFT JOIN (SELECT lower(trim(username)) AS u, min(row_key) AS first_key FROM incoming_staff
                 WHERE {_p('username')} GROUP BY 1) f ON f.u = b.u)""")
def q_ingest_staff(spark, sf):
    t = tables(spark, sf)
    r = ingest.ingest_staff(t["incoming_staff"], t["staff"])
    return _outcome(r, "row_key", "name", "role", "username")


@query("ingest_clients", f"""
SELECT row_key, trim(name) AS name, NULLIF(phone, '') AS phone, NULLIF(sponsor, '') AS sponsor, 'Active' AS status,
       reason IS NULL AS accepted, reason
FROM (SELECT *, CASE WHEN NOT {_p('name')} THEN 'name is required' END AS reason FROM incoming_clients)""")
def q_ingest_clients(spark, sf):
    r = ingest.ingest_clients(tables(spark, sf)["incoming_clients"])
    return _outcome(r, "row_key", "name", "phone", "sponsor", "status")


@query("ingest_history", f"""
SELECT row_key, cid AS client_id, {_d('entry_date')} AS entry_date, entry_type, NULLIF(quantity, '') AS quantity,
       TRY_CAST({_n('day_supply')} AS DOUBLE) AS day_supply,
       reason IS NULL AS accepted, reason
FROM (SELECT b.*, CASE WHEN NOT b.known THEN 'Client not found'
                       WHEN NOT {_p('b.entry_date')} THEN 'entryDate is required'
                       WHEN NOT coalesce(b.entry_type IN ('Order', 'Note', 'Contact'), false)
                         THEN 'entryType must be Order, Note, or Contact'
                       WHEN {_bad_date('b.entry_date')} THEN 'entryDate is not a date'
                       WHEN abs(TRY_CAST({_n('b.day_supply')} AS DOUBLE)) > 1000000 THEN 'daySupply is too large' END AS reason
      FROM (SELECT i.*, TRY_CAST(i.client_id AS BIGINT) AS cid, c.id IS NOT NULL AS known
            FROM incoming_history i LEFT JOIN subscription_clients c ON c.id = TRY_CAST(i.client_id AS BIGINT)) b)""")
def q_ingest_history(spark, sf):
    t = tables(spark, sf)
    r = ingest.ingest_history(t["incoming_history"], t["subscription_clients"])
    return _outcome(r, "row_key", "client_id", "entry_date", "entry_type", "quantity", "day_supply")


@query("enum_check", """
SELECT 'drug_movements' AS table_name, 'type' AS column_name, type AS value, count(*) AS n,
       coalesce(type IN ('restock', 'dispense'), false) AS valid FROM drug_movements GROUP BY type
UNION ALL
SELECT 'appointments', 'status', status, count(*),
       coalesce(status IN ('Scheduled', 'Completed', 'Cancelled', 'No-Show'), false) FROM appointments GROUP BY status
UNION ALL
SELECT 'subscription_clients', 'status', status, count(*), coalesce(status IN ('Active', 'Inactive'), false)
FROM subscription_clients GROUP BY status
UNION ALL
SELECT 'subscription_history', 'entry_type', entry_type, count(*),
       coalesce(entry_type IN ('Order', 'Note', 'Contact'), false) FROM subscription_history GROUP BY entry_type""")
def q_enum_check(spark, sf):
    return ingest.enum_check(tables(spark, sf))


def _fk_sql():
    parts = []
    for child, col, parent in ingest.FK_EDGES:
        parts.append(f"SELECT '{child}.{col}' AS edge, '{parent}' AS parent, count(*) AS \"references\", "
                     f"count(*) FILTER (WHERE p.id IS NULL) AS orphans FROM {child} c "
                     f"LEFT JOIN (SELECT DISTINCT id FROM {parent}) p ON p.id = c.{col} WHERE c.{col} IS NOT NULL")
    return "\nUNION ALL\n".join(parts)


@query("fk_audit", _fk_sql())
def q_fk_audit(spark, sf):
    return ingest.fk_audit(tables(spark, sf))


@query("schema_upgrade", """
SELECT id, CAST(CASE WHEN id % 4 IN (0, 1) THEN payment_amount WHEN id % 4 = 3 AND id % 8 = 3 THEN NULL ELSE charge_amount END AS DOUBLE) AS charge_amount,
       CAST(payment_amount AS DOUBLE) AS payment_amount, CASE WHEN id % 4 IN (1, 3) THEN temperature_c END AS temperature_c,
       CASE WHEN id % 4 = 3 THEN created_by_staff_id END AS created_by_staff_id
FROM visits""")
def q_schema_upgrade(spark, sf):
    """One folder with files of four layouts (the visits dealt by id; some charges of the current one are NULL), upgraded."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources.tables import upgrade_folder
    v = tables(spark, sf)["visits"]
    vitals, folder = ["temperature_c", "blood_pressure", "pulse_bpm", "weight_kg"], f"{checkpoint_dir(spark)}/layouts-{uuid.uuid4().hex}"
    current = v.withColumn("charge_amount", F.when(F.col("id") % 8 != 3, F.col("charge_amount")))
    for k, df in enumerate((v.drop("charge_amount", "created_by_staff_id", *vitals), v.drop("charge_amount", "created_by_staff_id"),
                            v.drop("created_by_staff_id", *vitals), current)):
        df.where(F.col("id") % 4 == k).write.mode("append").parquet(folder)
    u = upgrade_folder(spark, folder)
    return u.select("id", dbl("charge_amount"), dbl("payment_amount"), "temperature_c", "created_by_staff_id")


# ------------------------------------------------------------------ settings and changes
_UPSERTED = f"""
upserted AS (
  SELECT clinic_id, key, arg_max(value, seq) AS value FROM (
    SELECT clinic_id, key, CASE WHEN key IN ('aiAssistantName', 'aiApiKey', 'smsUsername', 'smsApiKey', 'smsSenderId')
                                THEN trim(value) ELSE value END AS value, seq FROM settings_log
    UNION ALL SELECT clinic_id, key, value, -1 FROM settings_stored)
  WHERE value IS NOT NULL AND NOT (key IN ({_SECRETS_SQL}) AND NOT {_p('value')})
  GROUP BY clinic_id, key),
cur AS (
  SELECT clinic_id, max(CASE WHEN key = 'licenseExpiresAt' THEN value END) AS exp,
         max(CASE WHEN key = 'licensePlan' THEN value END) AS cur_plan
  FROM upserted GROUP BY clinic_id),
feed AS (
  SELECT doc_id, clinic_key, json_extract_string(text, '$."' || clinic_key || '".expiresAt') AS expires_at,
         CASE WHEN json_type(text, '$."' || clinic_key || '".plan') = 'VARCHAR'
               AND json_extract_string(text, '$."' || clinic_key || '".plan') IN ('3month', '10month')
              THEN json_extract_string(text, '$."' || clinic_key || '".plan') END AS plan
  FROM license_docs
  WHERE json_valid(text) AND json_type(text) = 'OBJECT'
    AND json_type(text, '$."' || clinic_key || '".expiresAt') = 'VARCHAR')"""


def _settings(spark, sf):
    t = tables(spark, sf)
    return t, changes.settings_upsert(t["settings_stored"], t["settings_log"], tenant=["clinic_id"])


@query("settings_upsert", f"""
SELECT clinic_id, key, CASE WHEN key IN ({_SECRETS_SQL}) THEN '********' ELSE value END AS value FROM upserted""",
       extra=_UPSERTED)
def q_settings_upsert(spark, sf):
    _, s = _settings(spark, sf)
    return s.select("clinic_id", "key", F.when(F.col("key").isin(*SECRET_SETTING_KEYS), F.lit("********"))
                    .otherwise(F.col("value")).alias("value"))


@query("apply_appointment_status", """
SELECT a.id, coalesce(l.status, a.status) AS status FROM appointments a
LEFT JOIN (SELECT id, arg_max(status, seq) AS status FROM appointment_status_changes
           WHERE status IN ('Scheduled', 'Completed', 'Cancelled', 'No-Show')
             AND id IN (SELECT id FROM appointments) GROUP BY id) l ON l.id = a.id""")
def q_apply_appointment_status(spark, sf):
    t = tables(spark, sf)
    updated, _ = changes.apply_appointment_status(t["appointments"], t["appointment_status_changes"])
    return updated.select("id", "status")


@query("apply_appointment_status_rejects", """
SELECT c.id, c.status, c.seq,
       CASE WHEN NOT coalesce(c.status IN ('Scheduled', 'Completed', 'Cancelled', 'No-Show'), false)
            THEN 'status must be one of: Scheduled, Completed, Cancelled, No-Show'
            ELSE 'No appointment with id ' || CAST(c.id AS VARCHAR) END AS reason
FROM appointment_status_changes c
WHERE NOT coalesce(c.status IN ('Scheduled', 'Completed', 'Cancelled', 'No-Show'), false)
   OR c.id NOT IN (SELECT id FROM appointments)""")
def q_apply_appointment_status_rejects(spark, sf):
    t = tables(spark, sf)
    _, bad = changes.apply_appointment_status(t["appointments"], t["appointment_status_changes"])
    return bad.select("id", "status", "seq", "reason")


@query("apply_client_status", """
SELECT c.id, coalesce(l.status, c.status) AS status FROM subscription_clients c
LEFT JOIN (SELECT id, arg_max(status, seq) AS status FROM client_status_changes
           WHERE status IN ('Active', 'Inactive') GROUP BY id) l ON l.id = c.id""")
def q_apply_client_status(spark, sf):
    t = tables(spark, sf)
    updated, _ = changes.apply_client_status(t["subscription_clients"], t["client_status_changes"])
    return updated.select("id", "status")


@query("apply_staff_active", """
SELECT s.id, coalesce(l.active, s.active) AS active FROM staff s
LEFT JOIN (SELECT id, arg_max(CASE WHEN active THEN 1 ELSE 0 END, seq) AS active FROM staff_active_changes
           GROUP BY id) l ON l.id = s.id""")
def q_apply_staff_active(spark, sf):
    t = tables(spark, sf)
    return changes.apply_staff_active(t["staff"], t["staff_active_changes"]).select("id", "active")


@query("apply_reminders_sent", """
SELECT h.id, strftime(coalesce(m.sent_at, h.reminder_sent_at), '%Y-%m-%d %H:%M:%S') AS reminder_sent_at
FROM subscription_history h
LEFT JOIN (SELECT id, max(sent_at) AS sent_at FROM reminder_marks GROUP BY id) m ON m.id = h.id""")
def q_apply_reminders_sent(spark, sf):
    t = tables(spark, sf)
    h = changes.apply_reminders_sent(t["subscription_history"], t["reminder_marks"])
    return h.select("id", F.date_format("reminder_sent_at", "yyyy-MM-dd HH:mm:ss").alias("reminder_sent_at"))


# ------------------------------------------------------------------ changes stored in place
def _stored(spark, base, part, batch, change, *cols):
    """Store ``base`` in folders by ``part``, merge the batch into it, and read the stored table again."""
    import uuid

    from ..session import checkpoint_dir
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    base = base.withColumn("part", part)
    stored.store_table(base, path, "part")
    stored.merge_changes(spark, path, base.schema, batch, change, "part")
    return spark.read.schema(base.schema).parquet(path).select(*cols)


@query("store_appointment_status", sql=REGISTRY["apply_appointment_status"][1])
def q_store_appointment_status(spark, sf):
    t = tables(spark, sf)
    return _stored(spark, t["appointments"], F.date_format("appointment_date", "yyyy-MM"), t["appointment_status_changes"],
                   lambda rows, batch: changes.apply_appointment_status(rows, batch)[0], "id", "status")


@query("store_client_status", sql=REGISTRY["apply_client_status"][1])
def q_store_client_status(spark, sf):
    t = tables(spark, sf)
    return _stored(spark, t["subscription_clients"], F.expr("id div 10000"), t["client_status_changes"],
                   lambda rows, batch: changes.apply_client_status(rows, batch)[0], "id", "status")


@query("store_staff_active", sql=REGISTRY["apply_staff_active"][1])
def q_store_staff_active(spark, sf):
    t = tables(spark, sf)
    return _stored(spark, t["staff"], F.expr("id div 10000"), t["staff_active_changes"], changes.apply_staff_active, "id", "active")


@query("store_reminders_sent", sql=REGISTRY["apply_reminders_sent"][1])
def q_store_reminders_sent(spark, sf):
    t = tables(spark, sf)
    return _stored(spark, t["subscription_history"], F.date_format("entry_date", "yyyy-MM"), t["reminder_marks"], changes.apply_reminders_sent,
                   "id", F.date_format("reminder_sent_at", "yyyy-MM-dd HH:mm:ss").alias("reminder_sent_at"))


@query("license_feed", "SELECT doc_id, clinic_key, expires_at, plan FROM feed", extra=_UPSERTED)
def q_license_feed(spark, sf):
    return license_feed(tables(spark, sf)["license_docs"], keep=["doc_id"])


@query("license_feed_entries", """
SELECT doc_id, k AS clinic_key, json_extract_string(text, '$."' || k || '".expiresAt') AS expires_at,
       CASE WHEN json_type(text, '$."' || k || '".plan') = 'VARCHAR'
             AND json_extract_string(text, '$."' || k || '".plan') IN ('3month', '10month')
            THEN json_extract_string(text, '$."' || k || '".plan') END AS plan
FROM (SELECT doc_id, text, unnest(json_keys(text)) AS k FROM license_docs
      WHERE json_valid(text) AND json_type(text) = 'OBJECT')
WHERE json_type(text, '$."' || k || '".expiresAt') = 'VARCHAR'""")
def q_license_feed_entries(spark, sf):
    from ..sources.license import license_feed_entries
    return license_feed_entries(tables(spark, sf)["license_docs"], keep=["doc_id"])


def _current_license(s):
    return changes.settings_pivot(s, ["licenseExpiresAt", "licensePlan"])


@query("license_apply", """
SELECT CAST(f.clinic_key AS INTEGER) AS clinic_id, f.expires_at AS licenseExpiresAt,
       coalesce(f.plan, c.cur_plan) AS licensePlan, f.expires_at IS DISTINCT FROM c.exp AS expires_changed,
       f.plan IS NOT NULL AND f.plan IS DISTINCT FROM c.cur_plan AS plan_changed
FROM feed f LEFT JOIN cur c ON c.clinic_id = CAST(f.clinic_key AS INTEGER)
WHERE f.expires_at IS DISTINCT FROM c.exp OR (f.plan IS NOT NULL AND f.plan IS DISTINCT FROM c.cur_plan)""",
       extra=_UPSERTED)
def q_license_apply(spark, sf):
    t, s = _settings(spark, sf)
    feed = license_feed(t["license_docs"]).withColumn("clinic_id", F.col("clinic_key").cast("int")).drop("clinic_key")
    return changes.license_apply(_current_license(s), feed)


@query("license_renewal_dates", f"""
SELECT c.clinic_id, p.plan, p.mode, p.price,
       CAST(date_trunc('month', b.base) + to_months(p.months) AS DATE) + CAST(day(b.base) - 1 AS INTEGER) AS new_expires_at
FROM cur c CROSS JOIN (VALUES ('3month', 'buy', 3, 70), ('3month', 'renew', 3, 20), ('10month', 'buy', 10, 150),
                              ('10month', 'renew', 10, 40)) p(plan, mode, months, price)
CROSS JOIN LATERAL (SELECT CASE WHEN p.mode = 'buy' THEN DATE '{AS_OF_CLINIC}'
                                WHEN {_d('c.exp')} >= DATE '{AS_OF_CLINIC}' THEN {_d('c.exp')}
                                ELSE DATE '{AS_OF_CLINIC}' END AS base) b""", extra=_UPSERTED)
def q_license_renewal_dates(spark, sf):
    _, s = _settings(spark, sf)
    return changes.license_renewal_dates(_current_license(s), AS_OF_CLINIC)


@query("ai_quota_admission", """
SELECT clinic_id, message_id, CAST(sent_at + INTERVAL 1 HOUR AS DATE) AS day,
       row_number() OVER (PARTITION BY clinic_id, CAST(sent_at + INTERVAL 1 HOUR AS DATE)
                          ORDER BY sent_at, message_id) <= 100 AS admitted
FROM assistant_messages""")
def q_ai_quota_admission(spark, sf):
    m = tables(spark, sf)["assistant_messages"]
    return changes.ai_quota_admission(m, tz="+01:00", limit=100).select("clinic_id", "message_id", "day", "admitted")


# ------------------------------------------------------------------ labels
def _jsnum(c):
    return f"(CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END)"


def _jsdec(c):
    return (f"(CASE WHEN contains(CAST({c} AS VARCHAR), '.') THEN regexp_replace(regexp_replace("
            f"CAST({c} AS VARCHAR), '0+$', ''), '\\.$', '') ELSE CAST({c} AS VARCHAR) END)")


def _money(c):
    return f"('$' || CAST(CAST(coalesce({c}, 0) AS DECIMAL(18,2)) AS VARCHAR))"


_VITALS = (f"concat_ws(' · ', CASE WHEN temperature_c IS NOT NULL THEN 'T: ' || {_jsnum('temperature_c')} || '°C' END,"
           f" CASE WHEN coalesce(blood_pressure, '') <> '' THEN 'BP: ' || blood_pressure END,"
           f" CASE WHEN pulse_bpm IS NOT NULL THEN 'P: ' || {_jsnum('pulse_bpm')} || 'bpm' END,"
           f" CASE WHEN weight_kg IS NOT NULL THEN 'W: ' || {_jsnum('weight_kg')} || 'kg' END)")


@query("fmt_money", f"""
SELECT id, {_money('charge_amount')} AS charged_text, {_money('charge_amount - payment_amount')} AS balance_text
FROM visits""")
def q_fmt_money(spark, sf):
    v = tables(spark, sf)["visits"]
    return v.select("id", labels.fmt_money(F.col("charge_amount")).alias("charged_text"),
                    labels.fmt_money(F.col("charge_amount") - F.col("payment_amount")).alias("balance_text"))


@query("fmt_vitals", f"SELECT id, {_VITALS} AS vitals FROM visits")
def q_fmt_vitals(spark, sf):
    v = tables(spark, sf)["visits"]
    return v.select("id", labels.fmt_vitals(F.col("temperature_c"), F.col("blood_pressure"), F.col("pulse_bpm"),
                                            F.col("weight_kg")).alias("vitals"))


@query("visit_receipts", f"""
SELECT visit_id, CAST(row_number() OVER (PARTITION BY visit_id ORDER BY slot) AS INTEGER) AS line_no, label, value
FROM (
  SELECT v.id AS visit_id, x.slot, x.label, x.value
  FROM (SELECT v.*, p.first_name, p.last_name, s.name AS recorded_by_name, {_VITALS} AS vit
        FROM visits v JOIN patients p ON p.id = v.patient_id LEFT JOIN staff s ON s.id = v.created_by_staff_id) v,
  LATERAL (VALUES
    (1, 'Patient', concat_ws(' ', v.first_name, v.last_name), true),
    (2, 'Visit Date', coalesce(CAST(v.visit_date AS VARCHAR), ''), true),
    (3, 'Complaint', v.complaint, coalesce(v.complaint, '') <> ''),
    (4, 'Treatment', v.treatment, coalesce(v.treatment, '') <> ''),
    (5, 'Vitals', v.vit, v.vit <> ''),
    (6, 'Amount Charged', {_money('v.charge_amount')}, true),
    (7, 'Amount Paid', {_money('v.payment_amount')} || CASE WHEN coalesce(v.payment_method, '') <> ''
                                                          THEN ' (' || v.payment_method || ')' ELSE '' END, true),
    (8, 'Balance Owed', {_money('v.charge_amount - v.payment_amount')}, v.charge_amount - v.payment_amount > 0),
    (9, 'Served By', v.recorded_by_name, coalesce(v.recorded_by_name, '') <> '')) x(slot, label, value, keep)
  WHERE x.keep) r""")
def q_visit_receipts(spark, sf):
    from ..operators.joins import visits_enriched
    t = tables(spark, sf)
    return labels.visit_receipts(visits_enriched(t["visits"], t["patients"], t["staff"]))


@query("patient_card", """
SELECT id, concat_ws(' ', first_name, last_name) AS display_name,
       concat_ws(' · ', CASE WHEN date_of_birth IS NOT NULL THEN 'DOB: ' || CAST(date_of_birth AS VARCHAR) END,
                 NULLIF(gender, ''), NULLIF(phone, ''), NULLIF(address, '')) AS meta
FROM patients""")
def q_patient_card(spark, sf):
    return labels.patient_card(tables(spark, sf)["patients"]).select("id", "display_name", "meta")


@query("client_card", """
SELECT id, concat_ws(' · ', NULLIF(phone, ''), CASE WHEN coalesce(sponsor, '') <> '' THEN 'Sponsor: ' || sponsor END,
                     status) AS meta,
       CASE WHEN status = 'Active' THEN 'Mark Inactive' ELSE 'Mark Active' END AS toggle_label
FROM subscription_clients""")
def q_client_card(spark, sf):
    return labels.client_card(tables(spark, sf)["subscription_clients"]).select("id", "meta", "toggle_label")


@query("drug_card", f"""
SELECT id, concat_ws(' · ', {_jsdec('quantity_on_hand')} || ' ' || coalesce(NULLIF(unit, ''), 'unit(s)') || ' on hand',
                     'reorder at ' || {_jsdec('reorder_level')},
                     CASE WHEN expiry_date IS NOT NULL THEN 'expires ' || CAST(expiry_date AS VARCHAR) END) AS meta
FROM drugs""")
def q_drug_card(spark, sf):
    return labels.drug_card(tables(spark, sf)["drugs"]).select("id", "meta")


@query("history_labels", """
SELECT id, CASE WHEN coalesce(medication, '') <> ''
                THEN medication || CASE WHEN coalesce(quantity, '') <> '' THEN ' (' || quantity || ')' ELSE '' END
                ELSE '' END AS medication_label,
       CASE WHEN coalesce(day_supply, 0) <> 0 THEN (CASE WHEN day_supply = floor(day_supply) THEN CAST(CAST(day_supply AS BIGINT) AS VARCHAR) ELSE CAST(day_supply AS VARCHAR) END) || ' days' ELSE '' END AS supply_label
FROM subscription_history""")
def q_history_labels(spark, sf):
    return labels.history_labels(tables(spark, sf)["subscription_history"]).select(
        "id", "medication_label", "supply_label")


@query("license_banner", f"""
SELECT c.clinic_id,
       CASE WHEN d.days IS NULL THEN NULL WHEN d.days < 0 THEN 'banner-expired'
            WHEN d.days <= 7 THEN 'banner-warning' END AS css_class,
       CASE WHEN d.days IS NULL THEN NULL
            WHEN d.days < 0 THEN 'Your subscription expired on ' || c.exp || ' (' || CAST(abs(d.days) AS VARCHAR)
                 || ' day' || CASE WHEN abs(d.days) = 1 THEN '' ELSE 's' END
                 || ' ago) — please contact your provider to renew.'
            WHEN d.days <= 7 THEN 'Your subscription expires in ' || CAST(d.days AS VARCHAR) || ' day'
                 || CASE WHEN d.days = 1 THEN '' ELSE 's' END || ' (' || c.exp
                 || ') — please contact your provider to renew.' END AS text,
       d.days
FROM cur c, LATERAL (SELECT CAST({_d('c.exp')} - DATE '{AS_OF_CLINIC}' AS INTEGER) AS days) d""", extra=_UPSERTED)
def q_license_banner(spark, sf):
    _, s = _settings(spark, sf)
    cur = _current_license(s)
    b = labels.license_banner(F.col("licenseExpiresAt"), AS_OF_CLINIC)
    return cur.select("clinic_id", b.css_class.alias("css_class"), b.text.alias("text"), b.days.alias("days"))


@query("needs_attention", f"""
SELECT 1 AS section, id AS drug_id, name, 'Low Stock' AS reason,
       {_jsdec('quantity_on_hand')} || ' ' || coalesce(NULLIF(unit, ''), 'unit(s)') || ' left (reorder at '
       || {_jsdec('reorder_level')} || ')' AS detail
FROM drugs WHERE quantity_on_hand <= reorder_level
UNION ALL
SELECT 2, id, name, 'Expiring Soon', 'Expires ' || CAST(expiry_date AS VARCHAR)
FROM drugs WHERE expiry_date IS NOT NULL AND expiry_date <= DATE '{AS_OF_CLINIC}' + 30""")
def q_needs_attention(spark, sf):
    return setops.needs_attention(tables(spark, sf)["drugs"], AS_OF_CLINIC)


# ------------------------------------------------------------------ exports
@query("export_csv_patients", """
SELECT first_name AS "First Name", last_name AS "Last Name", CAST(date_of_birth AS VARCHAR) AS "Date of Birth",
       gender AS "Gender", phone AS "Phone", address AS "Address",
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS "Registered At"
FROM patients""")
def q_export_csv_patients(spark, sf):
    return sinks.export_csv_patients(tables(spark, sf)["patients"])


_VISIT_EXPORT = f"""
SELECT CAST(v.visit_date AS VARCHAR) AS "Visit Date", concat_ws(' ', p.first_name, p.last_name) AS "Patient",
       v.complaint AS "Complaint", v.treatment AS "Treatment", {_jsnum('v.temperature_c')} AS "Temperature (C)",
       v.blood_pressure AS "Blood Pressure", {_jsnum('v.pulse_bpm')} AS "Pulse (bpm)",
       {_jsnum('v.weight_kg')} AS "Weight (kg)", {_jsdec('v.charge_amount')} AS "Charged",
       {_jsdec('v.payment_amount')} AS "Paid", {_jsdec('v.charge_amount - v.payment_amount')} AS "Balance",
       v.payment_method AS "Payment Method", v.notes AS "Notes", s.name AS "Recorded By"
FROM visits v JOIN patients p ON p.id = v.patient_id LEFT JOIN staff s ON s.id = v.created_by_staff_id"""


@query("export_csv_visits", _VISIT_EXPORT)
def q_export_csv_visits(spark, sf):
    t = tables(spark, sf)
    return sinks.export_csv_visits(t["visits"], t["patients"], t["staff"])


@query("export_csv_drugs", f"""
SELECT name AS "Name", unit AS "Unit", {_jsdec('quantity_on_hand')} AS "Quantity On Hand",
       {_jsdec('reorder_level')} AS "Reorder Level", CAST(expiry_date AS VARCHAR) AS "Expiry Date", notes AS "Notes"
FROM drugs""")
def q_export_csv_drugs(spark, sf):
    return sinks.export_csv_drugs(tables(spark, sf)["drugs"])


def _csv_cell(c):
    return (f"(CASE WHEN {c} IS NULL THEN '' WHEN regexp_matches({c}, '[\",\\r\\n]') "
            f"THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END)")


_HEADER = ("Visit Date,Patient,Complaint,Treatment,Temperature (C),Blood Pressure,Pulse (bpm),"
           "Weight (kg),Charged,Paid,Balance,Payment Method,Notes,Recorded By")


@query("csv_sink", f"SELECT '{_HEADER}' AS value, CAST(strlen('{_HEADER}') AS BIGINT) AS file_bytes\nUNION ALL\n"
       "SELECT value, CAST(strlen(value) + 2 AS BIGINT) FROM (SELECT concat_ws(',', " + ", ".join(_csv_cell(f'e."{h}"') for _, h in sinks.VISIT_COLUMNS) + ") AS value\n"
       "FROM (" + _VISIT_EXPORT + ") e)")
def q_csv_sink(spark, sf):
    """The visits export written as CSV part files, and every record read back from their bytes."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources.part_files import read_csv_records
    t = tables(spark, sf)
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(sinks.export_csv_visits(t["visits"], t["patients"], t["staff"]), path)
    return read_csv_records(spark, path)


_ENTRY_JSON = """CAST(to_json(struct_pack(id := h.id, entryDate := CAST(h.entry_date AS VARCHAR), entryType := h.entry_type, medication := h.medication,
    daySupply := h.day_supply, reminderSentAt := strftime(h.reminder_sent_at, '%Y-%m-%dT%H:%M:%S.%gZ'))) AS VARCHAR)"""
_PLACED = """
placed AS (
  SELECT h.client_id, h.id AS entry_id, """ + _ENTRY_JSON + """ AS json,
         row_number() OVER (PARTITION BY h.client_id ORDER BY h.entry_date DESC, h.id DESC) AS place, count(*) OVER (PARTITION BY h.client_id) AS held
  FROM subscription_history h)"""
_CLIENT_JSON = "CAST(to_json(struct_pack(id := c.id, name := c.name, phone := c.phone, status := c.status)) AS VARCHAR)"


def _pieces(head: str, end: str) -> str:
    return f"""CASE WHEN coalesce(p.place, 1) = 1 THEN {head} || ',"history":[' ELSE ',' END || coalesce(p.json, '')
       || CASE WHEN coalesce(p.place = p.held, true) THEN '{end}' || chr(10) ELSE '' END AS text"""


@query("export_clients_nested", f"""
SELECT c.id, p.entry_id, {_pieces(f"left({_CLIENT_JSON}, length({_CLIENT_JSON}) - 1)", "]}")}
FROM subscription_clients c LEFT JOIN placed p ON p.client_id = c.id""", extra=_PLACED)
def q_export_clients_nested(spark, sf):
    t = tables(spark, sf)
    return sinks.export_clients_nested(t["subscription_clients"], t["subscription_history"]).select("id", "entry_id", "text")


@query("sync_envelope", f"""
SELECT c.clinic_id, c.id, p.entry_id, {_pieces(
    "'{\"clinicId\":' || c.clinic_id || ',\"smsSettings\":' || CAST(to_json(struct_pack(username := o.sms_username, senderId := o.sms_sender_id)) AS VARCHAR)"
    f" || ',\"client\":' || left({_CLIENT_JSON}, length({_CLIENT_JSON}) - 1)", "]}}")}
FROM subscription_clients c
JOIN (SELECT clinic_id, max(CASE WHEN key = 'smsUsername' THEN value END) AS sms_username,
             max(CASE WHEN key = 'smsSenderId' THEN value END) AS sms_sender_id,
             max(CASE WHEN key = 'refillRemindersEnabled' THEN value END) AS enabled,
             max(CASE WHEN key = 'smsApiKey' THEN value END) AS api_key
      FROM upserted GROUP BY clinic_id) o ON o.clinic_id = c.clinic_id
LEFT JOIN placed p ON p.client_id = c.id
WHERE o.enabled = '1' AND coalesce(o.sms_username, '') <> '' AND coalesce(o.api_key, '') <> ''""",
       extra=_UPSERTED + "," + _PLACED)
def q_sync_envelope(spark, sf):
    t, s = _settings(spark, sf)
    return sinks.sync_envelope(s, t["subscription_clients"], t["subscription_history"]).select("clinic_id", "id", "entry_id", "text")


# ------------------------------------------------------------------ composite reports
@query("dashboard_summary", f"""
SELECT s.patients_today, s.patients_week, i.income_today, a.appointments_today, t.top_illness_count,
       l.low_stock_count, e.expiring_soon_count, l.low_stock_count + e.expiring_soon_count AS needs_attention_count
FROM (SELECT count(DISTINCT patient_id) FILTER (WHERE visit_date = DATE '{AS_OF_CLINIC}') AS patients_today,
             count(DISTINCT patient_id) FILTER (WHERE visit_date >= DATE '2001-07-30') AS patients_week FROM visits) s,
     (SELECT CAST(coalesce(sum(payment_amount) FILTER (WHERE visit_date = DATE '{AS_OF_CLINIC}'), 0) AS DOUBLE)
             AS income_today FROM visits) i,
     (SELECT count(*) AS appointments_today FROM appointments
      WHERE status = 'Scheduled' AND appointment_date = DATE '{AS_OF_EVENTS}') a,
     (SELECT count(*) AS top_illness_count FROM (SELECT complaint FROM visits
      WHERE visit_date >= DATE '2001-07-30' AND complaint IS NOT NULL AND trim(complaint) <> ''
      GROUP BY complaint ORDER BY count(*) DESC, complaint LIMIT 5)) t,
     (SELECT count(*) AS low_stock_count FROM drugs WHERE quantity_on_hand <= reorder_level) l,
     (SELECT count(*) AS expiring_soon_count FROM drugs
      WHERE expiry_date IS NOT NULL AND expiry_date <= DATE '{AS_OF_CLINIC}' + 30) e""")
def q_dashboard_summary(spark, sf):
    d = reports.dashboard_summary(tables(spark, sf), AS_OF_CLINIC, AS_OF_EVENTS)
    return d.withColumn("income_today", F.col("income_today").cast("double"))


@query("assistant_context", f"""
SELECT '{{"patientsSeenToday":' || CAST(s.patients_today AS VARCHAR) || ',"patientsSeenThisWeek":'
       || CAST(s.patients_week AS VARCHAR) || ',"incomeToday":' || {_jsdec('i.income_today')}
       || ',"appointmentsToday":' || CAST(a.n AS VARCHAR) || ',"lowStockDrugCount":' || CAST(l.n AS VARCHAR)
       || ',"expiringSoonDrugCount":' || CAST(e.n AS VARCHAR) || ',"outstandingBalanceCount":' || CAST(o.n AS VARCHAR)
       || ',"outstandingBalanceTotal":' || {_jsdec('o.total')} || '}}' AS context_json
FROM (SELECT count(DISTINCT patient_id) FILTER (WHERE visit_date = DATE '{AS_OF_CLINIC}') AS patients_today,
             count(DISTINCT patient_id) FILTER (WHERE visit_date >= DATE '2001-07-30') AS patients_week FROM visits) s,
     (SELECT coalesce(sum(payment_amount) FILTER (WHERE visit_date = DATE '{AS_OF_CLINIC}'), 0)
             AS income_today FROM visits) i,
     (SELECT count(*) AS n FROM appointments WHERE status = 'Scheduled' AND appointment_date = DATE '{AS_OF_EVENTS}') a,
     (SELECT count(*) AS n FROM drugs WHERE quantity_on_hand <= reorder_level) l,
     (SELECT count(*) AS n FROM drugs WHERE expiry_date IS NOT NULL AND expiry_date <= DATE '{AS_OF_CLINIC}' + 30) e,
     (SELECT count(*) AS n, coalesce(sum(v.charge_amount - v.payment_amount), 0) AS total
      FROM visits v JOIN patients p ON p.id = v.patient_id WHERE v.charge_amount > v.payment_amount) o""")
def q_assistant_context(spark, sf):
    return reports.assistant_context(tables(spark, sf), AS_OF_CLINIC, AS_OF_EVENTS)


@query("sync_status", f"""
SELECT clinic_id,
       coalesce(max(CASE WHEN key = 'refillRemindersEnabled' THEN value END), '') = '1' AS reminders_enabled,
       coalesce(max(CASE WHEN key = 'smsUsername' THEN value END), '') AS sms_username,
       coalesce(max(CASE WHEN key = 'smsApiKey' THEN value END), '') <> '' AS has_sms_api_key,
       coalesce(max(CASE WHEN key = 'smsSenderId' THEN value END), '') AS sms_sender_id,
       max(CASE WHEN key = 'lastCloudSyncAt' THEN value END) AS last_sync_at,
       max(CASE WHEN key = 'lastCloudSyncError' THEN value END) AS last_sync_error,
       max(CASE WHEN key = 'lastBackupAt' THEN value END) AS last_backup_at,
       max(CASE WHEN key = 'lastBackupError' THEN value END) AS last_backup_error,
       max(CASE WHEN key = 'lastManualBackupAt' THEN value END) AS last_manual_backup_at,
       max(CASE WHEN key = 'aiAssistantName' THEN value END) AS assistant_name,
       coalesce(max(CASE WHEN key = 'aiApiKey' THEN value END), '') <> '' AS has_ai_api_key,
       coalesce(max(CASE WHEN key = 'licensePlan' THEN value END), '') = '10month' AS assistant_eligible,
       coalesce(max(CASE WHEN key = 'cloudSyncToken' THEN value END), '') <> '' AS has_sync_token
FROM upserted GROUP BY clinic_id""", extra=_UPSERTED)
def q_sync_status(spark, sf):
    _, s = _settings(spark, sf)
    return reports.sync_status(s)


_CLINIC_FACTS = """
cv AS (SELECT v.*, p.clinic_id FROM visits v JOIN patients p ON p.id = v.patient_id),
ca AS (SELECT a.*, p.clinic_id FROM appointments a JOIN patients p ON p.id = a.patient_id)"""

_CLINIC_VISITS = """
cv AS (SELECT v.*, p.clinic_id FROM visits v JOIN patients p ON p.id = v.patient_id),
ten AS (SELECT clinic_id FROM upserted WHERE key = 'licensePlan' AND value = '10month'),
spine AS (SELECT t.clinic_id, CAST(i AS INTEGER) AS month_index, strftime(DATE '2001-02-01' + to_months(i), '%Y-%m') AS month
          FROM ten t CROSS JOIN range(6) r(i))"""


def _bundle(spark, sf):
    t, s = _settings(spark, sf)
    tb = {"visits": reports.stamp_tenant(t["visits"], t["patients"], "patient_id"), "patients": t["patients"]}
    return reports.trends_bundle(tb, s, AS_OF_CLINIC, NOW_CLINIC, "+01:00")


@query("trends_bundle", """
SELECT s.clinic_id, s.month_index, s.month, coalesce(a.visit_count, 0) AS visit_count,
       CAST(coalesce(a.income, 0) AS DOUBLE) AS income, coalesce(n.n, 0) AS new_patients
FROM spine s
LEFT JOIN (SELECT clinic_id, strftime(visit_date, '%Y-%m') AS month, count(*) AS visit_count,
                  sum(payment_amount) AS income
           FROM cv WHERE visit_date >= DATE '2001-02-01' GROUP BY 1, 2) a
  ON a.clinic_id = s.clinic_id AND a.month = s.month
LEFT JOIN (SELECT clinic_id, strftime(created_at + INTERVAL 1 HOUR, '%Y-%m') AS month, count(*) AS n
           FROM patients WHERE created_at >= TIMESTAMP '2001-01-31 12:00:00' GROUP BY 1, 2) n
  ON n.clinic_id = s.clinic_id AND n.month = s.month""", extra=_UPSERTED + "," + _CLINIC_VISITS)
def q_trends_bundle(spark, sf):
    b = _bundle(spark, sf)
    return (b["visits"].join(b["new_patients"].select("clinic_id", "month", F.col("n").alias("new_patients")),
                             ["clinic_id", "month"], "left")
            .select("clinic_id", "month_index", "month", "visit_count", dbl("income"), "new_patients"))


@query("trends_bundle_top", """
SELECT clinic_id, complaint, n FROM (
  SELECT clinic_id, complaint, count(*) AS n,
         row_number() OVER (PARTITION BY clinic_id ORDER BY count(*) DESC, complaint) AS rn
  FROM cv WHERE clinic_id IN (SELECT clinic_id FROM ten) AND visit_date >= DATE '2001-02-01'
    AND complaint IS NOT NULL AND trim(complaint) <> ''
  GROUP BY clinic_id, complaint) WHERE rn <= 8""", extra=_UPSERTED + "," + _CLINIC_VISITS)
def q_trends_bundle_top(spark, sf):
    return _bundle(spark, sf)["top_illnesses"].select("clinic_id", "complaint", "n")


# ------------------------------------------------------------------ many clinics at once (tenant key)
@query("income_summary_by_clinic", f"""
SELECT clinic_id, CAST(sum(today) AS DOUBLE) AS today, CAST(sum(this_week) AS DOUBLE) AS this_week, CAST(sum(this_month) AS DOUBLE) AS this_month
FROM (SELECT p.clinic_id, coalesce(sum(v.payment_amount) FILTER (WHERE v.visit_date = DATE '{AS_OF_CLINIC}'), 0) AS today,
             coalesce(sum(v.payment_amount) FILTER (WHERE v.visit_date >= DATE '2001-07-30'), 0) AS this_week,
             coalesce(sum(v.payment_amount) FILTER (WHERE v.visit_date >= DATE '2001-07-01'), 0) AS this_month
      FROM visits v LEFT JOIN patients p ON p.id = v.patient_id WHERE v.visit_date >= DATE '2001-07-01' GROUP BY p.clinic_id
      UNION ALL SELECT clinic_id, 0, 0, 0 FROM clinics) GROUP BY clinic_id""")
def q_income_summary_by_clinic(spark, sf):
    t = tables(spark, sf)
    v = reports.stamp_tenant(t["visits"], t["patients"], "patient_id")
    s = agg.income_summary(v, AS_OF_CLINIC, tenant=["clinic_id"], clinics=t["clinics"])
    return s.select("clinic_id", dbl("today"), dbl("this_week"), dbl("this_month"))


@query("dashboard_summary_by_clinic", f"""
SELECT k.clinic_id, coalesce(s.patients_today, 0) AS patients_today, coalesce(s.patients_week, 0) AS patients_week,
       CAST(coalesce(s.income_today, 0) AS DOUBLE) AS income_today, coalesce(a.n, 0) AS appointments_today,
       coalesce(t.n, 0) AS top_illness_count, coalesce(d.low, 0) AS low_stock_count,
       coalesce(d.soon, 0) AS expiring_soon_count, coalesce(d.low, 0) + coalesce(d.soon, 0) AS needs_attention_count
FROM (SELECT clinic_id FROM cv WHERE visit_date >= DATE '2001-07-30'
      UNION SELECT clinic_id FROM ca WHERE status = 'Scheduled' AND appointment_date = DATE '{AS_OF_EVENTS}'
      UNION SELECT clinic_id FROM drugs UNION SELECT clinic_id FROM clinics) k
LEFT JOIN (SELECT clinic_id, count(DISTINCT patient_id) FILTER (WHERE visit_date = DATE '{AS_OF_CLINIC}') AS patients_today,
                  count(DISTINCT patient_id) AS patients_week,
                  sum(payment_amount) FILTER (WHERE visit_date = DATE '{AS_OF_CLINIC}') AS income_today
           FROM cv WHERE visit_date >= DATE '2001-07-30' GROUP BY clinic_id) s ON s.clinic_id = k.clinic_id
LEFT JOIN (SELECT clinic_id, count(*) AS n FROM ca
           WHERE status = 'Scheduled' AND appointment_date = DATE '{AS_OF_EVENTS}' GROUP BY clinic_id) a
  ON a.clinic_id = k.clinic_id
LEFT JOIN (SELECT clinic_id, count(*) AS n FROM (
             SELECT clinic_id, complaint, row_number() OVER (PARTITION BY clinic_id ORDER BY count(*) DESC, complaint) AS rn
             FROM cv WHERE visit_date >= DATE '2001-07-30' AND complaint IS NOT NULL AND trim(complaint) <> ''
             GROUP BY clinic_id, complaint) WHERE rn <= 5 GROUP BY clinic_id) t ON t.clinic_id = k.clinic_id
LEFT JOIN (SELECT clinic_id, count(*) FILTER (WHERE quantity_on_hand <= reorder_level) AS low,
                  count(*) FILTER (WHERE expiry_date IS NOT NULL AND expiry_date <= DATE '{AS_OF_CLINIC}' + 30) AS soon
           FROM drugs GROUP BY clinic_id) d ON d.clinic_id = k.clinic_id""", extra=_CLINIC_FACTS)
def q_dashboard_summary_by_clinic(spark, sf):
    t = tables(spark, sf)
    tb = {"visits": reports.stamp_tenant(t["visits"], t["patients"], "patient_id"),
          "appointments": reports.stamp_tenant(t["appointments"], t["patients"], "patient_id"),
          "drugs": t["drugs"]}
    d = reports.dashboard_summary(tb, AS_OF_CLINIC, AS_OF_EVENTS, tenant=["clinic_id"], clinics=t["clinics"])
    return d.withColumn("income_today", F.col("income_today").cast("double"))


@query("refills_due_by_clinic", f"""
SELECT c.clinic_id, l.id, l.client_id, l.medication,
       CAST((l.entry_date + CAST(trunc(l.day_supply) AS INTEGER)) - DATE '{AS_OF_EVENTS}' AS INTEGER) AS days_until_due
FROM (SELECT * FROM (
        SELECT h.*, row_number() OVER (PARTITION BY h.client_id, h.medication
                                       ORDER BY h.entry_date DESC, h.id DESC) AS rn
        FROM subscription_history h WHERE h.entry_type = 'Order' AND h.day_supply IS NOT NULL) WHERE rn = 1) l
JOIN subscription_clients c ON c.id = l.client_id
WHERE c.status = 'Active' AND l.reminder_sent_at IS NULL AND (l.entry_date + CAST(trunc(l.day_supply) AS INTEGER)) - DATE '{AS_OF_EVENTS}' <= 7""")
def q_refills_due_by_clinic(spark, sf):
    t = tables(spark, sf)
    h = reports.stamp_tenant(t["subscription_history"], t["subscription_clients"], "client_id")
    r = refills.refills_due(h, t["subscription_clients"], AS_OF_EVENTS, tenant=["clinic_id"])
    return r.select("clinic_id", "id", "client_id", "medication", "days_until_due")


@query("top_illnesses_week_by_clinic", """
SELECT clinic_id, complaint, n FROM (
  SELECT p.clinic_id, v.complaint, count(*) AS n,
         row_number() OVER (PARTITION BY p.clinic_id ORDER BY count(*) DESC, v.complaint) AS rn
  FROM visits v JOIN patients p ON p.id = v.patient_id
  WHERE v.visit_date >= DATE '2001-07-30' AND v.complaint IS NOT NULL AND trim(v.complaint) <> ''
  GROUP BY p.clinic_id, v.complaint) WHERE rn <= 5""")
def q_top_illnesses_week_by_clinic(spark, sf):
    t = tables(spark, sf)
    v = reports.stamp_tenant(t["visits"], t["patients"], "patient_id")
    return agg.top_illnesses_week(v, AS_OF_CLINIC, tenant=["clinic_id"])


# ------------------------------------------------------------------ every clinic has its row
@query("clinic_counts_by_clinic", f"""
SELECT clinic_id, sum(pt)::BIGINT AS patients_today, sum(pw)::BIGINT AS patients_week, sum(a)::BIGINT AS appointments_today,
       sum(s)::BIGINT AS active_staff, sum(oc)::BIGINT AS outstanding_count, CAST(sum(ot) AS DOUBLE) AS outstanding_total
FROM (SELECT clinic_id, 0 AS pt, 0 AS pw, 0 AS a, 0 AS s, 0 AS oc, CAST(0 AS DECIMAL(28,2)) AS ot FROM clinics
      UNION ALL SELECT p.clinic_id, count(DISTINCT v.patient_id) FILTER (WHERE v.visit_date = DATE '{AS_OF_CLINIC}'),
                       count(DISTINCT v.patient_id), 0, 0, 0, 0
                FROM visits v JOIN patients p ON p.id = v.patient_id WHERE v.visit_date >= DATE '2001-07-30' GROUP BY 1
      UNION ALL SELECT p.clinic_id, 0, 0, count(*), 0, 0, 0 FROM appointments x JOIN patients p ON p.id = x.patient_id
                WHERE x.status = 'Scheduled' AND x.appointment_date = DATE '{AS_OF_EVENTS}' GROUP BY 1
      UNION ALL SELECT clinic_id, 0, 0, 0, count(*), 0, 0 FROM staff WHERE active = 1 GROUP BY 1
      UNION ALL SELECT p.clinic_id, 0, 0, 0, 0, count(*), sum(v.charge_amount - v.payment_amount)
                FROM visits v JOIN patients p ON p.id = v.patient_id WHERE v.charge_amount > v.payment_amount GROUP BY 1)
GROUP BY clinic_id""")
def q_clinic_counts_by_clinic(spark, sf):
    t, k = tables(spark, sf), ["clinic_id"]
    v = reports.stamp_tenant(t["visits"], t["patients"], "patient_id")
    a = reports.stamp_tenant(t["appointments"], t["patients"], "patient_id")
    parts = [agg.patients_seen(v.where("clinic_id is not null"), AS_OF_CLINIC, k, t["clinics"]),
             agg.appointments_today(a.where("clinic_id is not null"), AS_OF_EVENTS, k, t["clinics"]),
             agg.active_staff_count(t["staff"], k, t["clinics"]), agg.outstanding_total(v, t["patients"], k, t["clinics"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, k)
    return out.withColumn("outstanding_total", F.col("outstanding_total").cast("double"))


@query("assistant_eligible_messages", """
SELECT m.clinic_id, m.message_id FROM assistant_messages m
WHERE m.clinic_id IN (SELECT clinic_id FROM upserted WHERE key = 'licensePlan' AND value = '10month')
  AND m.clinic_id IN (SELECT clinic_id FROM upserted WHERE key = 'aiApiKey' AND value <> '')""", extra=_UPSERTED)
def q_assistant_eligible_messages(spark, sf):
    t, s = _settings(spark, sf)
    return changes.eligible_messages(t["assistant_messages"], s).select("clinic_id", "message_id")


# ------------------------------------------------------------------ snapshots
SNAPSHOT_TABLES = {"settings": "settings_stored", "staff": "staff", "patients": "patients", "visits": "visits", "drugs": "drugs",
                   "drug_movements": "drug_movements", "appointments": "appointments", "subscription_clients": "subscription_clients",
                   "subscription_history": "subscription_history"}


def _column_sums_sql(table: str, bound: str) -> str:
    columns = [re.search(r"AS (\w+)$", e)[1] for e in BINDINGS[bound][0][1]]
    texts = {c: f"CAST({c} AS VARCHAR)" for c in columns}
    texts["*"] = "concat_ws('|', " + ", ".join(f"coalesce({t}, '-')" for t in texts.values()) + ")"
    return "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS records, count({t}) AS filled, "
        f"CAST(coalesce(sum(CAST('0x' || substr(md5({t}), 1, 8) AS BIGINT)), 0) AS BIGINT) AS checksum, true AS same FROM {bound}" for c, t in texts.items())


@query("snapshot_write", "\nUNION ALL\n".join(_column_sums_sql(t, b) for t, b in SNAPSHOT_TABLES.items()))
def q_snapshot_write(spark, sf):
    """All nine tables written to the shared folder, then every column of the copy against what was read."""
    import datetime as dt
    import uuid

    from ..session import checkpoint_dir
    t = tables(spark, sf)
    root = f"{checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    name = sinks.snapshot_write({k: t[b] for k, b in SNAPSHOT_TABLES.items()}, root, dt.datetime(2024, 1, 28, 12, 0, 0))
    return sinks.snapshot_check(spark, root, name)


@query("snapshot_retention", """
SELECT name FROM (SELECT DISTINCT 'snapshot-' || strftime(sent_at, '%Y-%m-%d_%H-%M-%S') AS name FROM assistant_messages)
WHERE name NOT IN (SELECT name FROM (SELECT DISTINCT 'snapshot-' || strftime(sent_at, '%Y-%m-%d_%H-%M-%S') AS name
                                     FROM assistant_messages) ORDER BY name DESC LIMIT 10)""")
def q_snapshot_retention(spark, sf):
    """The names to drop of a manifest with a snapshot for every assistant message."""
    m = tables(spark, sf)["assistant_messages"]
    return sinks.snapshots_to_drop(m.select(F.concat(F.lit("snapshot-"), F.date_format("sent_at", "yyyy-MM-dd_HH-mm-ss")).alias("name")))
