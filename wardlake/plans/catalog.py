"""Registered queries over the driver data, each beside its SQL oracle.

Every query reads the bound clinic tables of ``sf_dir`` in full (see
``sources/driver.py``) and returns a DataFrame; the oracle is the same
question in ANSI SQL for DuckDB over the raw driver tables (the bindings are
inlined as CTEs). Money leaves as DOUBLE, dates as DATE, and every output
column is aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import joins, ledger, refills, search
from ..schemas import LIST_CAP
from ..sources import stored
from ..sources.driver import AS_OF_CLINIC, AS_OF_EVENTS, NOW_CLINIC, binding_ctes, load_driver_tables

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

LEDGER_ORDER = ("requested_at", "src_order", "src_line", "quantity", "src_price", "src_flag")
NEW_PATIENT_TZ = "+01:00"


def query(name: str, body: str | None = None, recursive: bool = False, extra: str = "", sql: str | None = None):
    """Register ``fn`` under ``name`` with oracle ``body`` (a SELECT over the
    bound tables, wrapped with the binding CTEs) or a complete ``sql``."""
    oracle = sql
    if body is not None:
        head = binding_ctes()
        if recursive:
            head = head.replace("WITH ", "WITH RECURSIVE ", 1)
        oracle = head + (",\n" + extra if extra else "") + "\n" + body

    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return load_driver_tables(spark, sf_dir)


def dbl(c: str, alias: str | None = None):
    return F.col(c).cast("double").alias(alias or c)


# ------------------------------------------------------------------ scans
@query("scan_table", """
SELECT id, patient_id, visit_date, complaint, treatment, temperature_c, blood_pressure, pulse_bpm, weight_kg,
       CAST(charge_amount AS DOUBLE) AS charge_amount, CAST(payment_amount AS DOUBLE) AS payment_amount,
       payment_method, notes, created_by_staff_id FROM visits""")
def q_scan_table(spark, sf):
    from ..sources.tables import conform
    v = conform(tables(spark, sf)["visits"], "visits")
    return v.select("id", "patient_id", "visit_date", "complaint", "treatment", "temperature_c", "blood_pressure",
                    "pulse_bpm", "weight_kg", dbl("charge_amount"), dbl("payment_amount"), "payment_method",
                    "notes", "created_by_staff_id")


@query("lookup_by_keys", f"""
SELECT id, first_name, last_name, phone FROM patients
WHERE id IN (SELECT patient_id FROM visits WHERE visit_date = DATE '{AS_OF_CLINIC}')""")
def q_lookup_by_keys(spark, sf):
    t = tables(spark, sf)
    keys = t["visits"].where(F.col("visit_date") == F.lit(AS_OF_CLINIC)).select(F.col("patient_id").alias("id"))
    return stored.lookup_stored(t["patients"], keys).select("id", "first_name", "last_name", "phone")


@query("full_listing", """
SELECT id, first_name, last_name, gender, phone, address FROM patients""")
def q_full_listing(spark, sf):
    p = tables(spark, sf)["patients"]
    return search.full_listing(p, ["last_name", "first_name"]).select(
        "id", "first_name", "last_name", "gender", "phone", "address")


@query("lookup_staff_by_username", """
SELECT id, name, username FROM staff
WHERE username IN (SELECT lower(trim(username)) FROM incoming_staff)""")
def q_lookup_staff_by_username(spark, sf):
    t = tables(spark, sf)
    return search.lookup_staff_by_username(t["staff"], t["incoming_staff"]).select("id", "name", "username")


@query("full_listing_drugs", """
SELECT id, name, unit, CAST(quantity_on_hand AS DOUBLE) AS quantity_on_hand, expiry_date FROM drugs""")
def q_full_listing_drugs(spark, sf):
    d = tables(spark, sf)["drugs"]
    return search.full_listing(d, ["name"]).select("id", "name", "unit", dbl("quantity_on_hand"), "expiry_date")


@query("full_listing_clients", """
SELECT id, name, phone, status FROM subscription_clients""")
def q_full_listing_clients(spark, sf):
    c = tables(spark, sf)["subscription_clients"]
    return search.full_listing(c, ["name"]).select("id", "name", "phone", "status")


# ------------------------------------------------------------------ search and filters
@query("search_patients", """
SELECT id, first_name, last_name, phone FROM patients
WHERE lower(first_name) LIKE '%00012%' OR lower(last_name) LIKE '%00012%' OR lower(phone) LIKE '%00012%'
ORDER BY last_name, first_name, id LIMIT 200""")
def q_search_patients(spark, sf):
    p = tables(spark, sf)["patients"]
    return search.search_patients(p, " 00012 ", cap=LIST_CAP).select("id", "first_name", "last_name", "phone")


@query("search_drugs", """
SELECT id, name FROM drugs WHERE lower(name) LIKE '%red%' ORDER BY name, id LIMIT 200""")
def q_search_drugs(spark, sf):
    return search.search_drugs(tables(spark, sf)["drugs"], "Red", cap=LIST_CAP).select("id", "name")


@query("search_clients", """
SELECT id, name, phone FROM subscription_clients
WHERE lower(name) LIKE '%#0000001%' OR lower(phone) LIKE '%#0000001%' ORDER BY name, id LIMIT 200""")
def q_search_clients(spark, sf):
    return search.search_clients(tables(spark, sf)["subscription_clients"], "#0000001", cap=LIST_CAP).select("id", "name", "phone")


@query("staff_directory", """
SELECT id, name, role, username, active FROM staff""")
def q_staff_directory(spark, sf):
    return search.staff_directory(tables(spark, sf)["staff"])


@query("low_stock", """
SELECT id, name, CAST(quantity_on_hand AS DOUBLE) AS quantity_on_hand, CAST(reorder_level AS DOUBLE) AS reorder_level
FROM drugs WHERE quantity_on_hand <= reorder_level""")
def q_low_stock(spark, sf):
    return search.low_stock(tables(spark, sf)["drugs"]).select("id", "name", dbl("quantity_on_hand"),
                                                               dbl("reorder_level"))


@query("expiring_soon", f"""
SELECT id, name, expiry_date FROM drugs
WHERE expiry_date IS NOT NULL AND expiry_date <= DATE '{AS_OF_CLINIC}' + 30""")
def q_expiring_soon(spark, sf):
    return search.expiring_soon(tables(spark, sf)["drugs"], AS_OF_CLINIC).select("id", "name", "expiry_date")


@query("drug_flags", f"""
SELECT id, quantity_on_hand <= reorder_level AS is_low,
       coalesce(expiry_date <= DATE '{AS_OF_CLINIC}' + 30, false) AS is_expiring FROM drugs""")
def q_drug_flags(spark, sf):
    return search.drug_flags(tables(spark, sf)["drugs"], AS_OF_CLINIC).select("id", "is_low", "is_expiring")


# ------------------------------------------------------------------ joins
@query("visit_history", """
SELECT v.id, v.patient_id, v.visit_date, s.name AS recorded_by_name
FROM visits v LEFT JOIN staff s ON s.id = v.created_by_staff_id""")
def q_visit_history(spark, sf):
    t = tables(spark, sf)
    return joins.visit_history(t["visits"], t["staff"]).select("id", "patient_id", "visit_date", "recorded_by_name")


@query("visits_enriched", """
SELECT v.id, v.visit_date, p.first_name, p.last_name, s.name AS recorded_by_name
FROM visits v JOIN patients p ON p.id = v.patient_id LEFT JOIN staff s ON s.id = v.created_by_staff_id""")
def q_visits_enriched(spark, sf):
    t = tables(spark, sf)
    return joins.visits_enriched(t["visits"], t["patients"], t["staff"]).select(
        "id", "visit_date", "first_name", "last_name", "recorded_by_name")


@query("outstanding_balances", """
SELECT v.id AS visit_id, v.visit_date, CAST(v.charge_amount AS DOUBLE) AS charge_amount,
       CAST(v.payment_amount AS DOUBLE) AS payment_amount, CAST(v.charge_amount - v.payment_amount AS DOUBLE) AS balance,
       p.id AS patient_id, p.first_name, p.last_name
FROM visits v JOIN patients p ON p.id = v.patient_id WHERE v.charge_amount > v.payment_amount""")
def q_outstanding_balances(spark, sf):
    t = tables(spark, sf)
    return joins.outstanding_balances(t["visits"], t["patients"]).select(
        "visit_id", "visit_date", dbl("charge_amount"), dbl("payment_amount"), dbl("balance"), "patient_id",
        "first_name", "last_name")


@query("movement_history", """
SELECT m.id, m.drug_id, m.type, CAST(CASE WHEN m.type = 'dispense' THEN -m.quantity ELSE m.quantity END AS DOUBLE)
       AS signed_quantity, s.name AS recorded_by_name
FROM drug_movements m LEFT JOIN staff s ON s.id = m.created_by_staff_id""")
def q_movement_history(spark, sf):
    t = tables(spark, sf)
    return joins.movement_history(t["drug_movements"], t["staff"]).select(
        "id", "drug_id", "type", dbl("signed_quantity"), "recorded_by_name")


@query("patient_appointments", """
SELECT id, patient_id, appointment_date, appointment_time, status FROM appointments""")
def q_patient_appointments(spark, sf):
    a = tables(spark, sf)["appointments"]
    return joins.patient_appointments(a).select("id", "patient_id", "appointment_date", "appointment_time", "status")


@query("upcoming_appointments", f"""
SELECT a.id, a.appointment_date, a.appointment_time, p.first_name, p.last_name, p.phone
FROM appointments a JOIN patients p ON p.id = a.patient_id
WHERE a.status = 'Scheduled' AND a.appointment_date >= DATE '{AS_OF_EVENTS}'""")
def q_upcoming_appointments(spark, sf):
    t = tables(spark, sf)
    return joins.upcoming_appointments(t["appointments"], t["patients"], AS_OF_EVENTS).select(
        "id", "appointment_date", "appointment_time", "first_name", "last_name", "phone")


@query("client_history", """
SELECT h.id, h.client_id, h.entry_date, h.entry_type, s.name AS recorded_by_name
FROM subscription_history h LEFT JOIN staff s ON s.id = h.created_by_staff_id""")
def q_client_history(spark, sf):
    t = tables(spark, sf)
    return joins.client_history(t["subscription_history"], t["staff"]).select(
        "id", "client_id", "entry_date", "entry_type", "recorded_by_name")


@query("refillable_orders", """
SELECT h.id, h.client_id, h.medication, h.day_supply, c.name AS client_name, c.phone AS client_phone,
       c.status AS client_status
FROM subscription_history h JOIN subscription_clients c ON c.id = h.client_id
WHERE h.entry_type = 'Order' AND h.day_supply IS NOT NULL""")
def q_refillable_orders(spark, sf):
    t = tables(spark, sf)
    return joins.refillable_orders(t["subscription_history"], t["subscription_clients"]).select(
        "id", "client_id", "medication", "day_supply", "client_name", "client_phone", "client_status")


@query("attribution_coverage", """
SELECT 'patients' AS table_name, count(*) AS records, count(p.created_by_staff_id) AS with_author,
       count(s.id) AS with_known_author
FROM patients p LEFT JOIN staff s ON s.id = p.created_by_staff_id
UNION ALL
SELECT 'visits', count(*), count(v.created_by_staff_id), count(s.id)
FROM visits v LEFT JOIN staff s ON s.id = v.created_by_staff_id
UNION ALL
SELECT 'drugs', count(*), count(d.created_by_staff_id), count(s.id)
FROM drugs d LEFT JOIN staff s ON s.id = d.created_by_staff_id
UNION ALL
SELECT 'drug_movements', count(*), count(m.created_by_staff_id), count(s.id)
FROM drug_movements m LEFT JOIN staff s ON s.id = m.created_by_staff_id
UNION ALL
SELECT 'appointments', count(*), count(a.created_by_staff_id), count(s.id)
FROM appointments a LEFT JOIN staff s ON s.id = a.created_by_staff_id
UNION ALL
SELECT 'subscription_clients', count(*), count(c.created_by_staff_id), count(s.id)
FROM subscription_clients c LEFT JOIN staff s ON s.id = c.created_by_staff_id
UNION ALL
SELECT 'subscription_history', count(*), count(h.created_by_staff_id), count(s.id)
FROM subscription_history h LEFT JOIN staff s ON s.id = h.created_by_staff_id""")
def q_attribution_coverage(spark, sf):
    t = tables(spark, sf)
    parts = {k: t[k] for k in ("patients", "visits", "drugs", "drug_movements", "appointments",
                               "subscription_clients", "subscription_history")}
    return joins.attribution_coverage(parts, t["staff"]).select("table_name", "records", "with_author",
                                                                 "with_known_author")


# ------------------------------------------------------------------ aggregates
@query("income_summary", f"""
SELECT CAST(coalesce(sum(payment_amount) FILTER (WHERE visit_date = DATE '{AS_OF_CLINIC}'), 0) AS DOUBLE) AS today,
       CAST(coalesce(sum(payment_amount) FILTER (WHERE visit_date >= DATE '2001-07-30'), 0) AS DOUBLE) AS this_week,
       CAST(coalesce(sum(payment_amount) FILTER (WHERE visit_date >= DATE '2001-07-01'), 0) AS DOUBLE) AS this_month
FROM visits""")
def q_income_summary(spark, sf):
    s = agg.income_summary(tables(spark, sf)["visits"], AS_OF_CLINIC)
    return s.select(dbl("today"), dbl("this_week"), dbl("this_month"))


@query("patients_seen", f"""
SELECT count(DISTINCT patient_id) FILTER (WHERE visit_date = DATE '{AS_OF_CLINIC}') AS patients_today,
       count(DISTINCT patient_id) FILTER (WHERE visit_date >= DATE '2001-07-30') AS patients_week
FROM visits""")
def q_patients_seen(spark, sf):
    return agg.patients_seen(tables(spark, sf)["visits"], AS_OF_CLINIC)


@query("appointments_today", f"""
SELECT count(*) AS appointments_today FROM appointments
WHERE status = 'Scheduled' AND appointment_date = DATE '{AS_OF_EVENTS}'""")
def q_appointments_today(spark, sf):
    return agg.appointments_today(tables(spark, sf)["appointments"], AS_OF_EVENTS)


@query("active_staff_count", "SELECT count(*) AS active_staff FROM staff WHERE active = 1")
def q_active_staff_count(spark, sf):
    return agg.active_staff_count(tables(spark, sf)["staff"])


@query("top_illnesses_week", """
SELECT complaint, count(*) AS n FROM visits
WHERE visit_date >= DATE '2001-07-30' AND complaint IS NOT NULL AND trim(complaint) <> ''
GROUP BY complaint ORDER BY n DESC, complaint LIMIT 5""")
def q_top_illnesses_week(spark, sf):
    return agg.top_illnesses_week(tables(spark, sf)["visits"], AS_OF_CLINIC)


@query("top_illnesses_6m", """
SELECT complaint, count(*) AS n FROM visits
WHERE visit_date >= DATE '2001-02-01' AND complaint IS NOT NULL AND trim(complaint) <> ''
GROUP BY complaint ORDER BY n DESC, complaint LIMIT 8""")
def q_top_illnesses_6m(spark, sf):
    return agg.top_illnesses_6m(tables(spark, sf)["visits"], AS_OF_CLINIC)


@query("monthly_visit_trends", """
SELECT s.month_index, s.month, coalesce(a.visit_count, 0) AS visit_count, CAST(coalesce(a.income, 0) AS DOUBLE) AS income
FROM (SELECT CAST(i AS INTEGER) AS month_index, strftime(DATE '2001-02-01' + to_months(i), '%Y-%m') AS month FROM range(6) r(i)) s
LEFT JOIN (SELECT strftime(visit_date, '%Y-%m') AS month, count(*) AS visit_count, sum(payment_amount) AS income
           FROM visits WHERE visit_date >= DATE '2001-02-01' GROUP BY 1) a ON a.month = s.month""")
def q_monthly_visit_trends(spark, sf):
    t = agg.monthly_visit_trends(tables(spark, sf)["visits"], AS_OF_CLINIC)
    return t.select("month_index", "month", "visit_count", dbl("income"))


@query("new_patients_by_month", """
SELECT s.month_index, s.month, coalesce(a.n, 0) AS n
FROM (SELECT CAST(i AS INTEGER) AS month_index, strftime(DATE '2001-02-01' + to_months(i), '%Y-%m') AS month FROM range(6) r(i)) s
LEFT JOIN (SELECT strftime(created_at + INTERVAL 1 HOUR, '%Y-%m') AS month, count(*) AS n
           FROM patients WHERE created_at >= TIMESTAMP '2001-01-31 12:00:00' GROUP BY 1) a ON a.month = s.month""")
def q_new_patients_by_month(spark, sf):
    return agg.new_patients_by_month(tables(spark, sf)["patients"], NOW_CLINIC, NEW_PATIENT_TZ)


@query("outstanding_total", """
SELECT count(*) AS outstanding_count, CAST(coalesce(sum(v.charge_amount - v.payment_amount), 0) AS DOUBLE)
       AS outstanding_total
FROM visits v JOIN patients p ON p.id = v.patient_id WHERE v.charge_amount > v.payment_amount""")
def q_outstanding_total(spark, sf):
    t = tables(spark, sf)
    return agg.outstanding_total(t["visits"], t["patients"]).select("outstanding_count", dbl("outstanding_total"))


# ------------------------------------------------------------------ latest-per-key and refills
_LATEST_SQL = """
latest AS (
  SELECT * FROM (
    SELECT h.*, row_number() OVER (PARTITION BY h.client_id, h.medication ORDER BY h.entry_date DESC, h.id DESC) AS rn
    FROM subscription_history h WHERE h.entry_type = 'Order' AND h.day_supply IS NOT NULL) WHERE rn = 1),
latest_orders AS (
  SELECT l.*, c.name AS client_name, c.phone AS client_phone, c.status AS client_status
  FROM latest l JOIN subscription_clients c ON c.id = l.client_id)"""


@query("latest_order_per_medication", """
SELECT id, client_id, medication, entry_date, day_supply, client_name, client_status FROM latest_orders""",
       extra=_LATEST_SQL)
def q_latest_order_per_medication(spark, sf):
    t = tables(spark, sf)
    return refills.latest_order_per_medication(t["subscription_history"], t["subscription_clients"]).select(
        "id", "client_id", "medication", "entry_date", "day_supply", "client_name", "client_status")


@query("refills_due", f"""
SELECT id, client_id, client_name, medication, entry_date + CAST(trunc(day_supply) AS INTEGER) AS due_date,
       CAST((entry_date + CAST(trunc(day_supply) AS INTEGER)) - DATE '{AS_OF_EVENTS}' AS INTEGER) AS days_until_due
FROM latest_orders
WHERE client_status = 'Active' AND reminder_sent_at IS NULL
  AND (entry_date + CAST(trunc(day_supply) AS INTEGER)) - DATE '{AS_OF_EVENTS}' <= 7""", extra=_LATEST_SQL)
def q_refills_due(spark, sf):
    t = tables(spark, sf)
    return refills.refills_due(t["subscription_history"], t["subscription_clients"], AS_OF_EVENTS).select(
        "id", "client_id", "client_name", "medication", "due_date", "days_until_due")


@query("trend_bar_scale", """
SELECT month, visit_count,
       greatest(4, CAST(floor(visit_count * 100.0 / greatest(1.0, max(visit_count) OVER ()) + 0.5) AS INT)) AS height_pct,
       strftime(strptime(month, '%Y-%m'), '%b') AS label
FROM (SELECT s.month, coalesce(a.visit_count, 0) AS visit_count
      FROM (SELECT strftime(DATE '2001-02-01' + to_months(i), '%Y-%m') AS month FROM range(6) r(i)) s
      LEFT JOIN (SELECT strftime(visit_date, '%Y-%m') AS month, count(*) AS visit_count
                 FROM visits WHERE visit_date >= DATE '2001-02-01' GROUP BY 1) a ON a.month = s.month)""")
def q_trend_bar_scale(spark, sf):
    t = agg.monthly_visit_trends(tables(spark, sf)["visits"], AS_OF_CLINIC)
    return refills.trend_bar_scale(t, "visit_count").select("month", "visit_count", "height_pct", "label")


# ------------------------------------------------------------------ stock ledger
_FOLD_SQL = """
req AS (
  SELECT *, row_number() OVER (PARTITION BY drug_id
           ORDER BY requested_at, src_order, src_line, quantity, src_price, src_flag) AS seq
  FROM stock_requests),
fold AS (
  SELECT d.id AS drug_id, CAST(0 AS BIGINT) AS seq, CAST(d.quantity_on_hand AS DECIMAL(18,3)) AS bal,
         CAST(NULL AS BOOLEAN) AS ok
  FROM drugs d
  UNION ALL
  SELECT f.drug_id, r.seq,
         CAST(CASE WHEN r.quantity <= 0 THEN f.bal
                   WHEN r.type = 'restock' THEN f.bal + r.quantity
                   WHEN r.quantity <= f.bal THEN f.bal - r.quantity
                   ELSE f.bal END AS DECIMAL(18,3)),
         CASE WHEN r.quantity <= 0 THEN false WHEN r.type = 'restock' THEN true ELSE r.quantity <= f.bal END
  FROM fold f JOIN req r ON r.drug_id = f.drug_id AND r.seq = f.seq + 1),
ledger AS (
  SELECT r.*, coalesce(f.ok, false) AS accepted, f.bal AS balance_after, prev.bal AS balance_before
  FROM req r LEFT JOIN fold f ON f.drug_id = r.drug_id AND f.seq = r.seq
  LEFT JOIN fold prev ON prev.drug_id = r.drug_id AND prev.seq = r.seq - 1)"""


def _ledger(spark, sf):
    t = tables(spark, sf)
    return t, ledger.stock_ledger_apply(t["drugs"], t["stock_requests"], LEDGER_ORDER)


@query("stock_ledger_apply", """
SELECT l.drug_id, l.src_order, l.src_line, l.src_flag, l.type, CAST(l.quantity AS DOUBLE) AS quantity, l.created_by_staff_id, l.accepted,
       CASE WHEN l.accepted THEN NULL
            WHEN l.balance_before IS NULL THEN 'No drug with id ' || coalesce(CAST(l.drug_id AS VARCHAR), 'null')
            WHEN l.quantity <= 0 THEN 'quantity must be greater than 0'
            ELSE 'Only ' || (CASE WHEN l.balance_before = floor(l.balance_before)
                                  THEN CAST(CAST(l.balance_before AS BIGINT) AS VARCHAR)
                                  ELSE CAST(CAST(l.balance_before AS DOUBLE) AS VARCHAR) END)
                 || ' ' || coalesce(d.unit, 'unit(s)') || ' of ' || d.name || ' in stock' END AS reason,
       CAST(l.balance_after AS DOUBLE) AS balance_after
FROM ledger l LEFT JOIN drugs d ON d.id = l.drug_id""", recursive=True, extra=_FOLD_SQL)
def q_stock_ledger_apply(spark, sf):
    _, led = _ledger(spark, sf)
    return led.select("drug_id", "src_order", "src_line", "src_flag", "type", dbl("quantity"), "created_by_staff_id", "accepted", "reason",
                      dbl("balance_after"))


@query("stock_on_hand", """
SELECT d.id AS drug_id, d.name, CAST(d.quantity_on_hand AS DOUBLE) AS opening,
       CAST(coalesce(f.bal, d.quantity_on_hand) AS DOUBLE) AS quantity_on_hand
FROM drugs d LEFT JOIN (SELECT drug_id, bal, row_number() OVER (PARTITION BY drug_id ORDER BY seq DESC) AS rn
                        FROM fold) f ON f.drug_id = d.id AND f.rn = 1""", recursive=True, extra=_FOLD_SQL)
def q_stock_on_hand(spark, sf):
    t, led = _ledger(spark, sf)
    return ledger.stock_on_hand(t["drugs"], led, LEDGER_ORDER).select(
        "drug_id", "name", dbl("opening"), dbl("quantity_on_hand"))


@query("stock_expiry_replace", """
SELECT d.id AS drug_id, d.expiry_date AS old_expiry_date, coalesce(n.expiry_date, d.expiry_date) AS expiry_date
FROM drugs d LEFT JOIN (
  SELECT drug_id, expiry_date, row_number() OVER (PARTITION BY drug_id ORDER BY seq DESC) AS rn
  FROM ledger WHERE accepted AND type = 'restock' AND expiry_date IS NOT NULL) n ON n.drug_id = d.id AND n.rn = 1""",
       recursive=True, extra=_FOLD_SQL)
def q_stock_expiry_replace(spark, sf):
    t, led = _ledger(spark, sf)
    return ledger.stock_expiry_replace(t["drugs"], led, LEDGER_ORDER)


@query("stock_reconcile", """
SELECT d.id AS drug_id, CAST(d.quantity_on_hand AS DOUBLE) AS opening,
       CAST(coalesce(m.net, 0) AS DOUBLE) AS net_movement, coalesce(m.cnt, 0) AS accepted_count,
       CAST(coalesce(f.bal, d.quantity_on_hand) + CASE WHEN d.id % 97 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS quantity_on_hand,
       d.id % 97 <> 0 AS balanced
FROM drugs d
LEFT JOIN (SELECT drug_id, bal, row_number() OVER (PARTITION BY drug_id ORDER BY seq DESC) AS rn FROM fold) f
  ON f.drug_id = d.id AND f.rn = 1
LEFT JOIN (SELECT drug_id, sum(CASE WHEN type = 'restock' THEN quantity ELSE -quantity END) AS net, count(*) AS cnt
           FROM ledger WHERE accepted GROUP BY drug_id) m ON m.drug_id = d.id""", recursive=True, extra=_FOLD_SQL)
def q_stock_reconcile(spark, sf):
    """The movement log against stored quantities, some of which are off by one."""
    t, led = _ledger(spark, sf)
    after = ledger.stock_on_hand(t["drugs"], led, LEDGER_ORDER)
    off = F.when(F.col("drug_id") % 97 == 0, 1).otherwise(0)
    stored = after.select(F.col("drug_id").alias("id"), (F.col("quantity_on_hand") + off).alias("quantity_on_hand"))
    r = ledger.stock_reconcile(t["drugs"], ledger.accepted_movements(led), stored)
    return r.select("drug_id", dbl("opening"), dbl("net_movement"), "accepted_count", dbl("quantity_on_hand"),
                    "balanced")


@query("stock_ledger_by_clinic", """
SELECT d.clinic_id, l.drug_id, l.src_order, l.src_line, l.src_flag, l.accepted,
       CAST(l.balance_after AS DOUBLE) AS balance_after
FROM ledger l LEFT JOIN drugs d ON d.id = l.drug_id""", recursive=True, extra=_FOLD_SQL)
def q_stock_ledger_by_clinic(spark, sf):
    from ..plans.reports import stamp_tenant
    t = tables(spark, sf)
    req = stamp_tenant(t["stock_requests"], t["drugs"], "drug_id")
    led = ledger.stock_ledger_apply(t["drugs"], req, LEDGER_ORDER, tenant=["clinic_id"])
    return led.select("clinic_id", "drug_id", "src_order", "src_line", "src_flag", "accepted", dbl("balance_after"))


# ------------------------------------------------------------------ keyed listings and lookups
_SEEN = f"SELECT DISTINCT patient_id FROM visits WHERE visit_date = DATE '{AS_OF_CLINIC}'"


def _seen(t):
    return t["visits"].where(F.col("visit_date") == F.lit(AS_OF_CLINIC)).select(F.col("patient_id").alias("id"))


@query("visit_history_keyed", f"""
SELECT v.id, v.patient_id, v.visit_date, s.name AS recorded_by_name
FROM visits v LEFT JOIN staff s ON s.id = v.created_by_staff_id WHERE v.patient_id IN ({_SEEN})""")
def q_visit_history_keyed(spark, sf):
    t = tables(spark, sf)
    return joins.visit_history(t["visits"], t["staff"], _seen(t)).select("id", "patient_id", "visit_date", "recorded_by_name")


@query("movement_history_keyed", """
SELECT m.id, m.drug_id, m.type, s.name AS recorded_by_name
FROM drug_movements m LEFT JOIN staff s ON s.id = m.created_by_staff_id
WHERE m.drug_id IN (SELECT id FROM drugs WHERE quantity_on_hand <= reorder_level)""")
def q_movement_history_keyed(spark, sf):
    t = tables(spark, sf)
    return joins.movement_history(t["drug_movements"], t["staff"], search.low_stock(t["drugs"]).select("id")).select(
        "id", "drug_id", "type", "recorded_by_name")


@query("patient_appointments_keyed", f"""
SELECT id, patient_id, appointment_date, status FROM appointments WHERE patient_id IN ({_SEEN})""")
def q_patient_appointments_keyed(spark, sf):
    t = tables(spark, sf)
    return joins.patient_appointments(t["appointments"], _seen(t)).select("id", "patient_id", "appointment_date", "status")


@query("client_history_keyed", """
SELECT h.id, h.client_id, h.entry_date, s.name AS recorded_by_name
FROM subscription_history h LEFT JOIN staff s ON s.id = h.created_by_staff_id
WHERE h.client_id IN (SELECT id FROM subscription_clients WHERE status = 'Inactive')""")
def q_client_history_keyed(spark, sf):
    t = tables(spark, sf)
    keys = t["subscription_clients"].where("status = 'Inactive'").select("id")
    return joins.client_history(t["subscription_history"], t["staff"], keys).select("id", "client_id", "entry_date", "recorded_by_name")


@query("lookup_drugs", """
SELECT id, name FROM drugs WHERE id IN (SELECT drug_id FROM stock_requests)""")
def q_lookup_drugs(spark, sf):
    t = tables(spark, sf)
    return search.lookup_by_keys(t["drugs"], t["stock_requests"].select(F.col("drug_id").alias("id"))).select("id", "name")


@query("lookup_appointments", """
SELECT id, status FROM appointments WHERE id IN (SELECT id FROM appointment_status_changes)""")
def q_lookup_appointments(spark, sf):
    t = tables(spark, sf)
    return search.lookup_by_keys(t["appointments"], t["appointment_status_changes"]).select("id", "status")


@query("lookup_clients", """
SELECT id, name, status FROM subscription_clients WHERE id IN (SELECT client_id FROM subscription_history)""")
def q_lookup_clients(spark, sf):
    t = tables(spark, sf)
    return search.lookup_by_keys(t["subscription_clients"], t["subscription_history"].select(F.col("client_id").alias("id"))).select("id", "name", "status")


@query("lookup_settings", """
SELECT clinic_id, key, value FROM settings_stored WHERE (clinic_id, key) IN (SELECT clinic_id, key FROM settings_log)""")
def q_lookup_settings(spark, sf):
    t = tables(spark, sf)
    return search.lookup_by_keys(t["settings_stored"], t["settings_log"], "key", tenant=["clinic_id"]).select("clinic_id", "key", "value")
