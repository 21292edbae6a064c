"""Clinic tables as StructTypes, plus the fixed values the engine must share
with the application it mirrors.

Money is DECIMAL(18,2) and stock quantities DECIMAL(18,3) so sums do not
depend on the order a cluster adds them in; they become DOUBLE only in the
last projection of a report. Every table may carry an optional ``clinic_id``
tenant column; operators take ``tenant=("clinic_id",)`` to run over many
clinics in one job.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
QTY = T.DecimalType(18, 3)

# Columns and headers of the three CSV exports, in file order.
PATIENT_COLUMNS = (("first_name", "First Name"), ("last_name", "Last Name"), ("date_of_birth", "Date of Birth"),
                   ("gender", "Gender"), ("phone", "Phone"), ("address", "Address"), ("created_at", "Registered At"))
VISIT_COLUMNS = (("visit_date", "Visit Date"), ("patient_name", "Patient"), ("complaint", "Complaint"),
                 ("treatment", "Treatment"), ("temperature_c", "Temperature (C)"),
                 ("blood_pressure", "Blood Pressure"), ("pulse_bpm", "Pulse (bpm)"), ("weight_kg", "Weight (kg)"),
                 ("charge_amount", "Charged"), ("payment_amount", "Paid"), ("balance", "Balance"),
                 ("payment_method", "Payment Method"), ("notes", "Notes"), ("recorded_by_name", "Recorded By"))
DRUG_COLUMNS = (("name", "Name"), ("unit", "Unit"), ("quantity_on_hand", "Quantity On Hand"),
                ("reorder_level", "Reorder Level"), ("expiry_date", "Expiry Date"), ("notes", "Notes"))

# ---------------------------------------------------------------------------
# Fixed values (must equal the application's for the same results)
# ---------------------------------------------------------------------------
APPOINTMENT_STATUSES = ("Scheduled", "Completed", "Cancelled", "No-Show")
CLIENT_STATUSES = ("Active", "Inactive")
ENTRY_TYPES = ("Order", "Note", "Contact")
MOVEMENT_TYPES = ("restock", "dispense")
PLANS = ("3month", "10month")
PLAN_MONTHS = {"3month": 3, "10month": 10}
PLAN_PRICES = {("3month", "buy"): 70, ("10month", "buy"): 150,
               ("3month", "renew"): 20, ("10month", "renew"): 40}
ROLES = ("Admin", "Doctor", "Nurse", "Front Desk")
LIST_CAP = 200                # on-screen search lists
TOP_ILLNESSES_WEEK = 5
TOP_ILLNESSES_6M = 8
TREND_MONTHS = 6
EXPIRY_HORIZON_DAYS = 30
REFILL_WINDOW_DAYS = 7
SNAPSHOTS_KEPT = 10
AI_DAILY_LIMIT = 100
BANNER_WARNING_DAYS = 7
# Values typed into the settings forms, stored trimmed.
TRIMMED_SETTING_KEYS = ("aiAssistantName", "aiApiKey", "smsUsername", "smsApiKey", "smsSenderId")
SECRET_SETTING_KEYS = ("aiApiKey", "smsApiKey", "cloudSyncToken")
SNAPSHOT_PREFIX = "snapshot-"
# ---------------------------------------------------------------------------


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


SETTINGS = T.StructType([_f("key", T.StringType(), False), _f("value", T.StringType())])

STAFF = T.StructType([
    _f("id", T.LongType(), False), _f("name", T.StringType()), _f("role", T.StringType()),
    _f("username", T.StringType()), _f("active", T.IntegerType()), _f("created_at", T.TimestampType()),
])

PATIENTS = T.StructType([
    _f("id", T.LongType(), False), _f("first_name", T.StringType(), False),
    _f("last_name", T.StringType(), False), _f("date_of_birth", T.DateType()),
    _f("gender", T.StringType()), _f("phone", T.StringType()), _f("address", T.StringType()),
    _f("created_by_staff_id", T.LongType()), _f("created_at", T.TimestampType()),
])

VISITS = T.StructType([
    _f("id", T.LongType(), False), _f("patient_id", T.LongType(), False),
    _f("visit_date", T.DateType(), False), _f("complaint", T.StringType()),
    _f("treatment", T.StringType()), _f("temperature_c", T.DoubleType()),
    _f("blood_pressure", T.StringType()), _f("pulse_bpm", T.IntegerType()),
    _f("weight_kg", T.DoubleType()), _f("charge_amount", MONEY), _f("payment_amount", MONEY),
    _f("payment_method", T.StringType()), _f("notes", T.StringType()),
    _f("created_by_staff_id", T.LongType()), _f("created_at", T.TimestampType()),
])

DRUGS = T.StructType([
    _f("id", T.LongType(), False), _f("name", T.StringType(), False), _f("unit", T.StringType()),
    _f("quantity_on_hand", QTY), _f("reorder_level", QTY), _f("expiry_date", T.DateType()),
    _f("notes", T.StringType()), _f("created_by_staff_id", T.LongType()),
    _f("created_at", T.TimestampType()),
])

DRUG_MOVEMENTS = T.StructType([
    _f("id", T.LongType(), False), _f("drug_id", T.LongType(), False), _f("type", T.StringType()),
    _f("quantity", QTY), _f("note", T.StringType()), _f("created_by_staff_id", T.LongType()),
    _f("created_at", T.TimestampType()),
])

APPOINTMENTS = T.StructType([
    _f("id", T.LongType(), False), _f("patient_id", T.LongType(), False),
    _f("appointment_date", T.DateType(), False), _f("appointment_time", T.StringType()),
    _f("reason", T.StringType()), _f("status", T.StringType()), _f("notes", T.StringType()),
    _f("created_by_staff_id", T.LongType()), _f("created_at", T.TimestampType()),
])

SUBSCRIPTION_CLIENTS = T.StructType([
    _f("id", T.LongType(), False), _f("name", T.StringType(), False), _f("phone", T.StringType()),
    _f("sponsor", T.StringType()), _f("sponsor_contact", T.StringType()),
    _f("status", T.StringType()), _f("created_by_staff_id", T.LongType()),
    _f("created_at", T.TimestampType()),
])

SUBSCRIPTION_HISTORY = T.StructType([
    _f("id", T.LongType(), False), _f("client_id", T.LongType(), False),
    _f("entry_date", T.DateType(), False), _f("entry_type", T.StringType()),
    _f("medication", T.StringType()), _f("indication", T.StringType()),
    _f("quantity", T.StringType()), _f("day_supply", T.DoubleType()), _f("note", T.StringType()),
    _f("reminder_sent_at", T.TimestampType()), _f("created_by_staff_id", T.LongType()),
    _f("created_at", T.TimestampType()),
])

TABLES: dict[str, T.StructType] = {
    "settings": SETTINGS, "staff": STAFF, "patients": PATIENTS, "visits": VISITS,
    "drugs": DRUGS, "drug_movements": DRUG_MOVEMENTS, "appointments": APPOINTMENTS,
    "subscription_clients": SUBSCRIPTION_CLIENTS, "subscription_history": SUBSCRIPTION_HISTORY,
}
