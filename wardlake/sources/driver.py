"""Binds the driver's generated tables to the clinic tables.

Each clinic table is one or more projections of a driver table. The
projections are plain SQL expressions that Spark (``selectExpr``) and DuckDB
(the correctness oracle) read the same way, so both engines see identical
clinic rows. NULLs, blanks, unknown authors and refusals are made on purpose
from key arithmetic; no row of a driver table is left out.

Tenant: ``clinic_id`` comes from the customer's nation where a table has a
customer behind it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed report dates for the driver data (orders end 2001-08, events span Jan 2024).
AS_OF_CLINIC = dt.date(2001, 7, 31)
AS_OF_EVENTS = dt.date(2024, 1, 28)
NOW_CLINIC = dt.datetime(2001, 7, 31, 12, 0, 0)

# table -> list of (driver table, select expressions, where-clause or None)
BINDINGS: dict[str, list[tuple[str, list[str], str | None]]] = {
    "staff": [("supplier", [
        "CAST(s_suppkey AS BIGINT) AS id",
        "s_name AS name",
        "CASE s_suppkey % 4 WHEN 0 THEN 'Admin' WHEN 1 THEN 'Doctor' WHEN 2 THEN 'Nurse' ELSE 'Front Desk' END AS role",
        "lower(s_name) AS username",
        "CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 1 END AS active",
        "CAST(s_nationkey AS INT) AS clinic_id",
    ], None)],
    "patients": [("customer", [
        "CAST(c_custkey AS BIGINT) AS id",
        "substring(c_name, 1, 8) AS first_name",
        "substring(c_name, 10, 9) AS last_name",
        "DATE '1950-01-01' + CAST(c_custkey % 20000 AS INT) AS date_of_birth",
        "CASE c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE NULL END AS gender",
        "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('0770', lpad(CAST(c_custkey AS STRING), 6, '0')) END AS phone",
        "c_mktsegment AS address",
        "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 120 AS BIGINT) END AS created_by_staff_id",
        "CAST(concat(CAST(DATE '2001-01-01' + CAST(c_custkey % 250 AS INT) AS STRING), ' ',"
        " lpad(CAST(c_custkey % 24 AS STRING), 2, '0'), ':30:00') AS TIMESTAMP) AS created_at",
        "CAST(c_nationkey AS INT) AS clinic_id",
    ], None)],
    "visits": [("orders", [
        "CAST(o_orderkey AS BIGINT) AS id",
        "CAST(o_custkey AS BIGINT) AS patient_id",
        "CAST(o_orderdate AS DATE) AS visit_date",
        "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN (CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE '  ' END)"
        " ELSE o_orderpriority END AS complaint",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('Rx-', o_orderstatus) END AS treatment",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(360 + o_orderkey % 30 AS DOUBLE) / 10 END AS temperature_c",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat(CAST(100 + o_orderkey % 40 AS STRING), '/',"
        " CAST(60 + o_orderkey % 30 AS STRING)) END AS blood_pressure",
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(60 + o_orderkey % 40 AS INT) END AS pulse_bpm",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(400 + o_orderkey % 500 AS DOUBLE) / 10 END AS weight_kg",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS charge_amount",
        "CASE o_orderstatus WHEN 'F' THEN CAST(o_totalprice AS DECIMAL(18,2))"
        " WHEN 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) - CAST(o_orderkey % 500 + 1 AS DECIMAL(18,2)) AS DECIMAL(18,2))"
        " ELSE CAST(0 AS DECIMAL(18,2)) END AS payment_amount",
        "CASE o_orderkey % 4 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Mobile Money' WHEN 2 THEN NULL ELSE 'Insurance' END AS payment_method",
        "CASE WHEN o_orderkey % 10 = 0 THEN 'follow up, \"urgent\"' ELSE NULL END AS notes",
        "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey % 120 AS BIGINT) END AS created_by_staff_id",
        "CAST(o_orderdate AS TIMESTAMP) AS created_at",
    ], None)],
    "drugs": [("part", [
        "CAST(p_partkey AS BIGINT) AS id",
        "p_name AS name",
        "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS unit",
        "CAST(p_size AS DECIMAL(18,3)) AS quantity_on_hand",
        "CAST(p_partkey % 20 AS DECIMAL(18,3)) AS reorder_level",
        "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE DATE '2001-01-01' + CAST(p_partkey % 400 AS INT) END AS expiry_date",
        "CASE WHEN p_partkey % 9 = 0 THEN 'keep cool' ELSE NULL END AS notes",
        "CAST(p_partkey % 120 AS BIGINT) AS created_by_staff_id",
        "CAST(p_partkey % 25 AS INT) AS clinic_id",
    ], None)],
    # Stock requests in arrival order. (l_shipdate, l_orderkey, l_linenumber,
    # l_quantity, l_extendedprice, l_returnflag) is unique within a part.
    "stock_requests": [("lineitem", [
        "CASE WHEN l_orderkey % 101 = 0 THEN NULL WHEN l_orderkey % 103 = 0 THEN CAST(l_partkey + 100000000 AS BIGINT)"
        " ELSE CAST(l_partkey AS BIGINT) END AS drug_id",
        "CASE WHEN l_returnflag = 'R' THEN 'restock' ELSE 'dispense' END AS type",
        "CASE WHEN l_orderkey % 107 = 0 THEN CAST(0 AS DECIMAL(18,3)) ELSE CAST(l_quantity AS DECIMAL(18,3)) END AS quantity",
        "CASE WHEN l_returnflag = 'R' AND l_orderkey % 3 = 0 THEN CAST(l_shipdate AS DATE) + 365 ELSE NULL END AS expiry_date",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_suppkey AS BIGINT) + 9007199254740993 END AS created_by_staff_id",
        "CAST(l_shipdate AS TIMESTAMP) AS requested_at",
        "CAST(l_orderkey AS BIGINT) AS src_order",
        "CAST(l_linenumber AS INT) AS src_line",
        "CAST(l_extendedprice AS DOUBLE) AS src_price",
        "l_returnflag AS src_flag",
    ], None)],
    # The movement log as stored: one row per line item, newest-first listings.
    "drug_movements": [("lineitem", [
        "CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS id",
        "CAST(l_partkey AS BIGINT) AS drug_id",
        "CASE WHEN l_returnflag = 'R' THEN 'restock' ELSE 'dispense' END AS type",
        "CAST(l_quantity AS DECIMAL(18,3)) AS quantity",
        "CASE WHEN l_linestatus = 'O' THEN 'open' ELSE NULL END AS note",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_suppkey AS BIGINT) END AS created_by_staff_id",
        "CAST(l_shipdate AS TIMESTAMP) AS created_at",
    ], None)],
    "appointments": [("events", [
        "CAST(event_id AS BIGINT) AS id",
        "CAST(user_id AS BIGINT) AS patient_id",
        "CAST(ts AS DATE) AS appointment_date",
        "CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat(lpad(CAST(hour(ts) AS STRING), 2, '0'), ':',"
        " lpad(CAST(minute(ts) AS STRING), 2, '0')) END AS appointment_time",
        "event_type AS reason",
        "CASE event_type WHEN 'view' THEN 'Scheduled' WHEN 'signup' THEN 'Scheduled' WHEN 'purchase' THEN 'Completed'"
        " WHEN 'click' THEN 'Cancelled' ELSE 'No-Show' END AS status",
        "CASE WHEN event_id % 17 = 0 THEN 'bring results' ELSE NULL END AS notes",
        "CAST(event_id % 120 AS BIGINT) AS created_by_staff_id",
        "CAST(ts AS TIMESTAMP) AS created_at",
    ], None)],
    "subscription_clients": [("customer", [
        "CAST(c_custkey AS BIGINT) AS id",
        "c_name AS name",
        "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('0880', lpad(CAST(c_custkey AS STRING), 6, '0')) END AS phone",
        "CASE WHEN c_custkey % 4 = 0 THEN 'Self' ELSE NULL END AS sponsor",
        "CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE NULL END AS sponsor_contact",
        "CASE WHEN c_custkey % 11 = 0 THEN 'Inactive' ELSE 'Active' END AS status",
        "CAST(c_custkey % 120 AS BIGINT) AS created_by_staff_id",
        "CAST(c_nationkey AS INT) AS clinic_id",
    ], None)],
    "subscription_history": [("events", [
        "CAST(event_id AS BIGINT) AS id",
        "CAST(user_id AS BIGINT) AS client_id",
        "CAST(ts AS DATE) AS entry_date",
        "CASE event_type WHEN 'signup' THEN 'Note' WHEN 'error' THEN 'Contact' ELSE 'Order' END AS entry_type",
        "CASE WHEN event_id % 20 = 0 THEN NULL ELSE concat('med-', CAST(event_id % 20 AS STRING)) END AS medication",
        "CASE WHEN event_id % 3 = 0 THEN concat(CAST(event_id % 60 + 1 AS STRING), ' tablets') ELSE NULL END AS quantity",
        "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN CAST(30.5 AS DOUBLE) ELSE CAST(event_id % 60 + 1 AS DOUBLE) END AS day_supply",
        "CASE WHEN event_id % 5 = 0 THEN props ELSE NULL END AS note",
        "CASE WHEN event_id % 13 = 0 THEN CAST(ts AS TIMESTAMP) ELSE NULL END AS reminder_sent_at",
        "CAST(event_id % 120 AS BIGINT) AS created_by_staff_id",
    ], None)],
    # Settings as an ordered change log per clinic (one clinic per nation).
    "settings_log": [
        ("nation", ["n_nationkey AS clinic_id", "'clinicName' AS key", "n_name AS value", "1 AS seq"], None),
        ("nation", ["n_nationkey AS clinic_id", "'clinicName' AS key",
                    "CASE WHEN n_nationkey % 3 = 0 THEN concat(n_name, ' Clinic') ELSE NULL END AS value",
                    "2 AS seq"], None),
        ("nation", ["n_nationkey AS clinic_id", "'licenseExpiresAt' AS key",
                    "CASE WHEN n_nationkey % 6 = 5 THEN NULL"
                    " ELSE CAST(DATE '2001-07-31' + CAST(n_nationkey * 3 - 30 AS INT) AS STRING) END AS value",
                    "3 AS seq"], None),
        ("nation", ["n_nationkey AS clinic_id", "'licensePlan' AS key",
                    "CASE WHEN n_nationkey % 4 = 3 THEN NULL WHEN n_nationkey % 3 = 0 THEN '3month'"
                    " ELSE '10month' END AS value", "4 AS seq"], None),
        ("nation", ["n_nationkey AS clinic_id", "'refillRemindersEnabled' AS key",
                    "CASE WHEN n_nationkey % 2 = 0 THEN '1' ELSE '0' END AS value", "5 AS seq"], None),
        ("nation", ["n_nationkey AS clinic_id", "'smsUsername' AS key",
                    "CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE concat('  ', lower(n_name), ' ') END AS value", "6 AS seq"], None),
        ("nation", ["n_nationkey AS clinic_id", "'smsApiKey' AS key",
                    "CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE concat('sk-', CAST(n_nationkey AS STRING)) END AS value",
                    "7 AS seq"], None),
        ("nation", ["n_nationkey AS clinic_id", "'smsSenderId' AS key",
                    "CASE WHEN n_nationkey % 3 = 1 THEN upper(substring(n_name, 1, 4)) ELSE NULL END AS value",
                    "8 AS seq"], None),
        ("nation", ["n_nationkey AS clinic_id", "'cloudSyncToken' AS key",
                    "concat('tok-', CAST(n_regionkey AS STRING)) AS value", "9 AS seq"], None),
        ("nation", ["n_nationkey AS clinic_id", "'lastCloudSyncAt' AS key",
                    "CASE WHEN n_nationkey % 2 = 0 THEN '2001-07-30T10:00:00.000Z' ELSE NULL END AS value",
                    "10 AS seq"], None),
        ("nation", ["n_nationkey AS clinic_id", "'lastBackupAt' AS key", "'2001-07-31T09:00:00.000Z' AS value",
                    "11 AS seq"], None),
        ("nation", ["n_nationkey AS clinic_id", "'lastBackupError' AS key",
                    "CASE WHEN n_nationkey % 7 = 1 THEN 'disk full' ELSE NULL END AS value", "12 AS seq"], None),
        ("nation", ["n_nationkey AS clinic_id", "'aiApiKey' AS key",
                    "CASE WHEN n_nationkey % 2 = 1 THEN 'ai-secret' ELSE '  ' END AS value", "13 AS seq"], None),
        ("nation", ["n_nationkey AS clinic_id", "'aiAssistantName' AS key",
                    "concat(substring(n_name, 1, 1), lower(substring(n_name, 2, 5)), ' Helper') AS value",
                    "14 AS seq"], None),
    ],
    # License feed documents as fetched, one per clinic, some malformed on purpose.
    "license_docs": [("nation", [
        "n_nationkey AS doc_id",
        "CAST(n_nationkey AS STRING) AS clinic_key",
        "CASE n_nationkey % 6"
        " WHEN 0 THEN concat('{\"', CAST(n_nationkey AS STRING), '\": {\"expiresAt\": \"2002-0',"
        " CAST(n_nationkey % 9 + 1 AS STRING), '-15\", \"plan\": \"10month\"}}')"
        " WHEN 1 THEN concat('{\"', CAST(n_nationkey AS STRING), '\": {\"expiresAt\": \"2001-12-01\", \"plan\": \"lifetime\"}}')"
        " WHEN 2 THEN concat('{\"', CAST(n_nationkey AS STRING), '\": {\"plan\": \"3month\"}}')"
        " WHEN 3 THEN concat('{\"', CAST(n_nationkey AS STRING), '\": {\"expiresAt\": 20011201}}')"
        " WHEN 4 THEN concat('{\"', CAST(n_nationkey + 100 AS STRING), '\": {\"expiresAt\": \"2003-01-01\"}}')"
        " ELSE (CASE WHEN n_regionkey % 2 = 0 THEN 'not json'"
        " ELSE concat('{\"', CAST(n_nationkey AS STRING), '\": {\"expiresAt\": \"2001-07-31\", \"clinicName\": \"x\"}}') END)"
        " END AS text",
    ], None)],
    # Incoming form batches (raw text as typed) for the ingest operators.
    "incoming_patients": [("customer", [
        "CAST(c_custkey AS BIGINT) AS row_key",
        "CASE WHEN c_custkey % 37 = 0 THEN '  ' ELSE concat(' ', substring(c_name, 1, 8), ' ') END AS first_name",
        "CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE substring(c_name, 10, 9) END AS last_name",
        "CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'unknown'"
        " ELSE CAST(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INT) AS STRING) END AS date_of_birth",
        "CASE c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE '' END AS gender",
        "CASE WHEN c_custkey % 10 = 0 THEN '' ELSE concat('0770', lpad(CAST(c_custkey AS STRING), 6, '0')) END AS phone",
        "c_mktsegment AS address",
        "CAST(c_custkey % 120 AS STRING) AS created_by_staff_id",
    ], None)],
    "incoming_visits": [("orders", [
        "CAST(o_orderkey AS BIGINT) AS row_key",
        "CASE WHEN o_orderkey % 53 = 0 THEN '' WHEN o_orderkey % 59 = 0 THEN CAST(o_custkey + 1000000 AS STRING)"
        " ELSE CAST(o_custkey AS STRING) END AS patient_id",
        "CASE WHEN o_orderkey % 61 = 0 THEN ' ' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS visit_date",
        "o_orderpriority AS complaint",
        "'' AS treatment",
        "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN (CASE o_orderkey % 3 WHEN 0 THEN 'abc' WHEN 1 THEN '1d' ELSE 'NaN' END) ELSE CAST(360 + o_orderkey % 30 AS STRING) END AS temperature_c",
        "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '120/80' END AS blood_pressure",
        "CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 6 = 1 THEN '72.5' WHEN o_orderkey % 6 = 2 THEN '1e2' ELSE CAST(60 + o_orderkey % 40 AS STRING) END AS pulse_bpm",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ' 65.5 ' END AS weight_kg",
        "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'n/a'"
        " ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS charge_amount",
        "CASE o_orderstatus WHEN 'F' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
        " WHEN 'P' THEN (CASE WHEN o_orderkey % 3 = 0 THEN '1e17' ELSE ' 100.5 ' END) ELSE 'free' END AS payment_amount",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'Cash' ELSE '' END AS payment_method",
        "CAST(NULL AS STRING) AS notes",
        "CAST(o_orderkey % 120 AS STRING) AS created_by_staff_id",
    ], None)],
    "incoming_drugs": [("part", [
        "CAST(p_partkey AS BIGINT) AS row_key",
        "CASE WHEN p_partkey % 23 = 0 THEN ' ' ELSE concat(p_name, ' ') END AS name",
        "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS unit",
        "CASE WHEN p_partkey % 19 = 0 THEN 'lots' WHEN p_partkey % 31 = 0 THEN '99999999999999999' ELSE CAST(p_size AS STRING) END AS quantity_on_hand",
        "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey % 20 AS STRING) END AS reorder_level",
        "CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 29 = 0 THEN 'soon'"
        " ELSE CAST(DATE '2001-01-01' + CAST(p_partkey % 400 AS INT) AS STRING) END AS expiry_date",
        "CAST(NULL AS STRING) AS notes",
        "CAST(p_partkey % 120 AS STRING) AS created_by_staff_id",
    ], None)],
    "incoming_appointments": [("events", [
        "CAST(event_id AS BIGINT) AS row_key",
        "CASE WHEN event_id % 71 = 0 THEN '0' WHEN event_id % 73 = 0 THEN CAST(user_id + 5000000 AS STRING)"
        " ELSE CAST(user_id AS STRING) END AS patient_id",
        "CASE WHEN event_id % 79 = 0 THEN '' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS appointment_date",
        "CASE WHEN event_id % 2 = 0 THEN '' ELSE '09:30' END AS appointment_time",
        "event_type AS reason",
        "CAST(NULL AS STRING) AS notes",
        "CAST(event_id % 120 AS STRING) AS created_by_staff_id",
    ], None)],
    "incoming_staff": [("supplier", [
        "CAST(s_suppkey AS BIGINT) AS row_key",
        "CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE concat(' ', s_name) END AS name",
        "CASE s_suppkey % 4 WHEN 0 THEN 'Admin' WHEN 1 THEN 'Doctor' WHEN 2 THEN 'Nurse' ELSE 'Front Desk' END AS role",
        "CASE WHEN s_suppkey % 5 = 0 THEN upper(s_name) WHEN s_suppkey % 5 = 1"
        " THEN concat(' New', CAST(s_suppkey % 7 AS STRING), ' ') ELSE concat('user', CAST(s_suppkey AS STRING)) END AS username",
        "CASE WHEN s_suppkey % 17 = 0 THEN '' ELSE 'pw' END AS password",
    ], None)],
    "incoming_clients": [("customer", [
        "CAST(c_custkey AS BIGINT) AS row_key",
        "CASE WHEN c_custkey % 31 = 0 THEN '' ELSE concat(c_name, '  ') END AS name",
        "CASE WHEN c_custkey % 10 = 0 THEN '' ELSE concat('0880', lpad(CAST(c_custkey AS STRING), 6, '0')) END AS phone",
        "CASE WHEN c_custkey % 4 = 0 THEN 'Self' ELSE '' END AS sponsor",
        "CAST(NULL AS STRING) AS sponsor_contact",
        "CAST(c_custkey % 120 AS STRING) AS created_by_staff_id",
    ], None)],
    "incoming_history": [("events", [
        "CAST(event_id AS BIGINT) AS row_key",
        "CASE WHEN event_id % 97 = 0 THEN CAST(user_id + 1000000 AS STRING) ELSE CAST(user_id AS STRING) END AS client_id",
        "CASE WHEN event_id % 89 = 0 THEN '' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS entry_date",
        "CASE event_type WHEN 'signup' THEN 'Note' WHEN 'error' THEN 'Reminder' WHEN 'click' THEN 'Contact'"
        " ELSE 'Order' END AS entry_type",
        "concat('med-', CAST(event_id % 20 AS STRING)) AS medication",
        "CAST(NULL AS STRING) AS indication",
        "CASE WHEN event_id % 3 = 0 THEN '30 tablets' ELSE '' END AS quantity",
        "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 11 = 1 THEN '30.5' WHEN event_id % 11 = 2 THEN '1e1' WHEN event_id % 11 = 3 THEN '1e9' ELSE CAST(event_id % 60 + 1 AS STRING) END AS day_supply",
        "CAST(NULL AS STRING) AS note",
        "CAST(event_id % 120 AS STRING) AS created_by_staff_id",
    ], None)],
    # Change batches for the change-application operators.
    "appointment_status_changes": [("events", [
        "CAST(CASE WHEN event_id % 50 = 1 THEN event_id + 100000000 ELSE event_id - event_id % 2 END AS BIGINT) AS id",
        "CASE event_type WHEN 'view' THEN 'Completed' WHEN 'click' THEN 'Cancelled' WHEN 'purchase' THEN 'No-Show'"
        " WHEN 'signup' THEN 'Scheduled' ELSE 'Done' END AS status",
        "CAST(event_id AS BIGINT) AS seq",
    ], None)],
    "client_status_changes": [("orders", [
        "CAST(o_custkey AS BIGINT) AS id",
        "CASE o_orderstatus WHEN 'F' THEN 'Inactive' WHEN 'O' THEN 'Active' ELSE 'Paused' END AS status",
        "CAST(o_orderkey AS BIGINT) AS seq",
    ], None)],
    "staff_active_changes": [("lineitem", [
        "CAST(l_suppkey AS BIGINT) AS id",
        "l_returnflag = 'N' AS active",
        "CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS seq",
        "CAST(l_shipdate AS TIMESTAMP) AS changed_at",
    ], None)],
    "reminder_marks": [("events", [
        "CAST(event_id AS BIGINT) AS id",
        "CASE WHEN event_type = 'view' THEN CAST(ts AS TIMESTAMP) + INTERVAL 2 DAY ELSE NULL END AS sent_at",
    ], None)],
    # Clinics: one per nation, and quiet ones (a region each) that nothing belongs to.
    "clinics": [("nation", ["CAST(n_nationkey AS INT) AS clinic_id"], None),
                ("region", ["CAST(100 + r_regionkey AS INT) AS clinic_id"], None)],
    # Settings as stored before the change log.
    "settings_stored": [
        ("nation", ["n_nationkey AS clinic_id", "'clinicName' AS key", "'Old name' AS value"], None),
        ("nation", ["n_nationkey AS clinic_id", "'smsUsername' AS key", "concat('old', CAST(n_nationkey AS STRING)) AS value"], None),
        ("nation", ["n_nationkey AS clinic_id", "'aiApiKey' AS key", "'old-key' AS value"], None),
        ("nation", ["n_nationkey AS clinic_id", "'theme' AS key", "' dark ' AS value"], None),
    ],
    # Assistant messages: one clinic per user_id % 4.
    "assistant_messages": [("events", [
        "CAST(user_id % 4 AS INT) AS clinic_id",
        "CAST(event_id AS BIGINT) AS message_id",
        "CAST(ts AS TIMESTAMP) AS sent_at",
    ], None)],
}

CLINIC_TABLES = tuple(BINDINGS)


class BoundTables(Mapping):
    """Clinic tables of one driver folder, each built on first use.

    A query touches two or three tables; building only those keeps planning
    cheap. Each driver file is opened once per session (one file index and
    footer read) and shared by every table bound to it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._built = spark, sf_dir, {}

    def _source(self, src: str) -> DataFrame:
        key = (self._spark, f"{self._dir}/{src}.parquet")   # the session itself, so a new session never hits
        if key not in _SOURCES:
            _SOURCES[key] = self._spark.read.parquet(key[1])
        return _SOURCES[key]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            parts, dfs = BINDINGS[name], []
            if len(parts) > 1 and len({(src, where) for src, _, where in parts}) == 1 and parts[0][2] is None:
                # several rows from each source row: one scan
                rows = F.array(*[F.struct(*[F.expr(e) for e in exprs]) for _, exprs, _ in parts])
                self._built[name] = self._source(parts[0][0]).select(F.inline(rows))
                return self._built[name]
            for src, exprs, where in parts:
                df = self._source(src)
                if where:
                    df = df.where(where)
                dfs.append(df.selectExpr(*exprs))
            df = dfs[0]
            for other in dfs[1:]:
                df = df.unionByName(other)
            self._built[name] = df
        return self._built[name]

    def __iter__(self):
        return iter(BINDINGS)

    def __len__(self):
        return len(BINDINGS)


_SOURCES: dict[tuple[SparkSession, str], DataFrame] = {}


def load_driver_tables(spark: SparkSession, sf_dir: str) -> BoundTables:
    """All clinic tables bound from the driver parquet under ``sf_dir``.

    Lazy twice over: a table's plan is built when first asked for, and nothing
    is read until an action runs; column pruning and filter pushdown reach the
    parquet scan through the projections."""
    return BoundTables(spark, sf_dir)


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A bound clinic table as a streaming DataFrame over the driver's parquet
    (file source; new files under the same glob arrive as new micro-batches)."""
    dfs = []
    for src, exprs, where in BINDINGS[name]:
        path = f"{sf_dir}/{src}.parquet"
        schema = spark.read.parquet(path).schema
        r = spark.readStream.schema(schema)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        df = r.parquet(path[:-1] + "[" + path[-1] + "]")   # a one-file glob: the source wants a pattern
        if where:
            df = df.where(where)
        dfs.append(df.selectExpr(*exprs))
    out = dfs[0]
    for other in dfs[1:]:
        out = out.unionByName(other)
    return out


def binding_ctes() -> str:
    """The same bindings as DuckDB common table expressions (oracle side)."""
    ctes = []
    for name, parts in BINDINGS.items():
        selects = [f"SELECT {', '.join(exprs)} FROM {src}" + (f" WHERE {where}" if where else "")
                   for src, exprs, where in parts]
        ctes.append(f"{name} AS ({' UNION ALL '.join(selects)})")
    return "WITH " + ",\n".join(ctes)
