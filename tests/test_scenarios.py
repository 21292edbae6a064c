"""Scenario tests ported from the application's own test script: tiny tables,
one operator, exact values. ``as_of`` is fixed (Friday 2026-08-14)."""

import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from helpers import AS_OF, days, rows
from wardlake.functions import labels
from wardlake.operators import aggregates as agg
from wardlake.operators import changes, ingest, joins, ledger, refills, search
from wardlake.plans import reports
from wardlake.sources.tables import conform, schema_upgrade

ORDER = ["seq"]


def _patients(spark):
    return conform(spark.createDataFrame(
        [(1, "Ingrid", "Sandvik", dt.date(1987, 11, 23), "Female", "0555010203", None, 1),
         (2, "Teodor", "Abara", None, None, None, None, 1),
         (3, "Ann", "Smith", None, None, "0555999111", None, None)],
        "id long, first_name string, last_name string, date_of_birth date, gender string, phone string, "
        "address string, created_by_staff_id long"), "patients")


def _staff(spark):
    return spark.createDataFrame([(1, "Nurse Petra", "Nurse", "nursepetra", 1), (2, "Dr Who", "Doctor", "drwho", 0)],
                                 "id long, name string, role string, username string, active int")


def test_patient_ingest_and_search(spark):
    batch = spark.createDataFrame(
        [(1, " Ingrid ", "Sandvik", "1987-11-23", "Female", "0555010203", "", ""),
         (2, "", "Abara", "", "", "", "", "")],
        "row_key long, first_name string, last_name string, date_of_birth string, gender string, phone string, "
        "address string, created_by_staff_id string")
    out = ingest.ingest_patients(batch)
    ok = ingest.accepted(out).collect()
    assert len(ok) == 1 and ok[0].first_name == "Ingrid" and ok[0].gender == "Female" and ok[0].address is None
    assert ingest.rejected(out).collect()[0].reasons == ["firstName is required"]
    p = _patients(spark)
    assert [r.id for r in search.search_patients(p, "sand").collect()] == [1]
    assert [r.id for r in search.search_patients(p, "0555010").collect()] == [1]
    assert [r.id for r in search.search_patients(p, "  ").collect()] == [2, 1, 3]   # last, first order


def test_visit_billing_defaults_and_balances(spark):
    p = _patients(spark)
    batch = spark.createDataFrame(
        [(1, "1", "2026-08-14", "15.5", None, ""), (2, "1", "2026-08-14", "20", "", ""),
         (3, "2", "2026-08-14", "30", "50", "38.5"), (4, "9999", "2026-08-14", "5", None, ""),
         (5, "1", "2026-08-14", "abc", "x", " ")],
        "row_key long, patient_id string, visit_date string, payment_amount string, charge_amount string, "
        "temperature_c string")
    out_df = ingest.ingest_visits(batch, p)
    out = out_df.orderBy("row_key").collect()
    assert [(r.charge_amount, r.payment_amount) for r in out[:3]] == [
        (Decimal("15.50"), Decimal("15.50")), (Decimal("20.00"), Decimal("20.00")), (Decimal("50.00"), Decimal("30.00"))]
    assert out[2].temperature_c == 38.5 and out[0].temperature_c is None      # blank vitals stay NULL, never 0
    assert out[3].reasons == ["No patient with id 9999"]
    assert (out[4].charge_amount, out[4].payment_amount) == (Decimal("0.00"), Decimal("0.00"))
    visits = ingest.accepted(out_df).withColumn("id", F.col("row_key"))
    bal = joins.outstanding_balances(visits, p).collect()
    assert [(r.visit_id, r.balance) for r in bal] == [(3, Decimal("20.00"))]
    inc = agg.income_summary(visits, AS_OF).collect()[0]
    assert inc.today == Decimal("65.50") and inc.this_week == inc.this_month == Decimal("65.50")


def test_schema_upgrade_fills_charge_only_for_old_files(spark):
    cur = conform(spark.createDataFrame([(1, 1, dt.date(2026, 8, 1), None, Decimal("5.00"))],
                                        "id long, patient_id long, visit_date date, charge_amount decimal(18,2), "
                                        "payment_amount decimal(18,2)"), "visits")
    old = spark.createDataFrame([(2, 1, dt.date(2020, 1, 1), Decimal("40.00"))],
                                "id long, patient_id long, visit_date date, payment_amount decimal(18,2)")
    got = {r.id: (r.charge_amount, r.created_by_staff_id, r.pulse_bpm)
           for r in schema_upgrade(cur, old, table="visits").collect()}
    assert got == {1: (None, None, None), 2: (Decimal("40.00"), None, None)}


def test_settings_last_value_wins_and_blank_secret_is_ignored(spark):
    cur = spark.createDataFrame([("clinicName", "Old", 0), ("smsApiKey", "k1", 0)], "key string, value string, seq long")
    new = spark.createDataFrame([("clinicName", "A", 1), ("clinicName", "B", 2), ("smsApiKey", "  ", 3),
                                 ("smsUsername", None, 4)], "key string, value string, seq long")
    got = dict(rows(changes.settings_upsert(cur, new), "key", "value"))
    assert got == {"clinicName": "B", "smsApiKey": "k1"}


def _drugs(spark):
    return spark.createDataFrame(
        [(1, "Ibuprofen", "tablets", Decimal("100"), Decimal("20"), days(200)),
         (2, "Bandages", None, Decimal("5"), Decimal("10"), None),
         (3, "Doxycycline", "capsules", Decimal("40"), Decimal("10"), days(5)),
         (4, "Old stock", None, Decimal("10"), Decimal("10"), days(-3))],
        "id long, name string, unit string, quantity_on_hand decimal(18,3), reorder_level decimal(18,3), "
        "expiry_date date")


def test_stock_ledger_refusals_and_reconcile(spark):
    d = _drugs(spark)
    req = spark.createDataFrame(
        [(1, 1, "restock", Decimal("50"), days(400)), (1, 2, "dispense", Decimal("30"), None),
         (1, 3, "dispense", Decimal("9999"), None), (1, 4, "dispense", Decimal("0"), None),
         (1, 5, "restock", Decimal("5"), None), (77, 6, "restock", Decimal("1"), None),
         (2, 7, "dispense", Decimal("6"), None), (2, 8, "dispense", Decimal("5"), None)],
        "drug_id long, seq long, type string, quantity decimal(18,3), expiry_date date")
    led = ledger.stock_ledger_apply(d, req, ORDER).orderBy("seq").collect()
    assert [(r.accepted, r.balance_after) for r in led] == [
        (True, Decimal("150")), (True, Decimal("120")), (False, Decimal("120")), (False, Decimal("120")),
        (True, Decimal("125")), (False, None), (False, Decimal("5")), (True, Decimal("0"))]
    assert led[2].reason == "Only 120 tablets of Ibuprofen in stock"
    assert led[3].reason == "quantity must be greater than 0"
    assert led[5].reason == "No drug with id 77"
    assert led[6].reason == "Only 5 unit(s) of Bandages in stock"
    lf = ledger.stock_ledger_apply(d, req, ORDER)
    onhand = dict(rows(ledger.stock_on_hand(d, lf, ORDER), "drug_id", "quantity_on_hand"))
    assert onhand == {1: Decimal("125"), 2: Decimal("0"), 3: Decimal("40"), 4: Decimal("10")}
    exp = dict(rows(ledger.stock_expiry_replace(d, lf, ORDER), "drug_id", "expiry_date"))
    assert exp[1] == days(400) and exp[2] is None and exp[3] == days(5)
    log = ledger.accepted_movements(lf)
    after = ledger.stock_on_hand(d, lf, ORDER).select(F.col("drug_id").alias("id"), "quantity_on_hand")
    assert all(r.balanced for r in ledger.stock_reconcile(d, log, after).collect())
    wrong = after.withColumn("quantity_on_hand", F.when(F.col("id") == 2, 7).otherwise(F.col("quantity_on_hand")))
    assert [r.drug_id for r in ledger.stock_reconcile(d, log, wrong.where("id < 4")).collect() if not r.balanced] == [2, 4]


def test_low_stock_expiring_and_attention(spark):
    d = _drugs(spark)
    assert [r.name for r in search.low_stock(d).collect()] == ["Bandages", "Old stock"]
    assert [r.name for r in search.expiring_soon(d, AS_OF).collect()] == ["Old stock", "Doxycycline"]
    from wardlake.operators.setops import needs_attention
    att = needs_attention(d, AS_OF).collect()
    assert len(att) == 4
    assert [r.detail for r in att if r.section == 1] == ["5 unit(s) left (reorder at 10)", "10 unit(s) left (reorder at 10)"]


def test_staff_username_unique_lowercase_and_redacted(spark):
    existing = _staff(spark)
    batch = spark.createDataFrame(
        [(1, "Petra Two", "Nurse", " NursePetra ", "pw"), (2, "New One", "Admin", "Boss", "pw"),
         (3, "New Two", "Admin", "boss ", "pw"), (4, "X", "Admin", "x", "")],
        "row_key long, name string, role string, username string, password string")
    out = ingest.ingest_staff(batch, existing).orderBy("row_key").collect()
    assert out[0].reasons == ['Username " NursePetra " is already taken']
    assert out[1].reasons == [] and out[1].username == "boss"
    assert out[2].reasons == ['Username "boss " is already taken']
    assert out[3].reasons == ["password is required"]
    assert "password" not in ingest.accepted(ingest.ingest_staff(batch, existing)).columns
    assert "password_hash" not in search.staff_directory(existing).columns
    upd = changes.apply_staff_active(existing, spark.createDataFrame([(1, False, 1), (2, True, 2)],
                                                                     "id long, active boolean, seq long"))
    assert dict(rows(upd, "id", "active")) == {1: 0, 2: 1}


def test_dashboard_counts_distinct_patients_and_top_complaints(spark):
    v = spark.createDataFrame(
        [(1, 1, AS_OF, "Fever", Decimal("20")), (2, 1, AS_OF, "Fever", Decimal("5")),
         (3, 2, AS_OF, "Cough", Decimal("10")), (4, 3, days(-3), "Fever", Decimal("8")),
         (5, 3, days(-30), "Old", Decimal("1")), (6, 3, days(-2), "  ", Decimal("0"))],
        "id long, patient_id long, visit_date date, complaint string, payment_amount decimal(18,2)")
    seen = agg.patients_seen(v, AS_OF).collect()[0]
    assert (seen.patients_today, seen.patients_week) == (2, 3)
    assert [tuple(r) for r in agg.top_illnesses_week(v, AS_OF).collect()] == [("Fever", 3), ("Cough", 1)]
    appts = spark.createDataFrame([(1, 1, AS_OF, "Scheduled"), (2, 1, AS_OF, "Completed")],
                                  "id long, patient_id long, appointment_date date, status string")
    t = {"visits": v, "drugs": _drugs(spark), "appointments": appts}
    dash = reports.dashboard_summary(t, AS_OF).collect()[0]
    assert (dash.patients_today, dash.patients_week, dash.income_today, dash.appointments_today) == (
        2, 3, Decimal("35.00"), 1)
    assert dash.needs_attention_count == 4


def test_snapshot_names_and_retention(spark, tmp_path):
    from wardlake.sources import sinks
    assert sinks.snapshot_name(dt.datetime(2026, 8, 14, 9, 5, 7)) == "snapshot-2026-08-14_09-05-07"
    manifest = spark.createDataFrame([(n,) for n in ["snapshot-2026-08-10_00-00-00", "snapshot-2026-08-11_00-00-00",
                                                      "snapshot-2026-08-12_00-00-00", "snapshot-2026-08-13_00-00-00",
                                                      "snapshot-2026-08-14_00-00-00", "notes.txt"]], "name string")
    drop = sorted(r.name for r in sinks.snapshots_to_drop(manifest, keep=3).collect())
    assert drop == ["snapshot-2026-08-10_00-00-00", "snapshot-2026-08-11_00-00-00"]
    root = str(tmp_path / "snaps")
    t = {"drugs": _drugs(spark)}
    for h in range(4):
        sinks.snapshot_write(t, root, dt.datetime(2026, 8, 14, h, 0, 0))
    assert sinks.snapshot_retention(spark, root, keep=2) == 2
    left = sorted(r.name for r in sinks.snapshot_names(spark, root).collect())
    assert left == ["snapshot-2026-08-14_02-00-00", "snapshot-2026-08-14_03-00-00"]
    assert sinks.snapshot_retention(spark, root, keep=2) == 0
    assert sorted(x.name for x in (tmp_path / "snaps").iterdir()) == ["_manifest", *left]
    assert spark.read.parquet(f"{root}/snapshot-2026-08-14_03-00-00/drugs").count() == 4


def test_vitals_text_and_receipt_lines(spark):
    v = spark.createDataFrame(
        [(1, 38.5, "120/80", 72, 65.4, Decimal("50"), Decimal("30"), "Cash", "Ann", "Lee", "Petra", "Flu", None,
          AS_OF),
         (2, None, "", None, 65.0, Decimal("10"), Decimal("10"), None, "Bo", "Ray", None, None, None, AS_OF)],
        "id long, temperature_c double, blood_pressure string, pulse_bpm int, weight_kg double, "
        "charge_amount decimal(18,2), payment_amount decimal(18,2), payment_method string, first_name string, "
        "last_name string, recorded_by_name string, complaint string, treatment string, visit_date date")
    txt = [r[0] for r in v.orderBy("id").select(labels.fmt_vitals(
        F.col("temperature_c"), F.col("blood_pressure"), F.col("pulse_bpm"), F.col("weight_kg"))).collect()]
    assert txt == ["T: 38.5°C · BP: 120/80 · P: 72bpm · W: 65.4kg", "W: 65kg"]
    lines = labels.visit_receipts(v).where("visit_id = 1").orderBy("line_no").collect()
    assert [r.label for r in lines] == ["Patient", "Visit Date", "Complaint", "Vitals", "Amount Charged",
                                        "Amount Paid", "Balance Owed", "Served By"]
    assert lines[5].value == "$30.00 (Cash)" and lines[6].value == "$20.00"
    assert "Balance Owed" not in [r.label for r in labels.visit_receipts(v).where("visit_id = 2").collect()]


def test_appointments_upcoming_and_status(spark):
    p = _patients(spark)
    a = spark.createDataFrame([(1, 1, days(1), "09:30", "Scheduled"), (2, 1, days(-1), "10:00", "Scheduled"),
                               (3, 2, days(2), None, "Cancelled")],
                              "id long, patient_id long, appointment_date date, appointment_time string, status string")
    assert [r.id for r in joins.upcoming_appointments(a, p, AS_OF).collect()] == [1]
    ch = spark.createDataFrame([(1, "Completed", 1), (1, "Bogus", 2), (99, "Completed", 3)],
                               "id long, status string, seq long")
    upd, bad = changes.apply_appointment_status(a, ch)
    assert dict(rows(upd, "id", "status"))[1] == "Completed"
    assert sorted(r.reason for r in bad.collect()) == [
        "No appointment with id 99", "status must be one of: Scheduled, Completed, Cancelled, No-Show"]


def test_license_feed_cases(spark):
    from wardlake.sources.license import license_feed
    docs = spark.createDataFrame([
        (1, "not json", "abc"), (2, "{}", "abc"), (3, '{"abc": {"expiresAt": "x"}}', "xyz"), (4, '{"abc": {}}', "abc"),
        (5, '{"abc": {"expiresAt": "2027-01-15", "clinicName": "Test Clinic"}}', "abc"),
        (6, '{"abc": {"expiresAt": "2027-01-15", "plan": "10month"}}', "abc"),
        (7, '{"abc": {"expiresAt": "2027-01-15", "plan": "forever"}}', "abc"),
        (8, '{"abc": {"expiresAt": 20270115}}', "abc"), (9, '[1, 2]', "0")],
        "doc_id int, text string, clinic_key string")
    got = rows(license_feed(docs, keep=["doc_id"]), "doc_id", "expires_at", "plan")
    assert got == [(5, "2027-01-15", None), (6, "2027-01-15", "10month"), (7, "2027-01-15", None)]


def test_license_renewal_and_banner(spark):
    c = spark.createDataFrame([(1, "2026-09-30"), (2, None), (3, "2026-08-01")], "clinic_id int, licenseExpiresAt string")
    q = {(r.clinic_id, r.plan, r.mode): (r.price, r.new_expires_at)
         for r in changes.license_renewal_dates(c, dt.date(2026, 8, 31)).collect()}
    assert q[(2, "3month", "buy")] == (70, dt.date(2026, 12, 1))        # Nov 31 rolls over
    assert q[(1, "3month", "renew")] == (20, dt.date(2026, 12, 30))     # extends from the later date
    assert q[(3, "10month", "renew")] == (40, dt.date(2027, 7, 1))      # expired: from as_of (Jun 31 rolls over)
    b = c.select("clinic_id", labels.license_banner(F.col("licenseExpiresAt"), dt.date(2026, 8, 2)).alias("b"))
    got = {r.clinic_id: (r.b.css_class, r.b.text) for r in b.collect()}
    assert got[2] == (None, None) and got[1] == (None, None)
    assert got[3][0] == "banner-expired" and "(1 day ago)" in got[3][1]


def test_trend_spine_and_top_six_months(spark):
    v = spark.createDataFrame([(1, 1, AS_OF, "Malaria", Decimal("15")), (2, 2, AS_OF, "Malaria", Decimal("25")),
                               (3, 1, AS_OF, "Typhoid", Decimal("10"))],
                              "id long, patient_id long, visit_date date, complaint string, payment_amount decimal(18,2)")
    t = agg.monthly_visit_trends(v, AS_OF).collect()
    assert len(t) == 6 and t[-1].month == "2026-08" and (t[-1].visit_count, t[-1].income) == (3, Decimal("50.00"))
    assert t[0].visit_count == 0
    p = spark.createDataFrame([(1, dt.datetime(2026, 8, 1, 10)), (2, dt.datetime(2026, 7, 31, 23, 30))],
                              "id long, created_at timestamp")
    n = agg.new_patients_by_month(p, dt.datetime(2026, 8, 14, 12), tz="+01:00").collect()
    assert len(n) == 6 and n[-1].n == 2                                  # 23:30 UTC is August locally
    assert agg.top_illnesses_6m(v, AS_OF).collect()[0].asDict() == {"complaint": "Malaria", "n": 2}
    scaled = refills.trend_bar_scale(agg.monthly_visit_trends(v, AS_OF), "visit_count").collect()
    assert [r.height_pct for r in scaled] == [4, 4, 4, 4, 4, 100]


def test_quota_five_allowed_sixth_refused(spark):
    m = spark.createDataFrame([(1, i, dt.datetime(2026, 8, 14, 9, i)) for i in range(6)]
                              + [(1, 9, dt.datetime(2026, 8, 15, 9, 0))],
                              "clinic_id int, message_id long, sent_at timestamp")
    got = dict(rows(changes.ai_quota_admission(m, limit=5), "message_id", "admitted"))
    assert [got[i] for i in range(6)] == [True] * 5 + [False] and got[9] is True


def _refill_fixture(spark):
    clients = spark.createDataFrame([(1, "Harbor Dairy", "0555000001", "Active"),
                                     (2, "Mill Bakery", "0555000002", "Active"),
                                     (3, "Quarry Works", "0555000003", "Active"),
                                     (4, "Old Ferry", "0555000004", "Inactive")],
                                    "id long, name string, phone string, status string")
    hist = spark.createDataFrame(
        [(1, 1, days(-60), "Order", "Salbutamol", 30, None), (2, 1, days(-27), "Order", "Salbutamol", 30, None),
         (3, 2, days(-40), "Order", "Enalapril", 30, None), (4, 3, days(-5), "Order", "Ranitidine", 30, None),
         (5, 4, days(-30), "Order", "Folic acid", 30, None), (6, 1, days(-1), "Note", None, None, None)],
        "id long, client_id long, entry_date date, entry_type string, medication string, day_supply int, "
        "reminder_sent_at timestamp")
    return clients, hist


def test_refills_due_and_reminders(spark):
    clients, hist = _refill_fixture(spark)
    due = {r.client_name: r.days_until_due for r in refills.refills_due(hist, clients, AS_OF, 7).collect()}
    assert due == {"Harbor Dairy": 3, "Mill Bakery": -10}
    assert "Harbor Dairy" not in {r.client_name for r in refills.refills_due(hist, clients, AS_OF, 2).collect()}
    marked = changes.apply_reminders_sent(hist, spark.createDataFrame([(2, dt.datetime(2026, 8, 14, 8))],
                                                                      "id long, sent_at timestamp"))
    after = {r.client_name for r in refills.refills_due(marked, clients, AS_OF, 7).collect()}
    assert after == {"Mill Bakery"}            # the reminded newest order still hides the older one


def test_nested_export_shape(spark):
    from wardlake.sources import sinks
    clients, hist = _refill_fixture(spark)
    doc = "".join(r.text for r in sinks.export_clients_nested(clients, hist).orderBy("row").collect())
    n = {d["id"]: d for d in map(json.loads, doc.splitlines())}
    assert [h["id"] for h in n[1]["history"]] == [6, 2, 1] and set(n) == {1, 2, 3, 4}
    assert sorted(n[1]["history"][0]) == sorted(["daySupply", "entryDate", "entryType", "id", "medication", "reminderSentAt"])
    empty = spark.createDataFrame([(9, "No History", None, "Active")], "id long, name string, phone string, status string")
    assert [r.text for r in sinks.export_clients_nested(empty, hist).collect()] == ['{"id":9,"name":"No History","phone":null,"status":"Active","history":[]}\n']
    assert sinks.export_clients_nested(empty.where("false"), hist).collect() == []


def test_cards_and_history_labels(spark):
    card = labels.patient_card(_patients(spark)).where("id = 1").collect()[0]
    assert card.meta == "DOB: 1987-11-23 · Female · 0555010203" and card.display_name == "Ingrid Sandvik"
    h = spark.createDataFrame([(1, "Salbutamol", "30 tablets", 30), (2, None, None, None)],
                              "id long, medication string, quantity string, day_supply int")
    got = rows(labels.history_labels(h), "id", "medication_label", "supply_label")
    assert got == [(1, "Salbutamol (30 tablets)", "30 days"), (2, "", "")]


def test_numbers_that_do_not_fit_are_reported(spark):
    p = spark.createDataFrame([(1,)], "id long")
    batch = spark.createDataFrame(
        [(1, "1", "2026-08-14", "1e17", None, "1d", "72.5"), (2, "1", "2026-08-14", "1e2", "", "NaN", "1e2"),
         (3, "1", "2026-08-14", " 7.25 ", "Infinity", "1e999", "0x10")],
        "row_key long, patient_id string, visit_date string, payment_amount string, charge_amount string, temperature_c string, pulse_bpm string")
    got = ingest.ingest_visits(batch, p).orderBy("row_key").collect()
    assert [r.reasons for r in got] == [["paymentAmount is too large"], [], ["temperatureC is too large"]]
    assert [r.temperature_c for r in got[:2]] == [None, None] and [r.pulse_bpm for r in got] == [72.5, 100.0, None]
    assert (got[1].payment_amount, got[1].charge_amount) == (Decimal("100.00"), Decimal("100.00"))
    assert (got[2].payment_amount, got[2].charge_amount) == (Decimal("7.25"), Decimal("0.00"))
    drugs = spark.createDataFrame([(1, "a", "99999999999999999"), (2, "b", "2.5")], "row_key long, name string, quantity_on_hand string")
    assert [r.reasons for r in ingest.ingest_drugs(drugs).orderBy("row_key").collect()] == [["quantityOnHand is too large"], []]


def test_half_days_keep_their_refill(spark):
    clients = spark.createDataFrame([(1, "c", None, "Active")], "id long, name string, phone string, status string")
    batch = spark.createDataFrame([(1, "1", AS_OF.isoformat(), "Order", "m", "30.5"), (2, "1", AS_OF.isoformat(), "Order", "n", "1e9")],
                                  "row_key long, client_id string, entry_date string, entry_type string, medication string, day_supply string")
    out = ingest.ingest_history(batch, clients)
    assert {r.row_key: r.reasons for r in out.collect()} == {1: [], 2: ["daySupply is too large"]}
    hist = ingest.accepted(out).select(F.col("row_key").alias("id"), "client_id", "entry_date", "entry_type", "medication", "day_supply",
                                       F.lit(None).cast("timestamp").alias("reminder_sent_at"))
    assert [(r.id, r.days_until_due) for r in refills.refills_due(hist, clients, AS_OF, 40).collect()] == [(1, 30)]


def test_quiet_clinics_and_unowned_facts_have_rows(spark):
    clinics = spark.createDataFrame([(1,), (2,)], "clinic_id int")
    owners = spark.createDataFrame([(10, 1)], "id long, clinic_id int")
    v = spark.createDataFrame([(1, 10, AS_OF, Decimal("3")), (2, 99, AS_OF, Decimal("4"))], "id long, patient_id long, visit_date date, payment_amount decimal(18,2)")
    s = agg.income_summary(reports.stamp_tenant(v, owners, "patient_id"), AS_OF, ["clinic_id"], clinics)
    assert {r.clinic_id: r.today for r in s.collect()} == {1: Decimal("3.00"), 2: Decimal("0.00"), None: Decimal("4.00")}
