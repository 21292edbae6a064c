"""Edge rules that silently differ between engines, attribution,
audits, and the settings-driven reports."""

import datetime as dt
import json
from decimal import Decimal

from helpers import AS_OF, days, rows
from wardlake.operators import aggregates as agg
from wardlake.operators import changes, ingest, joins, refills, search
from wardlake.plans import reports
from wardlake.sources import sinks


def _visits(spark, data):
    return spark.createDataFrame(data, "id long, patient_id long, visit_date date, complaint string, "
                                       "payment_amount decimal(18,2)")


def test_p2_week_and_month_have_no_upper_bound(spark):
    v = _visits(spark, [(1, 1, days(3), "X", Decimal("7")), (2, 1, days(40), "X", Decimal("1")),
                        (3, 2, days(-5), "X", Decimal("2"))])   # days(-5): last week, this month
    s = agg.income_summary(v, AS_OF).collect()[0]
    assert (s.today, s.this_week, s.this_month) == (Decimal("0.00"), Decimal("8.00"), Decimal("10.00"))


def test_p4_trend_keeps_six_months_and_drops_later_ones(spark):
    v = _visits(spark, [(1, 1, dt.date(2026, 3, 1), "X", Decimal("1")), (2, 1, dt.date(2026, 2, 28), "X", Decimal("1")),
                        (3, 1, dt.date(2026, 9, 2), "X", Decimal("5"))])
    t = agg.monthly_visit_trends(v, AS_OF).collect()
    assert [r.month for r in t] == ["2026-03", "2026-04", "2026-05", "2026-06", "2026-07", "2026-08"]
    assert [r.visit_count for r in t] == [1, 0, 0, 0, 0, 0]


def test_p8_nulls_first_ascending_in_capped_lists(spark):
    d = spark.createDataFrame([(1, "b", None), (2, None, None), (3, "a", None)],
                              "id long, name string, phone string")
    assert [r.id for r in search.search_clients(d, None, cap=2).collect()] == [2, 3]


def test_p9_complaints_group_on_raw_text(spark):
    v = _visits(spark, [(1, 1, AS_OF, "Fever", Decimal("0")), (2, 1, AS_OF, "fever ", Decimal("0")),
                        (3, 1, AS_OF, "Fever", Decimal("0")), (4, 1, AS_OF, "   ", Decimal("0"))])
    assert rows(agg.top_illnesses_week(v, AS_OF), "complaint", "n") == [("Fever", 2), ("fever ", 1)]


def test_p13_p14_null_medication_group_and_same_day_tie(spark):
    clients = spark.createDataFrame([(1, "A", None, "Active")], "id long, name string, phone string, status string")
    h = spark.createDataFrame(
        [(1, 1, days(-10), "Order", None, 30, None), (2, 1, days(-5), "Order", None, 30, None),
         (3, 1, days(-5), "Order", "Zinc", 10, None), (4, 1, days(-5), "Order", "Zinc", 20, None)],
        "id long, client_id long, entry_date date, entry_type string, medication string, day_supply int, "
        "reminder_sent_at timestamp")
    latest = dict(rows(refills.latest_order_per_medication(h, clients), "medication", "id"))
    assert latest == {None: 2, "Zinc": 4}


def test_attribution_names_and_coverage(spark):
    staff = spark.createDataFrame([(1, "Nurse Petra")], "id long, name string")
    v = spark.createDataFrame([(1, 1, AS_OF, 1), (2, 1, days(-1), None), (3, 1, days(-2), 42)],
                              "id long, patient_id long, visit_date date, created_by_staff_id long")
    names = rows(joins.visit_history(v, staff), "id", "recorded_by_name")
    assert names == [(1, "Nurse Petra"), (2, None), (3, None)]
    cov = joins.attribution_coverage({"visits": v}, staff).collect()[0]
    assert (cov.records, cov.with_author, cov.with_known_author) == (3, 2, 1)


def test_fk_audit_and_enum_check(spark):
    t = {"patients": spark.createDataFrame([(1, None)], "id long, created_by_staff_id long"),
         "staff": spark.createDataFrame([(1,)], "id long"),
         "visits": spark.createDataFrame([(1, 1, 1), (2, 9, None), (3, 9, 5)],
                                         "id long, patient_id long, created_by_staff_id long"),
         "appointments": spark.createDataFrame([(1, 1, "Scheduled", None), (2, 1, "Done", None)],
                                               "id long, patient_id long, status string, created_by_staff_id long")}
    fk = {r.edge: (r.references, r.orphans) for r in ingest.fk_audit(t).collect()}
    assert fk["visits.patient_id"] == (3, 2) and fk["visits.created_by_staff_id"] == (2, 1)
    assert fk["patients.created_by_staff_id"] == (0, 0)
    en = {(r.value, r.valid) for r in ingest.enum_check(t).collect()}
    assert en == {("Scheduled", True), ("Done", False)}


def _settings(spark):
    log = spark.createDataFrame(
        [(1, "refillRemindersEnabled", "1", 1), (1, "smsUsername", "clinic1", 2), (1, "smsApiKey", "secret", 3),
         (1, "licensePlan", "10month", 4), (1, "licenseExpiresAt", "2026-08-20", 5), (1, "cloudSyncToken", "t", 6),
         (2, "refillRemindersEnabled", "1", 1), (2, "smsUsername", "clinic2", 2), (2, "smsApiKey", " ", 3),
         (2, "licensePlan", "3month", 4)],
        "clinic_id int, key string, value string, seq long")
    empty = spark.createDataFrame([], "clinic_id int, key string, value string, seq long")
    return changes.settings_upsert(empty, log, tenant=["clinic_id"])


def test_sync_status_reduces_secrets_to_flags(spark):
    st = {r.clinic_id: r for r in reports.sync_status(_settings(spark)).collect()}
    assert st[1].reminders_enabled and st[1].has_sms_api_key and st[1].has_sync_token
    assert not st[2].has_sms_api_key                          # a blank key never replaced anything
    assert not any("secret" in str(v) for r in st.values() for v in r.asDict().values())


def test_sync_envelope_only_opted_in_clinics_and_no_keys(spark):
    clients = spark.createDataFrame([(10, "A", None, "Active", 1), (20, "B", None, "Active", 2)],
                                    "id long, name string, phone string, status string, clinic_id int")
    hist = spark.createDataFrame([(1, 10, AS_OF, "Order", "Zinc", 30, None)],
                                 "id long, client_id long, entry_date date, entry_type string, medication string, "
                                 "day_supply int, reminder_sent_at timestamp")
    env = sinks.sync_envelope(_settings(spark), clients, hist)
    docs = "".join(r.text for r in env.orderBy("row").collect()).splitlines()
    assert len(docs) == 1 and json.loads(docs[0])["client"]["history"][0]["daySupply"] == 30 and '"clinicId":1' in docs[0] and '"username":"clinic1"' in docs[0]
    assert "secret" not in docs[0] and '"entryDate":"2026-08-14"' in docs[0]


def test_license_apply_reports_only_changes(spark):
    cur = changes.settings_pivot(_settings(spark), ["licenseExpiresAt", "licensePlan"])
    feed = spark.createDataFrame([(1, "2026-08-20", None), (2, "2027-01-01", None), (1, "2026-08-20", "3month")],
                                 "clinic_id int, expires_at string, plan string")
    got = rows(changes.license_apply(cur, feed), "clinic_id", "licenseExpiresAt", "licensePlan", "plan_changed")
    assert got == [(1, "2026-08-20", "3month", True), (2, "2027-01-01", "3month", False)]


def test_trends_bundle_only_for_ten_month_plan(spark):
    v = spark.createDataFrame([(1, 1, AS_OF, "Flu", Decimal("5"), 1), (2, 2, AS_OF, "Flu", Decimal("5"), 2)],
                              "id long, patient_id long, visit_date date, complaint string, "
                              "payment_amount decimal(18,2), clinic_id int")
    p = spark.createDataFrame([(1, dt.datetime(2026, 8, 1, 9), 1), (2, dt.datetime(2026, 8, 1, 9), 2)],
                              "id long, created_at timestamp, clinic_id int")
    b = reports.trends_bundle({"visits": v, "patients": p}, _settings(spark), AS_OF, dt.datetime(2026, 8, 14, 12), "UTC")
    assert {r.clinic_id for r in b["visits"].collect()} == {1}
    assert [r.visit_count for r in b["visits"].collect()][-1] == 1
    assert rows(b["top_illnesses"], "clinic_id", "complaint", "n") == [(1, "Flu", 1)]


def test_drug_flags_and_card(spark):
    from wardlake.functions import labels
    d = spark.createDataFrame([(1, "Zinc", None, Decimal("2.500"), Decimal("3"), days(10))],
                              "id long, name string, unit string, quantity_on_hand decimal(18,3), "
                              "reorder_level decimal(18,3), expiry_date date")
    f = search.drug_flags(d, AS_OF).collect()[0]
    assert f.is_low and f.is_expiring
    assert labels.drug_card(d).collect()[0].meta == "2.5 unit(s) on hand · reorder at 3 · expires 2026-08-24"


def test_scan_table_declared_schema_and_missing_columns(spark, tmp_path):
    from wardlake.sources.tables import scan_table
    old = spark.createDataFrame([(1, 2, AS_OF, Decimal("40.00"))],
                                "id long, patient_id long, visit_date date, payment_amount decimal(18,2)")
    old.write.parquet(str(tmp_path / "visits"))
    v = scan_table(spark, str(tmp_path / "visits"), "visits")
    r = v.collect()[0]
    assert r.payment_amount == Decimal("40.00") and r.charge_amount is None and r.pulse_bpm is None
    assert dict(v.dtypes)["charge_amount"] == "decimal(18,2)" and "created_by_staff_id" in v.columns


def test_quota_counts_messages_already_used_today(spark):
    m = spark.createDataFrame([(1, i, dt.datetime(2026, 8, 14, 9, i)) for i in range(5)]
                              + [(2, 10 + i, dt.datetime(2026, 8, 14, 9, i)) for i in range(5)],
                              "clinic_id int, message_id long, sent_at timestamp")
    used = spark.createDataFrame([(1, AS_OF, 3)], "clinic_id int, day date, used int")
    got = dict(rows(changes.ai_quota_admission(m, limit=5, used=used), "message_id", "admitted"))
    assert [got[i] for i in range(5)] == [True, True, False, False, False]
    assert all(got[10 + i] for i in range(5))


def test_per_clinic_list_cap(spark):
    p = spark.createDataFrame([(c, i, f"F{i}", f"L{i % 3}", None) for c in (1, 2) for i in range(5)],
                              "clinic_id int, id long, first_name string, last_name string, phone string")
    got = rows(search.search_patients(p, None, cap=2, tenant=["clinic_id"]), "clinic_id", "id")
    assert got == [(1, 0), (1, 3), (2, 0), (2, 3)]
    keys = spark.createDataFrame([(1, 4), (1, 4), (2, 9)], "clinic_id int, id long")
    assert rows(search.lookup_by_keys(p, keys, tenant=["clinic_id"]), "clinic_id", "id") == [(1, 4)]


def test_license_feed_entries_one_document_for_all_clinics(spark):
    from wardlake.sources.license import license_feed_entries
    doc = ('{"a": {"expiresAt": "2027-01-15", "plan": "10month"}, "b": {"expiresAt": 5}, "c": {},'
           ' "d": {"expiresAt": "2026-12-01", "plan": "forever"}, "e": "x"}')
    docs = spark.createDataFrame([(1, doc), (2, "not json"), (3, "[1, 2]")], "doc_id int, text string")
    got = rows(license_feed_entries(docs, keep=["doc_id"]), "doc_id", "clinic_key", "expires_at", "plan")
    assert got == [(1, "a", "2027-01-15", "10month"), (1, "d", "2026-12-01", None)]
